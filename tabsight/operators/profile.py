"""Column and table profile."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import (
    BOOLEAN_WORDS,
    DATE_PATTERN,
    col,
    is_numeric,
    is_temporal,
    number_of,
    parse_timestamp,
    present,
    ratio,
    scalar_columns,
    value_key,
)
from ..functions.ranks import column_quantiles, melt
from ..session import materialize

PROFILE_PROBS = (0.25, 0.5, 0.75)
FEW_DIGESTS = 1_000_000  # of 16 bytes each
COLUMNS_PER_SCAN = 4  # columnar scans read only their own columns; small aggregates stay compiled


def _cell_facts(df: DataFrame, name: str) -> dict[str, Column]:
    """Aggregates of one column; only those its declared type can have."""
    field = df.schema[name]
    c, here = col(name), present(df, name)
    zero, none, never = F.lit(0).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    facts = {"count": F.count(F.lit(1)), "missing": F.count_if(~here)}
    x = None
    if is_temporal(field):
        moment = c.cast("timestamp_ntz")
        facts.update(dates=F.count(c), bools=zero, mean_words=F.lit(1.0), first_moment=F.min(moment), last_moment=F.max(moment))
    elif isinstance(field.dataType, T.StringType):
        x = F.when(here, number_of(df, name))
        short = F.length(c) <= 40
        shaped = short & (F.trim(c).rlike(DATE_PATTERN) | (c.contains("T") & c.contains(":")))
        moment = F.when(here & x.isNull() & F.coalesce(shaped, F.lit(False)), parse_timestamp(c))
        wordy = here & x.isNull() & moment.isNull() & short & F.lower(F.trim(c)).isin(*BOOLEAN_WORDS)
        words = F.when(here, F.size(F.split(F.trim(c), r"\s+")))
        facts.update(dates=F.count(moment), bools=F.count_if(wordy), mean_words=F.avg(words), first_moment=F.min(moment), last_moment=F.max(moment))
    else:
        is_bool = isinstance(field.dataType, T.BooleanType)
        x = None if is_bool else number_of(df, name)
        facts.update(dates=zero, bools=F.count(c) if is_bool else zero, mean_words=F.lit(1.0), first_moment=never, last_moment=never)
    if x is None:
        facts.update(numbers=zero, zeros=zero, negatives=zero, **{k: none for k in ("min", "max", "mean", "std", "std_pop", "skew")})
        return facts
    n = F.count(x)
    std = F.when(n > 1, F.stddev_samp(x)).otherwise(F.lit(0.0))
    facts.update(
        numbers=n,
        min=F.min(x),
        max=F.max(x),
        mean=F.avg(x),
        std=std,
        std_pop=F.when(n > 0, std * F.sqrt((n - 1) / F.greatest(n, F.lit(1)))),
        skew=F.when(F.min(x) < F.max(x), F.skewness(x)).otherwise(F.lit(0.0)),
        zeros=F.count_if(x == 0),
        negatives=F.count_if(x < 0),
    )
    return facts


def column_facts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column from one aggregate row per scan; nothing but that row is shuffled."""
    parts = []
    for start in range(0, len(names), COLUMNS_PER_SCAN):
        aggs, rows = [], []
        for i, name in enumerate(names[start : start + COLUMNS_PER_SCAN]):
            facts = sorted(_cell_facts(df, name).items())
            aggs += [made.alias(f"{key}_{i}") for key, made in facts]
            cells = [F.col(f"{key}_{i}").alias(key) for key, _ in facts]
            rows.append(F.struct(F.lit(start + i).alias("pos"), F.lit(name).alias("column"), *cells))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return functools.reduce(DataFrame.unionByName, parts)


def _native_type(df: DataFrame, names: Sequence[str]) -> Column:
    """The type a declared schema already settles, null where values decide."""
    times = [n for n in names if is_temporal(df.schema[n])]
    bools = [n for n in names if isinstance(df.schema[n].dataType, T.BooleanType)]
    return F.when(F.col("column").isin(times), "datetime").when(F.col("column").isin(bools), "boolean")


def column_type(native: Column) -> Column:
    """Semantic type from vote shares, then distinctness; thresholds are fixed values."""
    filled = F.col("count") - F.col("missing")
    share = lambda votes: ratio(F.col(votes), filled)
    distinct_share = ratio(F.col("unique"), filled)
    return (
        F.when(native.isNotNull(), native)
        .when(filled == 0, "text")
        .when(share("dates") > 0.70, "datetime")
        .when(share("numbers") > 0.85, "numeric")
        .when(share("bools") > 0.90, "boolean")
        .when((filled > 20) & (distinct_share > 0.95), "id")
        .when(F.col("unique") <= F.greatest(F.lit(20), F.floor(filled * 0.1)), "categorical")
        .otherwise("text")
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 8) -> DataFrame:
    """(pos, column, rk, value, n): the k most frequent values, ties by value.

    Long strings are counted by digest; only the k winners are read back in full.
    """
    names = list(columns) if columns is not None else scalar_columns(df)
    counts = melt(df, names).groupBy("pos", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return _named_top(df, names, counts, k)


def _named_top(df: DataFrame, names: Sequence[str], counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("pos").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if not texts:
        return best
    cells = [
        F.struct(F.lit(n).alias("column"), value_key(col(n), df.schema[n]).alias("value"), col(n).alias("full"))
        for n in texts
    ]
    digests = best.where(F.col("value").startswith("sha256:")).select("column", "value")
    long_cells = df.select(F.inline(F.array(*cells))).where(F.col("value").startswith("sha256:"))
    found = (
        long_cells.join(F.broadcast(digests), ["column", "value"])  # at most k rows per column
        .groupBy("column", "value")
        .agg(F.first("full").alias("full"))
    )
    return best.join(F.broadcast(found), ["column", "value"], "left").select(
        "pos", "column", "rk", F.coalesce("full", "value").alias("value"), "n"
    )


def outlier_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, q1, median, q3, outliers, numbers) by the 1.5 IQR fences.

    The quartiles come first, three numbers per column; counting against them
    is then one aggregate without a join.
    """
    schema = "column string, q1 double, median double, q3 double"
    found = [(r["column"], *r["q"]) for r in column_quantiles(df, columns, PROFILE_PROBS).collect()]
    if not found:
        return df.sparkSession.createDataFrame([], schema + ", outliers long, numbers long")
    parts = []
    for start in range(0, len(found), COLUMNS_PER_SCAN):
        chunk, aggs, rows = found[start : start + COLUMNS_PER_SCAN], [], []
        for i, (name, q1, median, q3) in enumerate(chunk):
            x, spread = number_of(df, name), 1.5 * (q3 - q1)
            aggs += [F.count_if((x < q1 - spread) | (x > q3 + spread)).alias(f"o{i}"), F.count(x).alias(f"n{i}")]
            known = zip(("column", "q1", "median", "q3"), (name, q1, median, q3))
            rows.append(F.struct(*[F.lit(v).alias(k) for k, v in known], F.col(f"o{i}").alias("outliers"), F.col(f"n{i}").alias("numbers")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return functools.reduce(DataFrame.unionByName, parts)


def _native_form(field: T.StructField) -> str | None:
    """The type in which a column's values are told apart without text; None for texts, booleans and decimals."""
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return "double"
    return "long" if is_temporal(field) or isinstance(field.dataType, T.IntegralType) else None


def native_distincts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique) of number and time columns, counted as eight-byte values."""
    parts, names = [], F.array(*[F.lit(n) for n in columns])
    for form in ("long", "double"):
        cells = []
        for i, name in enumerate(columns):
            field = df.schema[name]
            if _native_form(field) != form:
                continue
            if is_temporal(field):
                v = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(name).cast("timestamp_ntz"))
            else:
                v = (col(name) + F.lit(0.0)).cast("double") if form == "double" else col(name).cast("long")
            cells.append(F.when(present(df, name), F.struct(F.lit(i).alias("pos"), v.alias("v"))))
        if cells:
            values = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("pos", "v").agg(F.lit(1).alias("one"))
            parts.append(values.groupBy("pos").agg(F.count(F.lit(1)).alias("unique")).select(F.get(names, F.col("pos")).alias("column"), "unique"))
    return functools.reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, counts, moments, quantiles, dates and top values."""
    names = list(columns) if columns is not None else scalar_columns(df)
    facts = materialize(column_facts(df, names))  # one row per column
    # a floating column with many infinities is no number column and shows its values
    odd = [r["column"] for r in facts.where(F.col("numbers") <= 0.85 * (F.col("count") - F.col("missing"))).select("column").collect()]
    plain = [n for n in names if _native_form(df.schema[n]) and (n not in odd or not is_numeric(df.schema[n]))]
    shown = [n for n in names if n not in plain]
    out = facts
    sizes = [native_distincts(df, plain)] if plain else []
    if shown:
        counts = melt(df, shown).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("pos", F.array_position(F.array(*[F.lit(n) for n in shown]), F.col("column")))
        sizes.append(counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique")))
        top = (
            _named_top(df, shown, counts, 8)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list(F.struct("rk", "value", "n"))).alias("ranked"))  # 8 entries
            .select("column", F.transform("ranked", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n"))).alias("top_values"))
        )
        out = out.join(F.broadcast(top), "column", "left")
    else:
        out = out.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    out = out.join(F.broadcast(functools.reduce(DataFrame.unionByName, sizes)), "column", "left")
    maybe_numeric = [n for n in names if is_numeric(df.schema[n]) or isinstance(df.schema[n].dataType, T.StringType)]
    if maybe_numeric:
        spread = outlier_counts(df, maybe_numeric).select("column", "q1", "median", "q3", "outliers")
        out = out.join(F.broadcast(spread), "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("q1", "median", "q3")], F.lit(None).cast("long").alias("outliers"))
    out = out.withColumn("unique", F.coalesce("unique", F.lit(0)))
    out = out.withColumn("type", column_type(_native_type(df, names)))
    filled = F.col("count") - F.col("missing")
    unique_pct = F.coalesce(ratio(F.col("unique") * 100, filled), F.lit(0.0))
    numeric = F.col("type") == "numeric"
    only = lambda c: F.when(numeric, F.col(c)).alias(c)
    return out.select(
        "pos",
        F.col("column").alias("name"),
        "type",
        "count",
        "missing",
        F.coalesce(ratio(F.col("missing") * 100, F.col("count")), F.lit(0.0)).alias("missing_pct"),
        "unique",
        unique_pct.alias("unique_pct"),
        ((F.col("unique") <= 1) & (filled > 0)).alias("constant"),
        ((F.col("unique") > 50) & (unique_pct > 50)).alias("high_cardinality"),
        F.coalesce((F.col("mean_words") >= 4) & (ratio(F.col("unique"), F.col("count")) > 0.5), F.lit(False)).alias("is_free_text"),
        *[only(c) for c in ("min", "max", "mean", "median", "std", "q1", "q3", "outliers", "zeros", "negatives", "skew", "std_pop")],
        F.when(F.col("type").isin("categorical", "boolean", "text"), F.col("top_values")).alias("top_values"),
        F.when(F.col("type") == "datetime", F.date_format("first_moment", "yyyy-MM-dd HH:mm:ss")).alias("min_date"),
        F.when(F.col("type") == "datetime", F.date_format("last_moment", "yyyy-MM-dd HH:mm:ss")).alias("max_date"),
    )


def _cells(df: DataFrame) -> list[Column]:
    """One comparable cell per column; long strings and nested values as short keys."""
    cells = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = value_key(c, f)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.sha2(c, 256)
        elif f.name not in scalar_columns(df):
            c = F.sha2(F.to_json(c).cast("binary"), 256)
        cells.append(c)
    return cells


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicates): rows after the first copy, nulls equal.

    Rows are counted by a digest of 128 bits over their typed cells, map side
    first, so a row costs 16 bytes and a hot row one entry a task. The cells
    themselves are compared only for rows whose digest is seen twice; up to
    FEW_DIGESTS such digests are sent to the rows, more are joined by shuffle.
    """
    cells = _cells(df)
    # the hash passes over nulls, so a mark of the gaps goes with the cells
    gaps = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    first, second = F.xxhash64(F.lit(17), gaps, *cells), F.xxhash64(F.lit(40_503), *reversed(cells), gaps)
    by = F.struct(first.alias("a"), second.alias("b"))
    seen = df.select(by.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(seen.groupBy((F.col("n") > 1).alias("again"), F.when(F.col("n") > 1, F.col("d")).alias("d")).agg(F.sum("n").alias("n")))
    again = several.where("again").select("d")
    few = again.count() <= FEW_DIGESTS
    rows = df.select(by.alias("d"), *[c.alias(f"k{i}") for i, c in enumerate(cells)])
    alike = rows.join(F.broadcast(again) if few else again, "d", "left_semi")
    copies = alike.groupBy("d", *[f"k{i}" for i in range(len(cells))]).agg(F.count(F.lit(1)).alias("n"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    extra = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return total.withColumn("duplicates", extra.scalar())


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row: rows, cols, cells, duplicate rows, missing cells and their share."""
    names = scalar_columns(df)
    missing = df.agg(*[F.count_if(~present(df, n)).alias(f"m{i}") for i, n in enumerate(names)])
    total = sum((F.col(f"m{i}") for i in range(len(names))), F.lit(0))
    cells = F.col("rows") * len(names)
    # both sides are one row
    return (
        duplicate_rows(df)
        .withColumn("missing_cells", missing.select(total).scalar())
        .select(
            "rows",
            F.lit(len(names)).cast("long").alias("cols"),
            cells.alias("total_cells"),
            "duplicates",
            "missing_cells",
            F.coalesce(ratio(F.col("missing_cells") * 100, cells), F.lit(0.0)).alias("missing_pct"),
        )
    )


def column_samples(df: DataFrame, order: Sequence[str], k: int = 8) -> DataFrame:
    """(column, values): the cells of the first k rows in key order."""
    first = df.orderBy(*[col(c) for c in order]).limit(k)
    names = scalar_columns(df)
    numbered = first.withColumn("rk", F.row_number().over(Window.orderBy(*[col(c) for c in order])))  # k rows
    cells = [F.struct(F.lit(n).alias("column"), F.col("rk"), col(n).cast("string").alias("value")) for n in names]
    return (
        numbered.select(F.inline(F.array(*cells)))
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rk", "value"))).alias("v"))
        .select("column", F.transform("v", lambda s: s["value"]).alias("values"))
    )

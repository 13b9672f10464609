"""Normalising a table on arrival, cleaning it, and describing its schema."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import NUMBER_PATTERN, col, is_numeric, is_temporal, numeric_columns, round_half_even, string_columns


def normalize_missing(df: DataFrame) -> DataFrame:
    """Blank strings and NaN become null."""
    out = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.trim(c) != "", c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def numeric_readable(df: DataFrame) -> list[str]:
    """String columns in which every non-null value parses as a plain number."""
    names = string_columns(df)
    if not names:
        return []
    checks = []
    for i, n in enumerate(names):
        bad = col(n).isNotNull() & ~F.coalesce(F.trim(col(n)).rlike(NUMBER_PATTERN), F.lit(False))
        checks += [F.count_if(bad).alias(f"bad{i}"), F.count(col(n)).alias(f"seen{i}")]
    row = df.agg(*checks).first()
    return [n for i, n in enumerate(names) if row[f"bad{i}"] == 0 and row[f"seen{i}"] > 0]


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Cast a string column to double only if all of its non-null values parse."""
    ready = set(numeric_readable(df))
    return df.select(
        *[F.trim(col(f.name)).try_cast("double").alias(f.name) if f.name in ready else col(f.name) for f in df.schema]
    )


def stringify_categoricals(df: DataFrame) -> DataFrame:
    """Every non-numeric column as string, nulls kept."""
    return df.select(*[col(f.name) if is_numeric(f) else col(f.name).cast("string").alias(f.name) for f in df.schema])


def ingest(df: DataFrame) -> DataFrame:
    """Blanks to null, all-numeric strings to double, the rest to string."""
    return stringify_categoricals(coerce_numeric(normalize_missing(df)))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the most frequent non-null value, smallest on ties.

    Counted per value first, so no task holds all values of a column.
    """
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(
        F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("m")
    ).select("column", "m.value", "m.n")


def fill_values(df: DataFrame, digits: int | None = None) -> dict[str, object]:
    """The value each column is filled with: mean, or mode, or "MISSING"."""
    fills: dict[str, object] = {}
    numbers = numeric_columns(df)
    if numbers:
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        for i, c in enumerate(numbers):
            if row[f"m{i}"] is not None:
                fills[c] = round(row[f"m{i}"], digits) if digits is not None else row[f"m{i}"]
    words = string_columns(df)
    if words:
        found = {r["column"]: r["value"] for r in modes(df, words).collect()}  # one row per column
        for c in words:
            fills[c] = found.get(c, "MISSING")
    return fills


def impute_missing(df: DataFrame) -> DataFrame:
    """Numeric nulls become the mean, string nulls the mode (or "MISSING")."""
    fills = fill_values(df)
    out = []
    for f in df.schema:
        c = col(f.name)
        if f.name in fills:
            fill = F.lit(fills[f.name])
            out.append(F.coalesce(c.cast("double") if is_numeric(f) else c, fill).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def excluded_columns(spec: str | Iterable[str] | None) -> list[str]:
    """Names from a JSON array or a comma-separated list."""
    if spec is None:
        return []
    if not isinstance(spec, str):
        return list(spec)
    if spec.strip().startswith("["):
        return [str(s) for s in json.loads(spec)]
    return [s.strip() for s in spec.split(",") if s.strip()]


def clean_for_export(df: DataFrame, excluded: str | Iterable[str] | None = None, drop_duplicates: bool = False) -> DataFrame:
    """Drop the excluded columns, impute, optionally drop duplicate rows."""
    kept = normalize_missing(df.drop(*excluded_columns(excluded)))
    return impute_missing(kept.dropDuplicates() if drop_duplicates else kept)


def apply_cleaning(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Carry out (column, suggested_action) rows; the list has a few rows per column."""
    steps = [(r["column"], r["suggested_action"]) for r in suggestions.select("column", "suggested_action").collect()]
    drops = [c for c, a in steps if a == "drop_column" and c in df.columns]
    out = df.drop(*drops)
    if any(a == "drop_duplicates" for _, a in steps):
        out = out.dropDuplicates()
    fills = [c for c, a in steps if a == "impute_missing" and c in out.columns]
    if fills:
        values = fill_values(out.select(*[col(c) for c in fills]), digits=2)
        for c in fills:
            if c in values:
                base = col(c).cast("double") if is_numeric(out.schema[c]) else col(c)
                out = out.withColumn(c, F.coalesce(base, F.lit(values[c])))
    known = {"drop_column", "impute_missing", "drop_duplicates"}
    for c, a in steps:
        if a not in known and c in out.columns and is_numeric(out.schema[c]):
            out = out.withColumn(f"{c}_cleaned", round_half_even(col(c).cast("double"), 2))
    return out


def sanitize_result(df: DataFrame, cap: int = 1000) -> DataFrame:
    """Presentable rows: NaN and infinities null, times as text, at most `cap` rows.

    `truncated` tells whether the cap cut anything off.
    """
    out: list[Column] = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif is_temporal(f):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    one_more = df.select(*out).limit(cap + 1)
    counted = one_more.withColumn("rows_seen", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # cap + 1 rows
    return counted.withColumn("truncated", F.col("rows_seen") > cap).drop("rows_seen").limit(cap)


def schema_summary(df: DataFrame, samples: int = 3) -> DataFrame:
    """(position, column, dtype, samples): the smallest distinct values as samples.

    Each round finds every column's next larger value in one aggregate, so no
    column's values are collected or shuffled.
    """
    texts = [col(f.name).cast("string") for f in df.schema]
    found: list[list[str]] = [[] for _ in texts]
    for _ in range(samples):
        beyond = [F.min(F.when(t > F.lit(f[-1]), t) if f else t).alias(f"v{i}") for i, (t, f) in enumerate(zip(texts, found))]
        row = df.agg(*beyond).first()
        for i, f in enumerate(found):
            if row[f"v{i}"] is not None:
                f.append(row[f"v{i}"])
    rows = [(i, f.name, f.dataType.simpleString(), found[i]) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, samples array<string>")


def browse_schema(df: DataFrame) -> DataFrame:
    """(position, column, dtype, present): names and types from the schema, non-null cells counted in one scan."""
    row = df.agg(*[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema)]).first()
    rows = [(i, f.name, f.dataType.simpleString(), row[i]) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, present long")


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[col(c) for c in order]).limit(n)

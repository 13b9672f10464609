"""Chart-ready aggregates. Each returns the plotted rows as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, is_numeric, is_temporal, number_of, parse_timestamp, present
from ..functions.ranks import cumulative_counts, exact_quantiles
from .filters import apply_filters

SCATTER_POINTS = 5000
GRID = 10_000  # bins up to which every empty one is a row
WIDE = 200  # values that become columns of a grouped bar
LINE_POINTS = 2000
BOX = (0.25, 0.5, 0.75)
KDE_BINS, KDE_ORDER, KDE_REACH = 8, 7, 8.5  # bins a bandwidth, powers a bin, bandwidths that a kernel reaches


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna()


def _category(df: DataFrame, name: str) -> Column:
    return F.when(present(df, name), col(name).cast("string"))


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, correlation, slope, intercept and strength over all complete pairs."""
    vx, vy = F.var_pop("x"), F.var_pop("y")
    stats = _pairs(df, x, y).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop("x", "y"), F.sqrt(vx) * F.sqrt(vy)).alias("correlation"),
        F.try_divide(F.covar_pop("x", "y"), vx).alias("slope"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
    )
    r = F.abs("correlation")
    return stats.select(
        "n",
        "correlation",
        "slope",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.when(r > 0.7, "strong").when(r > 0.4, "moderate").when(r.isNotNull(), "weak").alias("strength"),
        F.when(F.col("correlation") > 0, "positive").when(r.isNotNull(), "negative").alias("direction"),
    )


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], points: int = SCATTER_POINTS) -> DataFrame:
    """Up to `points` pairs, chosen by a stable hash of the key, with the fitted trend."""
    fit = scatter_fit(df, x, y)
    keyed = df.select(F.xxhash64(*[col(k) for k in key]).alias("h"), number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna()
    chosen = keyed.orderBy("h", "x", "y").limit(points).drop("h")
    line = fit.select(F.struct("slope", "intercept")).scalar()
    return chosen.withColumn("fit", line).select("x", "y", (F.col("fit.slope") * F.col("x") + F.col("fit.intercept")).alias("trend"))


def _histogram(df: DataFrame, x: str, bins: int | None) -> DataFrame:
    data = df.select(number_of(df, x).alias("x")).where("x is not null")
    row = data.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = df.sparkSession
    if not row["n"]:
        return spark.createDataFrame([], "bin long, lo double, hi double, n long, peak boolean")
    lo, hi, n = row["lo"], row["hi"], row["n"]
    if bins is None:
        bins = auto_bins(n, lo, hi, exact_quantiles(data, "x", (0.25, 0.75)).first()["q"])
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("long")
    counts = data.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if bins <= GRID:
        filled = spark.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", (F.col("bin") + 1).alias("next"), F.coalesce("n", F.lit(0)).alias("n"))
    else:
        filled = _with_empty_stretches(counts, bins)
    out = filled.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(lo) + F.col("next") * F.lit(width)).alias("hi"), "n")
    top = counts.agg(F.max_by("bin", F.struct("n", (-F.col("bin")).alias("k"))))
    return out.withColumn("peak", F.col("bin") == top.scalar())


def _with_empty_stretches(counts: DataFrame, bins: int) -> DataFrame:
    """(bin, next, n): the bins with rows, and one row for each stretch of empty bins behind one of them.

    The next bin is looked for in slices of the axis; a slice hands on its first bin. The first and the last bin always hold rows.
    """
    placed = counts.withColumn("slice", F.floor(F.col("bin") / -(-bins // GRID)))
    firsts = placed.groupBy("slice").agg(F.min("bin").alias("first"))
    later = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # at most GRID rows
    handed = firsts.select("slice", F.min("first").over(later).alias("behind"))
    following = F.lead("bin").over(Window.partitionBy("slice").orderBy("bin"))
    known = placed.withColumn("follows", following).join(F.broadcast(handed), "slice").select("bin", "n", F.coalesce("follows", "behind", F.lit(bins)).alias("follows"))
    own = F.struct("bin", (F.col("bin") + 1).alias("next"), "n")
    gap = F.struct((F.col("bin") + 1).alias("bin"), F.col("follows").alias("next"), F.lit(0).cast("long").alias("n"))
    return known.select(F.inline(F.when(F.col("follows") > F.col("bin") + 1, F.array(own, gap)).otherwise(F.array(own))))


def auto_bins(n: int, lo: float, hi: float, quartiles: Sequence[float]) -> int:
    """Bin count: the finer of the Sturges and Freedman-Diaconis widths."""
    import math

    if hi == lo:
        return 1
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    diaconis = 2.0 * (quartiles[1] - quartiles[0]) * n ** (-1.0 / 3.0)
    return max(1, math.ceil((hi - lo) / (min(diaconis, sturges) if diaconis else sturges)))


def histogram(df: DataFrame, x: str) -> DataFrame:
    """(bin, lo, hi, n, peak), empty bins included; of more than GRID bins, neighbouring empty ones come as one row."""
    return _histogram(df, x, None)


def auto_histogram(df: DataFrame, x: str, bins: int = 12) -> DataFrame:
    return _histogram(df, x, bins)


def boxplot(df: DataFrame, x: str, by: str | None = None) -> DataFrame:
    """(group, min, q1, median, q3, max), highest median first when grouped."""
    group = F.lit(x) if by is None else _category(df, by)
    data = df.select(group.alias("group"), number_of(df, x).alias("x")).dropna()
    ends = data.groupBy("group").agg(F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(data, "x", BOX, ["group"])
    out = ends.join(q, "group").select(
        "group", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max"
    )
    return out if by is None else out.orderBy(F.desc("median"), "group")


def box_segments(box: DataFrame) -> DataFrame:
    """Stacked-bar lengths of a box plot: base, lower whisker, two box halves, upper whisker."""
    return box.select(
        "group",
        F.col("min").alias("base"),
        (F.col("q1") - F.col("min")).alias("whisker_low"),
        (F.col("median") - F.col("q1")).alias("box_low"),
        (F.col("q3") - F.col("median")).alias("box_high"),
        (F.col("max") - F.col("q3")).alias("whisker_high"),
    )


def kde(df: DataFrame, x: str, points: int = 100) -> DataFrame:
    """(i, x, density): Gaussian density on an even grid, bandwidth 1.06 s n^-0.2.

    Values are counted into bins of an eighth of the bandwidth, each with the
    sums of the first powers of the values' distances to its middle, so the only
    shuffle is one row per task and bin that holds a value. A bin then stands
    for its values by the Taylor series of the kernel about its middle and meets
    only the grid points within REACH bandwidths. Beside the rounding of sums, an
    error of at most (1/16)^8 / sqrt(8!) + exp(-REACH^2 / 2), under 2e-12, of a
    kernel's height remains. Fewer than two values: no rows.
    """
    data = df.select(number_of(df, x).alias("v")).where("v is not null")
    row = data.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("s")).first()
    if row["n"] < 2:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    n, lo, hi = row["n"], row["lo"], row["hi"]
    width = 1.06 * (row["s"] or 1.0) * n ** -0.2
    step = (hi - lo) / (points - 1)
    place = (F.col("v") - F.lit(lo)) / F.lit(width)
    spot = data.select(F.floor(place * KDE_BINS).alias("bin"), place.alias("p")).select("bin", (F.col("p") - (F.col("bin") + 0.5) / KDE_BINS).alias("d"))
    powers = [F.lit(1.0)]
    for _ in range(KDE_ORDER):
        powers.append(powers[-1] * F.col("d"))
    bins = spot.groupBy("bin").agg(*[F.sum(power).alias(f"m{k}") for k, power in enumerate(powers)])
    middle = bins.withColumn("c", (F.col("bin") + 0.5) / KDE_BINS)
    gap = step / width  # between grid points, in bandwidths
    if gap > 0:
        near = F.sequence(
            F.greatest(F.lit(0), F.ceil((F.col("c") - KDE_REACH) / gap).cast("int")), F.least(F.lit(points - 1), F.floor((F.col("c") + KDE_REACH) / gap).cast("int"))
        )
        # a bin between two far grid points reaches neither
        some = F.ceil((F.col("c") - KDE_REACH) / gap) <= F.floor((F.col("c") + KDE_REACH) / gap)
        near = F.when(some, near)
    else:
        near = F.sequence(F.lit(0), F.lit(points - 1))
    z = F.col("i") * F.lit(gap) - F.col("c")
    series, before, hermite, factorial = F.col("m0"), F.lit(0.0), F.lit(1.0), 1
    reached = middle.withColumn("i", F.explode(near)).withColumn("z", z)
    for k in range(1, KDE_ORDER + 1):
        before, hermite = hermite, F.col("z") * hermite - (k - 1) * before
        reached = reached.withColumn(f"h{k}", hermite)
        before, hermite = (F.col(f"h{k - 1}") if k > 1 else F.lit(1.0)), F.col(f"h{k}")
        factorial *= k
        series = series + hermite * F.col(f"m{k}") / factorial
    sums = reached.groupBy("i").agg(F.sum(F.exp(-0.5 * F.col("z") * F.col("z")) * series).alias("k"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    density = F.greatest(F.coalesce("k", F.lit(0.0)), F.lit(0.0)) / F.lit(n * width * (2 * 3.141592653589793) ** 0.5)
    return grid.join(F.broadcast(sums), "i", "left").select("i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), density.alias("density"))


def bar(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value): mean per category, largest first."""
    data = df.select(_category(df, category).alias("category"), number_of(df, value).alias("v")).dropna()
    return data.groupBy("category").agg(F.avg("v").alias("value")).orderBy(F.desc("value"), "category")


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    data = df.select(_category(df, a).alias("a"), _category(df, b).alias("b")).dropna()
    return data.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def heatmap(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, count) for every combination of the values of both, empty ones included."""
    counts = _pair_counts(df, a, b)
    # the chart has a cell for every combination, so this product is its size
    grid = counts.select("a").distinct().crossJoin(counts.select("b").distinct())
    return grid.join(counts, ["a", "b"], "left").select(F.col("a").alias("x"), F.col("b").alias("y"), F.coalesce("n", F.lit(0)).alias("count"))


def grouped_bar(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row per value of a, one count column per value of b: the values of b become names.

    With more than WIDE values of b the counts come in long form: (name, value, n).
    """
    counts = _pair_counts(df, a, b)
    values = [r["b"] for r in counts.select("b").distinct().orderBy("b").limit(WIDE + 1).collect()]
    if len(values) > WIDE:
        return counts.select(F.col("a").alias("name"), F.col("b").alias("value"), "n")
    return counts.groupBy("a").pivot("b", values).agg(F.sum("n")).fillna(0).withColumnRenamed("a", "name")


def line(df: DataFrame, x: str, y: str, points: int = LINE_POINTS) -> DataFrame:
    """(position, x, y) in x order, thinned evenly to about `points` rows.

    Equal (x, y) rows are counted first; the global position of each pair
    comes from distributed prefix counts, so nothing sorts in one task.
    """
    field = df.schema[x]
    if is_temporal(field):
        at = col(x).cast("timestamp_ntz")
    elif is_numeric(field):
        at = number_of(df, x)
    else:
        at = parse_timestamp(col(x))
    counts = (
        df.select(F.struct(at.alias("x"), number_of(df, y).alias("y")).alias("p"))
        .where("p.x is not null and p.y is not null")
        .groupBy("p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = cumulative_counts(counts, [], "p")
    step = F.when(F.col("total") > points, F.floor(F.col("total") / points)).otherwise(F.lit(1))
    first = F.ceil(F.col("below") / step) * step
    last = F.col("below") + F.col("n") - 1
    kept = placed.where(first <= last).select("p", F.explode(F.sequence(first, last, step)).alias("position"))
    return kept.select("position", "p.x", "p.y")


def line_direction(points: DataFrame) -> DataFrame:
    """One row: whether the last plotted point lies above the first."""
    return points.agg(
        F.when(F.max_by("y", "position") > F.min_by("y", "position"), "increasing").otherwise("decreasing").alias("direction")
    )


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.select(_category(df, name).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("value"))


def pie(df: DataFrame, name: str, keep: int = 8, most: int = 50) -> DataFrame:
    """(name, value, pct): the `keep` largest categories and the rest as Other."""
    counts = _counts(df, name)
    kinds = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("value"), F.lit(0)).alias("t")).first()
    if kinds["k"] > most:
        raise ValueError(f"{name!r} has more than {most} distinct values")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "name")  # at most `most` rows
    ranked = counts.withColumn("rk", F.row_number().over(order))
    label = F.when(F.col("rk") <= keep, F.col("name")).otherwise("Other")
    merged = ranked.groupBy(label.alias("name"), F.least("rk", F.lit(keep + 1)).alias("rk")).agg(F.sum("value").alias("value"))
    return merged.select("name", "value", F.round(F.col("value") * 100.0 / F.lit(kinds["t"]), 1).alias("pct"))


def treemap(df: DataFrame, name: str, size: str | None = None, keep: int = 20) -> DataFrame:
    """(name, value): counts, or sums of `size`, of the largest categories."""
    if size is None:
        sized = _counts(df, name).withColumn("value", F.col("value").cast("double"))
    else:
        if not is_numeric(df.schema[size]):
            raise ValueError("the size column must be numeric")
        sized = (
            df.select(_category(df, name).alias("name"), number_of(df, size).alias("v"))
            .where("name is not null")
            .groupBy("name")
            .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
        )
    return sized.orderBy(F.desc("value"), "name").limit(keep)


def funnel(df: DataFrame, name: str, keep: int = 10) -> DataFrame:
    """(stage, value): the most frequent categories, largest first."""
    if is_numeric(df.schema[name]):
        raise ValueError("a funnel needs a categorical column")
    return _counts(df, name).select(F.col("name").alias("stage"), "value").orderBy(F.desc("value"), "stage").limit(keep)


def waterfall(df: DataFrame, name: str, delta: str, keep: int = 15) -> DataFrame:
    """(name, start, end, delta): running total over the first `keep` keys."""
    if not is_numeric(df.schema[delta]):
        raise ValueError("the delta column must be numeric")
    sums = (
        df.select(_category(df, name).alias("name"), number_of(df, delta).alias("v"))
        .where("name is not null")
        .groupBy("name")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("delta"))
        .orderBy("name")
        .limit(keep)
    )
    run = Window.partitionBy(F.lit(0)).orderBy("name").rowsBetween(Window.unboundedPreceding, 0)  # `keep` rows
    return sums.withColumn("end", F.sum("delta").over(run)).select("name", (F.col("end") - F.col("delta")).alias("start"), "end", "delta")


def gauge(df: DataFrame, x: str) -> DataFrame:
    if not is_numeric(df.schema[x]):
        raise ValueError("a gauge needs a numeric column")
    return df.select(number_of(df, x).alias("x")).agg(F.avg("x").alias("value"), F.min("x").alias("min"), F.max("x").alias("max"))


def top_categories(df: DataFrame, name: str, keep: int = 8, width: int | None = None) -> DataFrame:
    """(name, value): the most frequent values; `width` shortens the label."""
    top = _counts(df, name).orderBy(F.desc("value"), "name").limit(keep)
    return top if width is None else top.withColumn("name", F.substring("name", 1, width))


def monthly_line(df: DataFrame, moment: str, value: str, least: int = 3) -> DataFrame:
    """(month, value): mean per calendar month, empty below `least` months."""
    at = col(moment) if is_temporal(df.schema[moment]) else parse_timestamp(col(moment))
    months = (
        df.select(F.date_format(at, "yyyy-MM").alias("month"), number_of(df, value).alias("v"))
        .dropna()
        .groupBy("month")
        .agg(F.avg("v").alias("value"))
    )
    return months.where(months.agg(F.count(F.lit(1)) >= least).scalar())


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def missing_widget(profile: DataFrame, keep: int = 10) -> DataFrame:
    """(name, missing_pct): the columns with the largest share of gaps."""
    return profile.where("missing > 0").select("name", "missing_pct").orderBy(F.desc("missing_pct"), "name").limit(keep)


# chart type -> (needs a second column, function of (df, x, y, key))
CHARTS = {
    "scatter": (True, lambda df, a, b, key: scatter(df, a, b, key or [a, b])),
    "histogram": (False, lambda df, a, b, key: histogram(df, a)),
    "boxplot": (False, lambda df, a, b, key: boxplot(df, a) if b is None else boxplot(df, b, a)),
    "kde": (False, lambda df, a, b, key: kde(df, a)),
    "bar": (True, lambda df, a, b, key: bar(df, a, b)),
    "heatmap": (True, lambda df, a, b, key: heatmap(df, a, b)),
    "grouped_bar": (True, lambda df, a, b, key: grouped_bar(df, a, b)),
    "line": (True, lambda df, a, b, key: line(df, a, b)),
    "pie": (False, lambda df, a, b, key: pie(df, a)),
    "donut": (False, lambda df, a, b, key: pie(df, a)),
    "treemap": (False, lambda df, a, b, key: treemap(df, a, b)),
    "funnel": (False, lambda df, a, b, key: funnel(df, a)),
    "waterfall": (True, lambda df, a, b, key: waterfall(df, a, b)),
    "gauge": (False, lambda df, a, b, key: gauge(df, a)),
}


def chart(
    df: DataFrame,
    chart_type: str,
    col1: str,
    col2: str | None = None,
    filters: Sequence[Mapping[str, Any]] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """Rows of one chart after the filters; filters reach the scan as predicates."""
    if chart_type not in CHARTS:
        raise ValueError(f"unknown chart type {chart_type!r}")
    needs_second, make = CHARTS[chart_type]
    for c in [col1] + ([col2] if col2 else []):
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    if needs_second and col2 is None:
        raise ValueError(f"{chart_type} needs a second column")
    return make(apply_filters(df, filters), col1, col2, list(key))


def insight(data: DataFrame, chart_type: str) -> DataFrame:
    """One row, one sentence, from the rows of a chart (at most a few thousand)."""
    say = F.format_string
    if chart_type == "scatter":
        r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
        return data.agg(r.alias("r")).select(F.coalesce(say("Correlation of the two columns is %.2f.", "r"), F.lit("No linear correlation.")).alias("insight"))
    if chart_type == "histogram":
        return data.where("peak").select(say("Most values lie between %.2f and %.2f.", "lo", "hi").alias("insight"))
    if chart_type == "boxplot":
        top = F.max_by(F.struct("group", "median"), F.struct("median"))
        return data.agg(top.alias("t")).select(say("Highest median: %s with %.2f.", "t.group", "t.median").alias("insight"))
    if chart_type == "kde":
        return data.agg(F.max_by("x", "density").alias("x")).select(say("Density peaks near %.2f.", "x").alias("insight"))
    if chart_type == "heatmap":
        top = F.max_by(F.struct("x", "y", "count"), F.struct("count"))
        return data.agg(top.alias("t")).select(say("Most frequent pair: %s and %s, %d rows.", "t.x", "t.y", "t.count").alias("insight"))
    if chart_type == "line":
        return line_direction(data).select(say("Overall trend is %s.", "direction").alias("insight"))
    if chart_type == "gauge":
        return data.select(say("Average %.2f within %.2f to %.2f.", "value", "min", "max").alias("insight"))
    if chart_type == "waterfall":
        return data.agg(F.max_by("end", "name").alias("e")).select(say("The running total ends at %.2f.", "e").alias("insight"))
    if chart_type == "grouped_bar":
        return data.agg(F.count(F.lit(1)).alias("n")).select(say("%d categories compared.", "n").alias("insight"))
    label = {"bar": "category", "funnel": "stage"}.get(chart_type, "name")
    top = F.max_by(F.struct(F.col(label).alias("l"), F.col("value").cast("double").alias("v")), F.struct("value"))
    return data.agg(top.alias("t")).select(say("Largest: %s with %.2f.", "t.l", "t.v").alias("insight"))

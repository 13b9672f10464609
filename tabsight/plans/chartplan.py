"""Which charts fit which columns, from the profile alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Chart types by the kinds of one or two columns.
SINGLE = (
    ("numeric", ("histogram", "kde", "boxplot", "gauge")),
    ("few", ("pie", "donut", "treemap", "funnel")),
    ("many", ("treemap", "funnel")),
)
PAIRS = (
    ("numeric", "numeric", ("scatter", "line")),
    ("date", "numeric", ("line",)),
    ("other", "other", ("grouped_bar", "heatmap")),
    ("category", "numeric", ("bar", "boxplot", "waterfall", "treemap")),
)
FEW_VALUES = 50


def _arrays(types) -> F.Column:
    return F.array(*[F.lit(t) for t in types])


def chart_plan(profile: DataFrame, pairs: bool = True) -> DataFrame:
    """(chart_type, col1, col2): every chart that makes sense for a column or a pair.

    Mixed pairs come with the number second; a date counts as a category too. The profile has one row
    per column, so pairing it with itself is bounded by the width of the table.
    """
    numeric, date = F.col("type") == "numeric", F.col("type") == "datetime"
    kinds = profile.select("pos", "name", "type", "unique", numeric.alias("num"), date.alias("date"))
    single = kinds.select(
        F.explode(
            F.when(F.col("num"), _arrays(SINGLE[0][1])).when(F.col("unique") <= FEW_VALUES, _arrays(SINGLE[1][1])).otherwise(_arrays(SINGLE[2][1]))
        ).alias("chart_type"),
        F.col("name").alias("col1"),
        F.lit(None).cast("string").alias("col2"),
    )
    if not pairs:
        return single
    # one array of all columns on every row: width x width rows
    others = profile.agg(F.collect_list(F.struct("pos", "name", "type"))).scalar()
    both = kinds.withColumn("other", F.explode(others)).where("pos <> other.pos")
    second = F.col("other.type") == "numeric"
    ordered = F.col("pos") < F.col("other.pos")
    types = F.flatten(
        F.array(
            F.when(F.col("num") & second & ordered, _arrays(PAIRS[0][2])).otherwise(F.array().cast("array<string>")),
            F.when(F.col("date") & second, _arrays(PAIRS[1][2])).otherwise(F.array().cast("array<string>")),
            F.when(~F.col("num") & ~second & ordered, _arrays(PAIRS[2][2])).otherwise(F.array().cast("array<string>")),
            F.when(~F.col("num") & second, _arrays(PAIRS[3][2])).otherwise(F.array().cast("array<string>")),
        )
    )
    double = both.select(F.explode(types).alias("chart_type"), F.col("name").alias("col1"), F.col("other.name").alias("col2"))
    return single.unionByName(double)


def _nth(profile: DataFrame) -> DataFrame:
    """Columns with their order within their type."""
    return profile.select("pos", "name", "type", F.row_number().over(Window.partitionBy("type").orderBy("pos")).alias("nth"))


def _first_two(profile: DataFrame) -> DataFrame:
    """One row: the first numeric, categorical and date columns by name."""
    pick = lambda t, k: F.max(F.when((F.col("type") == t) & (F.col("nth") == k), F.col("name")))
    return _nth(profile).agg(
        pick("numeric", 1).alias("n1"), pick("numeric", 2).alias("n2"), pick("categorical", 1).alias("c1"),
        pick("categorical", 2).alias("c2"), pick("datetime", 1).alias("d1"),
    )


def _rows(one: DataFrame, *charts) -> DataFrame:
    row = lambda when, kind, a, b: F.when(when, F.struct(F.lit(kind).alias("chart_type"), a.alias("col1"), b.alias("col2")))
    return one.select(F.inline(F.array_compact(F.array(*[row(*c) for c in charts]))))


def auto_charts(profile: DataFrame) -> DataFrame:
    """Two histograms, two category bars, a time line, a scatter and the correlations."""
    one, none = _first_two(profile), F.lit(None).cast("string")
    n1, n2, c1, c2, d1 = (F.col(c) for c in ("n1", "n2", "c1", "c2", "d1"))
    return _rows(
        one,
        (n1.isNotNull(), "auto_histogram", n1, none),
        (n2.isNotNull(), "auto_histogram", n2, none),
        (c1.isNotNull(), "top_categories", c1, none),
        (c2.isNotNull(), "top_categories", c2, none),
        (d1.isNotNull() & n1.isNotNull(), "monthly_line", d1, n1),
        (n2.isNotNull(), "quick_scatter", n1, n2),
        (n2.isNotNull(), "correlation", none, none),
    )


def default_dashboard(profile: DataFrame) -> DataFrame:
    """Histogram, pie, scatter and bar of the first fitting columns."""
    one, none = _first_two(profile), F.lit(None).cast("string")
    n1, n2, c1 = (F.col(c) for c in ("n1", "n2", "c1"))
    return _rows(
        one,
        (n1.isNotNull(), "histogram", n1, none),
        (c1.isNotNull(), "pie", c1, none),
        (n2.isNotNull(), "scatter", n1, n2),
        (c1.isNotNull() & n1.isNotNull(), "bar", c1, n1),
    )

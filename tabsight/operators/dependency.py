"""Pearson, Spearman and mutual-information dependency between numeric columns."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import number_of, numeric_columns
from ..functions.ranks import column_quantiles, row_ranks
from ..session import materialize

# Pairs per aggregate: a wider table is scanned once per this many pairs.
PAIRS_PER_SCAN = 120


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[number_of(df, c).alias(f"x{i}") for i, c in enumerate(columns)])


def _correlation(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation, 0 where a side does not vary."""
    sa = F.stddev_pop(F.when(b.isNotNull(), a))
    sb = F.stddev_pop(F.when(a.isNotNull(), b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), sa * sb), F.lit(0.0))


def _pair_matrix(data: DataFrame, columns: Sequence[str], left, right, name: str, min_pairs: int) -> DataFrame:
    """(i, j, col_a, col_b, value) for all i < j, all pairs in one aggregate row per chunk."""
    pairs = list(itertools.combinations(range(len(columns)), 2))
    frames = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        chunk = pairs[start : start + PAIRS_PER_SCAN]
        aggs = []
        for k, (i, j) in enumerate(chunk):
            a, b = F.col(left(i, j)), F.col(right(i, j))
            value = _correlation(a, b)
            if min_pairs > 0:
                value = F.when(F.count(F.when(a.isNotNull(), b)) >= min_pairs, value).otherwise(F.lit(0.0))
            aggs.append(value.alias(f"v{k}"))
        rows = [
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("col_a"), F.lit(columns[j]).alias("col_b"), F.col(f"v{k}").alias(name))
            for k, (i, j) in enumerate(chunk)
        ]
        frames.append(data.agg(*aggs).select(F.inline(F.array(*rows))))
    return functools.reduce(DataFrame.unionByName, frames)


def pearson(df: DataFrame, columns: Sequence[str] | None = None, min_pairs: int = 0, max_cols: int | None = None) -> DataFrame:
    """(i, j, col_a, col_b, pearson) for every pair i < j; needs two numeric columns."""
    names = list(columns or numeric_columns(df))[:max_cols]
    if len(names) < 2:
        raise ValueError("dependency needs at least two numeric columns")
    return _pair_matrix(_numbers(df, names), names, lambda i, j: f"x{i}", lambda i, j: f"x{j}", "pearson", min_pairs)


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(i, j, col_a, col_b, spearman): Pearson of average ranks on pairwise-complete rows.

    A column is ranked once; only a partner with nulls asks for a ranking of
    its own. All cells travel twice, whatever the number of columns: once into slices
    of (column, value), where they are ranked, and once back to their row.
    """
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("dependency needs at least two numeric columns")
    k = len(names)
    data = materialize(_numbers(df, names).withColumn("id", F.monotonically_increasing_id()))  # the numbers must not change
    gaps = data.agg(*[F.count_if(F.col(f"x{i}").isNull()).alias(f"g{i}") for i in range(k)]).first()
    partner = lambda j: j if gaps[f"g{j}"] else -1
    groups = sorted({(i, partner(j)) for i in range(k) for j in range(k) if i != j})
    cells = []
    for g, (i, p) in enumerate(groups):
        value = F.col(f"x{i}") if p < 0 else F.when(F.col(f"x{p}").isNotNull(), F.col(f"x{i}"))
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(g).alias("g"), value.alias("v"))))
    long = data.select("id", F.inline(F.array_compact(F.array(*cells))))
    rows = row_ranks(long).groupBy("id").agg(*[F.max(F.when(F.col("g") == g, F.col("rank"))).alias(f"r{g}") for g in range(len(groups))])
    at = {pair: g for g, pair in enumerate(groups)}
    return _pair_matrix(
        rows, names, lambda i, j: f"r{at[(i, partner(j))]}", lambda i, j: f"r{at[(j, partner(i))]}", "spearman", 0
    )


def mutual_information(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(source, target, mi): plug-in mutual information of quantile-binned columns.

    Gaps are filled with the column mean first. Every ordered pair is listed;
    the diagonal is 1 by definition.
    """
    names = list(columns or numeric_columns(df))
    k = len(names)
    data = _numbers(df, names)
    means = data.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    data = data.select(*[F.coalesce(F.col(f"x{i}"), F.lit(means[f"x{i}"])).alias(f"x{i}") for i in range(k)])
    probs = [b / bins for b in range(1, bins)]
    edges = {int(r["column"][1:]): r["q"] for r in column_quantiles(data, data.columns, probs).collect()}
    binned = data.select(
        *[sum((F.when(F.col(f"x{i}") > e, 1).otherwise(0) for e in sorted(set(edges[i]))), F.lit(0)).alias(f"b{i}") for i in range(k)]
    )
    pairs = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{i}").alias("a"), F.col(f"b{j}").alias("b"))
        for i, j in itertools.combinations(range(k), 2)
    ]
    # at most bins x bins rows per pair leave each task
    joint = binned.select(F.inline(F.array(*pairs))).groupBy("i", "j", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    pair = Window.partitionBy("i", "j")
    terms = joint.select(
        "i",
        "j",
        "n",
        F.sum("n").over(pair).alias("t"),
        F.sum("n").over(Window.partitionBy("i", "j", "a")).alias("na"),
        F.sum("n").over(Window.partitionBy("i", "j", "b")).alias("nb"),
    )
    mi = terms.groupBy("i", "j").agg(
        F.greatest(
            F.lit(0.0), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t").cast("double") / (F.col("na") * F.col("nb").cast("double"))))
        ).alias("mi")
    )
    label = F.array(*[F.lit(n) for n in names])
    both = mi.select(F.inline(F.array(F.struct(F.col("i"), F.col("j"), F.col("mi")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("mi")))))
    diagonal = df.sparkSession.createDataFrame([(i, i, 1.0) for i in range(k)], "i int, j int, mi double")
    return both.unionByName(diagonal).select(label[F.col("i")].alias("source"), label[F.col("j")].alias("target"), "mi")


def dependency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, pearson, spearman, mi) for every pair of numeric columns."""
    p, s, m = pearson(df, columns), spearman(df, columns), mutual_information(df, columns)
    m = m.select(F.col("source").alias("col_a"), F.col("target").alias("col_b"), "mi")
    return p.join(s.select("col_a", "col_b", "spearman"), ["col_a", "col_b"]).join(m, ["col_a", "col_b"])


def top_correlations(matrix: DataFrame, value: str, threshold: float = 0.4, limit: int = 10) -> DataFrame:
    """The first pairs, in column order, whose absolute value exceeds the threshold."""
    strong = matrix.where(F.abs(value) > threshold).orderBy("i", "j").limit(limit)
    return strong.select("col_a", "col_b", F.round(value, 4).alias("correlation"))


def top_mutual_information(matrix: DataFrame, threshold: float = 0.1, limit: int = 10) -> DataFrame:
    strong = matrix.where((F.col("source") != F.col("target")) & (F.col("mi") > threshold))
    return strong.select("source", "target", F.round("mi", 4).alias("score")).orderBy(F.desc("score"), "source", "target").limit(limit)


def normalized_mutual_information(matrix: DataFrame) -> DataFrame:
    """Scores as a share of the largest off-diagonal one (matrix of columns, not rows)."""
    off = matrix.where("source <> target")
    return off.withColumn("share", F.try_divide("mi", off.agg(F.max("mi")).scalar()))

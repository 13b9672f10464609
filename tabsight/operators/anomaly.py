"""Isolation forest over mixed columns, with the columns that drive each anomaly.

Liu, Ting and Zhou, "Isolation Forest" (2008). A tree is grown from at most
256 rows, so building is one small task per tree; scoring is a narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, number_of, present
from ..functions.ranks import column_quantiles, exact_quantiles
from ..session import materialize
from .prep import fill_rows, split_columns

TREES, SAMPLE = 100, 256
RARE = 0.05  # a category below this share counts as a driver
NODE_SCHEMA = "tree int, node int, feature int, number double, category string, left int, right int, size int, depth int"


def average_depth(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + 0.5772156649015329) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(rows: list[np.ndarray], numeric: int, rng: np.random.Generator, limit: int):
    """Random splits: a feature that still varies, then a cut inside its range (or one category against the rest)."""
    nodes = []

    def add(index: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        choices = []
        if depth < limit and len(index) > 1:
            for f, values in enumerate(rows):
                part = values[index]
                if f < numeric:
                    if part.min() < part.max():
                        choices.append((f, None))
                else:
                    kinds = np.unique(part)
                    if len(kinds) > 1:
                        choices += [(f, k) for k in kinds]
        if not choices:
            nodes[me] = (-1, 0.0, None, -1, -1, len(index), depth)
            return me
        f, kind = choices[rng.integers(len(choices))]
        part = rows[f][index]
        if kind is None:
            cut = float(rng.uniform(part.min(), part.max()))
            goes_left = part <= cut
            if goes_left.all():  # the cut fell on the largest value
                goes_left = part < part.max()
        else:
            cut, goes_left = 0.0, part != kind
        left, right = add(index[goes_left], depth + 1), add(index[~goes_left], depth + 1)
        nodes[me] = (f, cut, kind, left, right, len(index), depth)
        return me

    add(np.arange(len(rows[0])), 0)
    return nodes


def _sampled(df: DataFrame, keys: Sequence[str], n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows tagged with the tree they feed; expected group size is a little above `sample`.

    Every row draws as often as the table is smaller than what the trees want,
    once in a larger table; a draw is used or not by one hash, and goes to a
    tree by another.
    """
    key = [col(k) for k in keys]
    span = 1 << 40
    want = trees * sample * 1.5
    draws = max(1, math.ceil(want / n))
    kept = int(span * min(1.0, want / n / draws))
    tree = lambda j: F.pmod(F.xxhash64(*key, j, F.lit(seed + 1)), F.lit(trees)).cast("int")
    picks = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: F.when(F.pmod(F.xxhash64(*key, j, F.lit(seed)), F.lit(span)) < kept, tree(j)))
    return df.withColumn("tree", F.explode(F.array_distinct(F.array_compact(picks))))


def isolation_scores(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """The table with `score` in (0, 1); higher is more unusual."""
    numeric, categorical = split_columns(df, columns)
    ordered = numeric + categorical
    n = df.count()
    if n == 0:
        return df.withColumn("score", F.lit(None).cast("double"))
    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    filled = fill_rows(df, columns)
    tagged = _sampled(filled.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(c) for c in ordered]), [f"__k{i}" for i in range(len(keys))], n, trees, size, seed)
    tagged = tagged.select("tree", F.xxhash64(*[f"__k{i}" for i in range(len(keys))], "tree", F.lit(seed + 2)).alias("__o"), *[col(c) for c in ordered])
    k = len(numeric)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__o", *ordered]).head(size)
        tree = int(group["tree"].iloc[0])
        rows = [group[c].to_numpy(float) if i < k else group[c].to_numpy(str) for i, c in enumerate(ordered)]
        nodes = _grow(rows, k, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "number", "category", "left", "right", "size", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    # at most trees * (2 * sample - 1) short rows
    nodes = tagged.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas().sort_values(["tree", "node"])
    forest = []
    for _, t in nodes.groupby("tree"):
        leaf = t["depth"].to_numpy(float) + average_depth(t["size"].to_numpy(float))
        forest.append((t["feature"].to_numpy(), t["number"].to_numpy(), t["category"].to_numpy(object), t["left"].to_numpy(), t["right"].to_numpy(), leaf))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = float(average_depth(size)) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        grown = shared.value
        for batch in batches:
            data = [batch[c].to_numpy(float) if i < k else batch[c].to_numpy(object) for i, c in enumerate(ordered)]
            total = np.zeros(len(batch))
            for feature, number, category, left, right, leaf in grown:
                at = np.zeros(len(batch), dtype=int)
                while True:
                    f = feature[at]
                    if (f < 0).all():
                        break
                    step = at.copy()
                    for i in np.unique(f[f >= 0]):
                        here = f == i
                        spot = at[here]
                        go_left = data[i][here] <= number[spot] if i < k else data[i][here] != category[spot]
                        step[here] = np.where(go_left, left[spot], right[spot])
                    at = step
                total += leaf[at]
            yield pd.Series(np.power(2.0, -total / len(grown) / scale))

    # the original cells, gaps included, ride along beside the filled ones
    rest = [c for c in df.columns if c not in ordered]
    raw = df.select(*[col(c) for c in rest], *[col(c) for c in ordered], F.struct(*[col(c) for c in ordered]).alias("__raw"))
    scored = fill_rows(raw, columns).withColumn("score", score(F.struct(*[col(c) for c in ordered])))
    return scored.select(*[F.col("__raw")[c].alias(c) if c in ordered else col(c) for c in df.columns], "score")


def flag_anomalies(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Rows whose score lies strictly above the 1 - contamination quantile."""
    cut = exact_quantiles(scored, "score", [1.0 - contamination]).select(F.col("q")[0])
    return scored.where(F.col("score") > cut.scalar())


def drivers(flagged: DataFrame, table: DataFrame, columns: Sequence[str], most: int = 3) -> DataFrame:
    """Add `drivers`: the columns in which a row is most unusual, with value and deviation.

    Numbers: distance from the median in interquartile ranges. Categories:
    rarity below 5 %, scaled to at most 3. Frequencies join by value, and only
    the rare values are kept on that side.
    """
    numeric, categorical = split_columns(table, columns)
    out, parts = flagged, []
    if numeric:
        spread = {r["column"]: r["q"] for r in column_quantiles(table, numeric, [0.25, 0.5, 0.75]).collect()}
        stds = table.agg(*[F.stddev_samp(number_of(table, c)).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            if c not in spread:
                continue
            q1, median, q3 = spread[c]
            std = stds[f"s{i}"] or 0.0
            width = q3 - q1 if q3 - q1 >= 1e-6 else (std if std > 1e-6 else 1e-6)
            deviation = F.abs(number_of(flagged, c) - F.lit(median)) / F.lit(width)
            parts.append((c, deviation, "numeric"))
    for i, c in enumerate(categorical):
        counts = table.where(present(table, c)).groupBy(col(c).cast("string").alias(f"__v{i}")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).scalar()
        rare = counts.select(f"__v{i}", (F.col("n") / total).alias(f"__f{i}")).where(F.col(f"__f{i}") < RARE)
        out = out.join(rare, col(c).cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        parts.append((c, (RARE - F.col(f"__f{i}")) / RARE * 3.0, "categorical"))
    entries = [
        F.when(
            d.isNotNull(),
            F.struct((-d).alias("k"), F.lit(c).alias("column"), col(c).cast("string").alias("value"), d.alias("deviation"), F.lit(kind).alias("kind")),
        )
        for c, d, kind in parts
    ]
    best = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, most)
    named = F.transform(best, lambda e: F.struct(e["column"].alias("column"), e["value"].alias("value"), e["deviation"].alias("deviation"), e["kind"].alias("kind")))
    return out.withColumn("drivers", named).drop(*[f"__f{i}" for i in range(len(categorical))])


def detect_anomalies(df: DataFrame, columns: Sequence[str], keys: Sequence[str], contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Flagged rows with score and drivers, most unusual first."""
    scored = materialize(isolation_scores(df, columns, keys, seed=seed))  # scored once, read twice
    return drivers(flag_anomalies(scored, contamination), df, columns).orderBy(F.desc("score"), *[col(k) for k in keys])

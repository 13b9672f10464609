"""k-means for many values of k and many restarts at once.

Every round is one scan for all models together: a task assigns its rows to the
stacked centres of all models by one matrix product and ships a count, a cost
and a sum for each (model, cluster). Models that have settled leave the stack.

Seeds come from all rows too: each step draws 2k rows of a model with chances
by their squared distance to the centres so far (the rows with the least
-ln(u) / distance, u from a hash of the row and the model), every row is
counted at its nearest seed, and the weighted seeds become k centres on the
driver. The draws depend on the rows' values alone, not on their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col
from ..session import spread_rows

ROUNDS = 50
MOVED = 1e-4  # centres that all move less have settled
STEPS = 2  # draws of seeds after the first
EQUAL = 1e-12  # squared distance, as a share of the squared length, up to which rows count as equal when seeds are drawn
CELLS = 1 << 22  # numbers of one distance matrix


@dataclass
class Model:
    k: int
    restart: int
    centers: np.ndarray
    cost: float = 0.0
    sizes: np.ndarray | None = None


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """One column `x`, the vector as an array; every round scans the rows, so all cores get a share of them."""
    kind = df.schema[features].dataType.typeName()
    values = col(features) if kind == "array" else vector_to_array(col(features))
    return spread_rows(df.select(values.cast("array<double>").alias("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            step = max(1, CELLS // max(width, x.shape[1]))
            for at in range(0, len(x), step):
                yield x[at : at + step]


def square_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T, 0.0)


def _apart(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre, zero where it is no more than rounding."""
    d = square_distances(x, centers).min(axis=1)
    return np.where(d > EQUAL * (x**2).sum(axis=1), d, 0.0)


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row, from its values and the seed."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((x + 0.0).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def _draw(rows: DataFrame, held: list[np.ndarray], wanted: list[int], seeds: list[int]) -> list[np.ndarray]:
    """For each model `wanted` different rows, drawn by squared distance to the centres it holds (evenly if none)."""
    width = max(1, sum(len(h) for h in held))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[float, np.ndarray]] = [{} for _ in held]
        for x in _chunks(batches, width):
            for m, (centers, n) in enumerate(zip(held, wanted)):
                weight = _apart(x, centers) if len(centers) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key, at = np.unique(-np.log(_uniform(x, seeds[m])) / weight, return_index=True)  # copies share a key
                found = best[m]
                for k, i in zip(key[:n].tolist(), at[:n].tolist()):
                    if np.isfinite(k):
                        found.setdefault(k, x[i])
                if len(found) > n:
                    best[m] = {k: found[k] for k in sorted(found)[:n]}
        flat = [(m, k, v.tolist()) for m, found in enumerate(best) for k, v in found.items()]
        columns = [pa.array(c, t) for c, t in zip(zip(*flat) if flat else ([], [], []), (pa.int32(), pa.float64(), pa.list_(pa.float64())))]
        yield pa.record_batch(columns, names=["model", "key", "x"])

    order = Window.partitionBy("model").orderBy("key")
    drawn = rows.mapInArrow(draw, "model int, key double, x array<double>").dropDuplicates(["model", "key"])
    drawn = drawn.withColumn("no", F.row_number().over(order)).where(F.col("no") <= max(wanted))
    out: list[list] = [[] for _ in held]
    for r in drawn.orderBy("model", "no").collect():  # at most max(wanted) rows a model
        if r["no"] <= wanted[r["model"]]:
            out[r["model"]].append(r["x"])
    return [np.array(x, float) for x in out]


def _sums(rows: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """For each model the rows, the cost and the sum of vectors of its clusters: one scan."""
    ends = np.cumsum([0, *[len(c) for c in centers]])
    stacked = np.concatenate(centers)
    total = len(stacked)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, s = np.zeros(total), np.zeros(total), np.zeros_like(stacked)
        for x in _chunks(batches, total):
            d = square_distances(x, stacked)
            for a, b in zip(ends, ends[1:]):
                near = d[:, a:b].argmin(axis=1)
                n[a:b] += np.bincount(near, minlength=b - a)
                cost[a:b] += np.bincount(near, d[np.arange(len(x)), a + near], minlength=b - a)
                member = np.zeros((len(x), b - a))
                member[np.arange(len(x)), near] = 1.0
                s[a:b] += member.T @ x
        there = np.flatnonzero(n)
        columns = [pa.array(there, pa.int32()), pa.array(n[there]), pa.array(cost[there]), pa.array(list(s[there]), pa.list_(pa.float64()))]
        yield pa.record_batch(columns, names=["place", "n", "cost", "s"])

    parts = rows.mapInArrow(add, "place int, n double, cost double, s array<double>")
    merged = parts.withColumn("v", array_to_vector("s")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(F.col("v")).alias("s"))
    n, cost, s = np.zeros(total), np.zeros(total), np.zeros_like(stacked)
    for r in merged.collect():  # one row a centre
        n[r["place"]], cost[r["place"]], s[r["place"]] = r["n"], r["cost"], r["s"].toArray()
    return [(n[a:b], float(cost[a:b].sum()), s[a:b]) for a, b in zip(ends, ends[1:])]


def _spread(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points, far from each other, improved among themselves."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        chance = weights * _apart(points, points[chosen])
        chance[chosen] = 0.0
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
    centers = points[chosen]
    for _ in range(30):
        near = square_distances(points, centers).argmin(axis=1)
        mass = np.bincount(near, weights, len(centers))
        new = np.array([np.bincount(near, weights * points[:, j], len(centers)) for j in range(points.shape[1])]).T
        new = np.where(mass[:, None] > 0, new / np.maximum(mass, 1e-300)[:, None], centers)
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def seeds_of(rows: DataFrame, tasks: Sequence[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """Starting centres of each (k, restart)."""
    number = [seed * 1_000_003 + k * 1009 + r for k, r in tasks]
    held = _draw(rows, [np.empty((0, 0))] * len(tasks), [1] * len(tasks), number)
    if not held or not len(held[0]):
        raise ValueError("there are no rows to cluster")
    for step in range(STEPS):
        more = _draw(rows, held, [2 * k for k, _ in tasks], [n + 7919 * (step + 1) for n in number])
        held = [np.concatenate([h, m]) if len(m) else h for h, m in zip(held, more)]
    counted = _sums(rows, held)
    return [_spread(h, np.maximum(n, 1e-9), k, no) for h, (n, _, _), (k, _), no in zip(held, counted, tasks, number)]


def fit(rows: DataFrame, ks: Sequence[int], restarts: int, seed: int = 42, rounds: int = ROUNDS) -> list[Model]:
    """A model for each k and restart; centres are in the order of their coordinates. `rows` has the column x."""
    models = [Model(k, r, np.empty((0, 0))) for k in ks for r in range(restarts)]
    for model, centers in zip(models, seeds_of(rows, [(m.k, m.restart) for m in models], seed)):
        model.centers = centers
    moving = list(models)
    for _ in range(rounds):
        if not moving:
            break
        still = []
        for model, (n, _, s) in zip(moving, _sums(rows, [m.centers for m in moving])):
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], model.centers)
            if ((new - model.centers) ** 2).sum(axis=1).max() > MOVED**2:
                still.append(model)
            model.centers = new
        moving = still
    for model in models:
        model.centers = model.centers[np.lexsort(model.centers.T[::-1])]
    for model, (n, cost, _) in zip(models, _sums(rows, [m.centers for m in models])):
        model.cost, model.sizes = cost, n
    return models


def best_of(models: Sequence[Model]) -> dict[int, Model]:
    """For each k the model of least cost, the first of equals."""
    best: dict[int, Model] = {}
    for m in models:
        if m.k not in best or m.cost < best[m.k].cost:
            best[m.k] = m
    return best


def labels(df: DataFrame, centers: np.ndarray, features: str = "features") -> DataFrame:
    """Add `cluster`, the nearest centre, in a narrow pass."""

    @F.pandas_udf("int")
    def near(x: pd.Series) -> pd.Series:
        points = np.array(x.tolist(), float).reshape(len(x), -1)
        return pd.Series(square_distances(points, centers).argmin(axis=1) if len(points) else [], dtype="int32")

    kind = df.schema[features].dataType.typeName()
    values = col(features) if kind == "array" else vector_to_array(col(features))
    return df.withColumn("cluster", near(values.cast("array<double>")))


def silhouettes(rows: DataFrame, models: Sequence[Model]) -> list[float | None]:
    """Mean silhouette by squared distances of each model, in two scans for all of them.

    The mean squared distance of a row to a cluster follows from the cluster's
    count, sum and sum of squares; a cluster of one row has silhouette 0.
    """
    centers = [m.centers for m in models]
    ends = np.cumsum([0, *[len(c) for c in centers]])
    stacked = np.concatenate(centers)
    found = _sums(rows, centers)
    n = np.concatenate([f[0] for f in found])
    s = np.concatenate([f[2] for f in found])
    mean = s / np.maximum(n, 1)[:, None]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.zeros(len(stacked))
        for x in _chunks(batches, len(stacked)):
            d = square_distances(x, stacked)
            for a, b in zip(ends, ends[1:]):
                near = d[:, a:b].argmin(axis=1)
                squares[a:b] += np.bincount(near, ((x - mean[a + near]) ** 2).sum(axis=1), minlength=b - a)
        yield pa.record_batch([pa.array(np.arange(len(stacked)), pa.int32()), pa.array(squares)], names=["place", "q"])

    within = np.zeros(len(stacked))
    for r in rows.mapInArrow(spread, "place int, q double").groupBy("place").agg(F.sum("q").alias("q")).collect():  # one row a centre
        within[r["place"]] = r["q"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(len(centers)), 0
        for x in _chunks(batches, len(stacked)):
            counts += len(x)
            d = square_distances(x, stacked)
            # mean squared distance to a cluster: to its mean, and its own spread
            to = square_distances(x, mean) * n + within
            for m, (a, b) in enumerate(zip(ends, ends[1:])):
                near, there = d[:, a:b].argmin(axis=1), n[a:b] > 0
                own = to[np.arange(len(x)), a + near] / np.maximum(n[a + near] - 1, 1)
                other = np.where(there[None, :], to[:, a:b] / np.maximum(n[a:b], 1), np.inf)
                other[np.arange(len(x)), near] = np.inf
                other = other.min(axis=1)
                top = np.maximum(own, other)
                totals[m] += np.where((n[a + near] > 1) & (top > 0) & np.isfinite(other), (other - own) / np.where(top > 0, top, 1), 0.0).sum()
        yield pa.record_batch([pa.array(np.arange(len(centers)), pa.int32()), pa.array(totals), pa.array(np.full(len(centers), counts), pa.int64())], names=["model", "s", "n"])

    out: list[float | None] = [None] * len(centers)
    for r in rows.mapInArrow(score, "model int, s double, n long").groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # one row a model
        if (found[r["model"]][0] > 0).sum() >= 2:
            out[r["model"]] = r["s"] / r["n"]
    return out

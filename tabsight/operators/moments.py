"""Linear models of all cross-validation folds and penalties from one scan.

A row's design is its numbers (0 where missing), a mark for each missing number, one-hot
categories, and 1. The products of the design and the label with each other, summed per fold, are
all that a least-squares fit needs: the training sums of a fold are the sums of
all folds less its own. Filling missing numbers with a value is a linear map
of the design, so each fold fills with the median of its own training
rows without another scan of them, and every penalty is a solve of a small system.
Errors on the held-out rows follow from the held-out sums; predictions take one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col

WIDTH = 2_000  # columns of a design up to which the sums of products are kept
ROWS = 4_096  # rows whose products are summed at once


class TooWide(ValueError):
    """The design has more than WIDTH columns."""


@dataclass
class Design:
    """The columns of a design: numbers, their missing marks, and (column, label) pairs."""

    numeric: list[str]
    categorical: list[str]
    labels: list[list[str]]
    starts: list[int] = field(init=False)

    def __post_init__(self):
        start = 1 + 2 * len(self.numeric)
        self.starts = [start + sum(len(x) for x in self.labels[:i]) for i in range(len(self.labels))]
        self.width = start + sum(len(x) for x in self.labels)

    def matrix(self, numbers: np.ndarray, cells: list[list[str | None]]) -> np.ndarray:
        n, d = len(numbers), len(self.numeric)
        out = np.zeros((n, self.width))
        out[:, 0] = 1.0
        missing = np.isnan(numbers)
        out[:, 1 : 1 + d] = np.where(missing, 0.0, numbers)
        out[:, 1 + d : 1 + 2 * d] = missing
        for start, labels, values in zip(self.starts, self.labels, cells):
            place = {v: i for i, v in enumerate(labels)}
            at = np.array([place.get(v, -1) for v in values], int)
            rows = np.flatnonzero(at >= 0)
            out[rows, start + at[rows]] = 1.0
        return out


def design_of(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Design:
    labels = []
    for c in categorical:
        found = rows.select(col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(WIDTH + 1).collect()
        labels.append([r["v"] for r in found])
    made = Design(list(numeric), list(categorical), labels)
    if made.width > WIDTH:
        raise TooWide(f"a design of more than {WIDTH} columns; use an iterative fit")
    return made


def _batches(batches: Iterator[pa.RecordBatch], design: Design) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(design matrix, label, fold) of up to ROWS rows."""
    d, c = len(design.numeric), len(design.categorical)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            columns = [part.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(2, 2 + d)]
            numbers = np.array(columns).T.reshape(part.num_rows, d).astype(float)
            x = design.matrix(numbers, [part.column(2 + d + i).to_pylist() for i in range(c)])
            yield x, part.column(1).to_numpy(zero_copy_only=False).astype(float), part.column(0).to_numpy(zero_copy_only=False)


def _inputs(rows: DataFrame, design: Design, label: str, fold: str) -> DataFrame:
    names = [col(fold).cast("int").alias("fold"), col(label).cast("double").alias("label")]
    numbers = [F.nanvl(col(c).cast("double"), F.lit(None)).alias(f"n{i}") for i, c in enumerate(design.numeric)]
    return rows.select(*names, *numbers, *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(design.categorical)])


def fold_products(rows: DataFrame, design: Design, label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """For each fold the sum of products of (design, label) with itself: one scan, one small matrix a task and fold."""
    p = design.width + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x, y, folds in _batches(batches, design):
            z = np.concatenate([x, y[:, None]], axis=1)
            for f in np.unique(folds).tolist():
                some = z[folds == f]
                sums[f] = sums.get(f, 0) + some.T @ some
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["fold", "m"])

    known = _inputs(rows, design, label, fold).where("label IS NOT NULL AND fold IS NOT NULL")
    parts = known.mapInArrow(add, "fold int, m array<double>").withColumn("v", array_to_vector("m"))
    return {r["fold"]: r["s"].toArray().reshape(p, p) for r in parts.groupBy("fold").agg(Summarizer.sum(F.col("v")).alias("s")).collect()}  # one row a fold


def training_medians(rows: DataFrame, design: Design, folds: Sequence[int], fold: str = "fold", accuracy: int = 10_000) -> np.ndarray:
    """(folds, numbers): median of each number over the other folds' rows, 0 without any; one scan."""
    if not design.numeric:
        return np.zeros((len(folds), 0))
    cells = [F.percentile_approx(F.when(col(fold) != f, F.nanvl(col(c).cast("double"), F.lit(None))), 0.5, accuracy) for f in folds for c in design.numeric]
    found = rows.agg(*[x.alias(f"m{i}") for i, x in enumerate(cells)]).first()
    return np.array([0.0 if v is None else v for v in found], float).reshape(len(folds), -1)


def solve(products: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients (the intercept first) of the least sum of squares / 2n plus penalty / 2 times the squares of the scaled coefficients."""
    n = products[0, 0]
    mean = products[0] / n
    centred = products / n - np.outer(mean, mean)
    xx, xy = centred[1:-1, 1:-1], centred[1:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    live = np.flatnonzero(scale > 1e-12 * (1 + np.abs(mean[1:-1])))
    w = np.zeros(len(scale))
    if len(live):
        s = scale[live]
        system = xx[np.ix_(live, live)] / np.outer(s, s) + penalty * np.eye(len(live))
        w[live] = np.linalg.lstsq(system, xy[live] / s, rcond=1e-10)[0] / s
    return np.concatenate([[mean[-1] - w @ mean[1:-1]], w])


def _filled(design: Design, medians: np.ndarray) -> np.ndarray:
    """The map from (1, numbers, marks, labels, y) to the same with filled numbers and no marks."""
    d = len(design.numeric)
    out = np.eye(design.width + 1)
    for j in range(d):
        out[1 + j, 1 + d + j] = medians[j]  # a filled number is the number plus its median where missing
    return np.delete(out, range(1 + d, 1 + 2 * d), axis=0)


def fold_models(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", fold: str = "fold", penalties: Sequence[float] = (0.0,)
) -> tuple[DataFrame, dict[tuple[int, float], np.ndarray], Design]:
    """((fold, penalty, train_rows, held_rows, intercept, coefficients, rmse, r2), coefficients over the design by (fold, penalty), the design).

    `coefficients` lists the numbers, then the labels of each category in order;
    errors are those of the held-out fold. Two scans in all.
    """
    design = design_of(rows, numeric, categorical)
    products = fold_products(rows, design, label, fold)
    folds, d = sorted(products), len(design.numeric)
    whole = sum(products.values())
    medians = training_medians(rows, design, folds, fold) if folds and d and whole[1 + d : 1 + 2 * d, 0].any() else np.zeros((len(folds), d))
    out, by = [], {}
    for f, middle in zip(folds, medians):
        fill = _filled(design, middle)
        train, held = fill @ (whole - products[f]) @ fill.T, fill @ products[f] @ fill.T
        if train[0, 0] < 1:
            continue
        for penalty in penalties:
            w = solve(train, penalty)
            z = np.concatenate([w, [-1.0]])  # prediction less label
            n, sse = held[0, 0], max(0.0, float(z @ held @ z))
            total = float(held[-1, -1] - held[0, -1] ** 2 / n)
            r2 = 1 - sse / total if total > 0 else None
            out.append((f, float(penalty), int(round(train[0, 0])), int(round(n)), float(w[0]), [float(x) for x in w[1:]], float(np.sqrt(sse / n)), r2))
            by[f, float(penalty)] = fill[:-1, :-1].T @ w
    schema = "fold int, penalty double, train_rows long, held_rows long, intercept double, coefficients array<double>, rmse double, r2 double"
    return rows.sparkSession.createDataFrame(out, schema), by, design


def predictions(rows: DataFrame, design: Design, weights: dict[int, np.ndarray], label: str = "label", fold: str = "fold") -> DataFrame:
    """(fold, label, prediction): every row predicted by the model that has not seen its fold, in a narrow pass."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, folds in _batches(batches, design):
            p = np.zeros(len(y))
            for f in np.unique(folds).tolist():
                p[folds == f] = x[folds == f] @ weights[f]
            yield pa.record_batch([pa.array(folds, pa.int32()), pa.array(y), pa.array(p)], names=["fold", "label", "prediction"])

    known = _inputs(rows, design, label, fold).where(F.col("label").isNotNull() & F.col("fold").isin(*weights))
    return known.mapInArrow(predict, "fold int, label double, prediction double")

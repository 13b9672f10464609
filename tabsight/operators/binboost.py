"""Boosting of every single column and fold on bin sums.

One scan counts rows and sums the target per (column, fold, bin). A tree on one
binned column only ever moves whole bins, so boosting needs nothing but those
sums: the training sums of a fold are those of all folds less its own, and a
round is a tree over the bins in their order, fitted to the residuals of
the bins. All columns, folds and rounds run on the sums, a column a task.

Squared loss for numbers; for two classes the logistic loss, for more one tree a class and round
under the softmax, leaves by one Newton step. Held-out scores: R2, area under the ROC curve,
accuracy (the smaller class on ties).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, is_numeric, number_of, present
from ..session import materialize
from .target import binned_cells, fold_of

ROUNDS, RATE, DEPTH, BINS = 100, 0.1, 3, 32


def tree_leaves(weight: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Leaf number of each bin: splits between neighbouring bins that lower the squared error of `value` most, the first of equals."""
    leaf = np.zeros(len(weight), int)
    mass, sums = np.concatenate([[0.0], np.cumsum(weight)]), np.concatenate([[0.0], np.cumsum(weight * value)])
    spans, count = [(0, len(weight), 0)], 1
    while spans:
        a, b, level = spans.pop()
        if level == depth or b - a < 2:
            continue
        left_n, left_s = mass[a + 1 : b] - mass[a], sums[a + 1 : b] - sums[a]
        right_n, right_s = mass[b] - mass[a + 1 : b], sums[b] - sums[a + 1 : b]
        whole = (sums[b] - sums[a]) ** 2 / max(mass[b] - mass[a], 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((left_n > 0) & (right_n > 0), left_s**2 / left_n + right_s**2 / right_n - whole, -1.0)
        at = int(gain.argmax())
        if gain[at] <= 1e-12 * (1 + whole):
            continue
        cut = a + 1 + at
        leaf[cut:b] = count
        count += 1
        spans += [(a, cut, level + 1), (cut, b, level + 1)]
    return leaf


def _moved(weight: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int, rate: float) -> np.ndarray:
    """Step of each bin: a tree on the mean gradients, each leaf's gradient sum over its curve sum."""
    value = np.divide(gradient, weight, out=np.zeros_like(gradient), where=weight > 0)
    leaf = tree_leaves(weight, value, depth)
    up, down = np.bincount(leaf, gradient), np.bincount(leaf, curve)
    return rate * np.divide(up, down, out=np.zeros_like(up), where=down > 1e-12)[leaf]


def boosted(counts: np.ndarray, sums: np.ndarray, task: str, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH) -> np.ndarray:
    """Raw score of each bin (and class): `counts` of rows; `sums` of the target, or (bins, classes) rows of each class."""
    n = counts.astype(float)
    if task == "regression":
        score = np.full(len(n), sums.sum() / n.sum())
        for _ in range(rounds):
            score = score + _moved(n, sums - n * score, n, depth, rate)
        return score
    if sums.shape[1] == 2:
        share = np.clip(sums[:, 1].sum() / n.sum(), 1e-9, 1 - 1e-9)
        score = np.full(len(n), np.log(share / (1 - share)))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            score = score + _moved(n, sums[:, 1] - n * p, n * p * (1 - p), depth, rate)
        return score
    k = sums.shape[1]
    score = np.tile(np.log(np.maximum(sums.sum(axis=0) / n.sum(), 1e-9)), (len(n), 1))
    for _ in range(rounds):
        e = np.exp(score - score.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        steps = [_moved(n, sums[:, c] - n * p[:, c], n * p[:, c] * (1 - p[:, c]), depth, rate * (k - 1) / k) for c in range(k)]
        score = score + np.array(steps).T
    return score


def held_out_score(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, score: np.ndarray, task: str) -> float | None:
    n = counts.astype(float)
    if not n.sum():
        return None
    if task == "regression":
        error = float((squares - 2 * score * sums + n * score**2).sum())
        total = float(squares.sum() - sums.sum() ** 2 / n.sum())
        return 1 - error / total if total > 0 else None
    if sums.shape[1] == 2:
        order = np.argsort(score, kind="stable")
        negative, positive = sums[order, 0], sums[order, 1]
        _, first = np.unique(score[order], return_index=True)
        neg, pos = np.add.reduceat(negative, first), np.add.reduceat(positive, first)
        wins = (pos * (np.cumsum(neg) - neg / 2)).sum()
        return float(wins / (neg.sum() * pos.sum())) if neg.sum() and pos.sum() else None
    return float(sums[np.arange(len(n)), score.argmax(axis=1)].sum() / n.sum())


def bin_sums(df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str], folds: int, bins: int = BINS) -> DataFrame:
    """(column, bin, fold, y, n, s, ss): rows and target sums; y is the class, null for numbers. One scan for all columns.

    Numbers fall into quantile bins, categories into their own or, beyond 256 of them, into 256 by hash.
    """
    known = df.where(present(df, target))
    cells = []
    for c, b in zip(features, binned_cells(known, features, bins)):
        if not is_numeric(df.schema[c]):
            many = known.select(b.alias("b")).distinct().limit(257).count() > 256
            b = F.pmod(F.xxhash64(b), F.lit(256)).cast("string") if many else b
        cells.append(F.struct(F.lit(c).alias("column"), b.alias("bin")))
    value = number_of(known, target) if task == "regression" else F.lit(0.0)
    label = F.lit(None).cast("string") if task == "regression" else col(target).cast("string")
    rows = known.select(fold_of(keys, folds).alias("fold"), label.alias("y"), value.cast("double").alias("v"), F.inline(F.array(*cells)))
    return rows.groupBy("column", "bin", "fold", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def single_column_scores(df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str], folds: int = 5, rounds: int = ROUNDS, bins: int = BINS) -> DataFrame:
    """(column, metric, score, fold_scores): cross-validated boosting on each column alone."""
    sums = materialize(bin_sums(df, features, target, task, keys, folds, bins))
    classes = [r["y"] for r in sums.select("y").where("y IS NOT NULL").distinct().orderBy("y").collect()]  # the classes of the target
    metric = "r2" if task == "regression" else "roc_auc" if len(classes) == 2 else "accuracy"

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number = lambda b: (0, -1, "") if b == "missing" else (0, int(b), "") if b.lstrip("-").isdigit() else (1, 0, b)
        names = sorted({r["bin"] for r in rows}, key=number)
        place, of_class = {b: i for i, b in enumerate(names)}, {y: i for i, y in enumerate(classes)}
        width = 1 if task == "regression" else len(classes)
        n, s, ss = (np.zeros((folds, len(names), width)) for _ in range(3))
        for r in rows:
            at = r["fold"], place[r["bin"]], of_class.get(r["y"], 0)
            n[at], s[at], ss[at] = r["n"], r["s"], r["ss"]
        scores = []
        for f in range(folds):
            train_n, held_n = n.sum(axis=0) - n[f], n[f]
            if not train_n.sum():
                scores.append(None)
            elif task == "regression":
                guess = boosted(train_n[:, 0], s.sum(axis=0)[:, 0] - s[f][:, 0], task, rounds)
                scores.append(held_out_score(held_n[:, 0], s[f][:, 0], ss[f][:, 0], guess, task))
            else:
                guess = boosted(train_n.sum(axis=1), train_n, task, rounds)
                scores.append(held_out_score(held_n.sum(axis=1), held_n, held_n, guess, task))
        real = [x for x in scores if x is not None]
        mean = float(np.mean(real)) if real else None
        return pa.table({"column": pa.array([rows[0]["column"]]), "metric": pa.array([metric]), "score": pa.array([mean], pa.float64()), "fold_scores": pa.array([scores], pa.list_(pa.float64()))})

    return sums.groupBy("column").applyInArrow(one, "column string, metric string, score double, fold_scores array<double>")

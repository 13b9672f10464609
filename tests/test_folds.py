"""Fold models from sums and boosting on bin sums against plain fits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.catalog import models
from tabsight.catalog.registry import QUERIES
from tabsight.operators import binboost, learners, moments, tuning

RNG = np.random.default_rng(3)


def framed(spark, n=400):
    rows = []
    for i in range(n):
        x, z, c = float(RNG.normal()), float(RNG.normal(3, 2)), str(RNG.choice(["a", "b", "c"]))
        y = 2 * x - z + {"a": 0, "b": 5, "c": -3}[c] + float(RNG.normal()) * 0.1
        rows.append((i, i % 4, None if i % 17 == 0 else x, None if i % 23 == 0 else z, None if i % 29 == 0 else c, None if i == 7 else y))
    return rows, spark.createDataFrame(rows, "id long, fold int, x double, z double, c string, label double").repartition(3)


@pytest.mark.parametrize("penalty", [0.0, 0.3])
def test_fold_models_equal_fits_of_the_training_rows(spark, penalty):
    rows, df = framed(spark)
    found, by, design = moments.fold_models(df, ["x", "z"], ["c"], penalties=(penalty, 7.0))
    assert found.count() == 8
    got = {(r["fold"], r["penalty"]): r for r in found.collect()}
    predicted = {}
    for r in moments.predictions(df, design, {f: by[f, penalty] for f in range(4)}).collect():
        predicted.setdefault(r["fold"], []).append((r["label"], r["prediction"]))
    middle = lambda v: sorted(v)[(len(v) - 1) // 2]
    for f in range(4):
        train, held = [r for r in rows if r[1] != f and r[5] is not None], [r for r in rows if r[1] == f and r[5] is not None]
        fill = [middle([r[j] for r in rows if r[1] != f and r[j] is not None]) for j in (2, 3)]
        make = lambda some: np.array([[r[2] if r[2] is not None else fill[0], r[3] if r[3] is not None else fill[1], *[float(r[4] == k) for k in "abc"]] for r in some])  # noqa: E731, B023
        a, y = make(train), np.array([r[5] for r in train])
        scale = a.std(axis=0)
        centred, goal = (a - a.mean(axis=0)) / scale, y - y.mean()
        w = np.linalg.lstsq(centred.T @ centred / len(a) + penalty * np.eye(5), centred.T @ goal / len(a), rcond=1e-10)[0] / scale
        guess = (make(held) - a.mean(axis=0)) @ w + y.mean()
        truth = np.array([r[5] for r in held])
        r = got[f, penalty]
        assert (r["train_rows"], r["held_rows"]) == (len(train), len(held))
        assert r["rmse"] == pytest.approx(np.sqrt(((guess - truth) ** 2).mean()), rel=1e-6)
        assert r["r2"] == pytest.approx(1 - ((guess - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum(), rel=1e-6)
        assert np.allclose(sorted(predicted[f]), sorted(zip(truth.tolist(), guess.tolist())), atol=1e-6)


def test_one_scan_for_all_folds(spark, tmp_path):
    _, df = framed(spark, 60)
    design = moments.design_of(df, ["x"], [])
    products = moments.fold_products(df, design)
    assert sorted(products) == [0, 1, 2, 3] and sum(m[0, 0] for m in products.values()) == 59
    assert moments.fold_models(df.limit(0), ["x"])[0].count() == 0
    constant = df.selectExpr("fold", "1.0 AS x", "label")
    assert all(r["coefficients"] == [0.0] for r in moments.fold_models(constant, ["x"])[0].collect())


def plain_boosting(bins, y, task, classes, rounds, rate, depth):
    """The same boosting over rows: every tree is found by trying each threshold with sums over rows."""
    n = len(y)

    def leaves(value):
        leaf, todo = np.zeros(n, int), [(np.arange(n), 0)]
        while todo:
            rows, level = todo.pop()
            if level == depth:
                continue
            best = None
            whole = value[rows].sum() ** 2 / len(rows)
            for t in np.unique(bins[rows])[1:]:
                left, right = rows[bins[rows] < t], rows[bins[rows] >= t]
                gain = value[left].sum() ** 2 / len(left) + value[right].sum() ** 2 / len(right) - whole
                if best is None or gain > best[0] + 1e-9 * (1 + abs(gain)):
                    best = gain, left, right
            if best is None or best[0] <= 1e-12 * (1 + whole):
                continue
            leaf[best[2]] = leaf.max() + 1
            todo += [(best[1], level + 1), (best[2], level + 1)]
        return leaf

    def step(gradient, curve, pace):
        leaf, out = leaves(gradient), np.zeros(n)
        for k in np.unique(leaf):
            out[leaf == k] = pace * gradient[leaf == k].sum() / curve[leaf == k].sum() if curve[leaf == k].sum() > 1e-12 else 0.0
        return out

    if task == "regression":
        score = np.full(n, y.mean())
        for _ in range(rounds):
            score = score + step(y - score, np.ones(n), rate)
        return score
    if classes == 2:
        score = np.full(n, np.log(y.mean() / (1 - y.mean())))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            score = score + step(y - p, p * (1 - p), rate)
        return score
    hot = np.eye(classes)[y]
    score = np.tile(np.log(hot.mean(axis=0)), (n, 1))
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        score = score + np.array([step(hot[:, c] - p[:, c], p[:, c] * (1 - p[:, c]), rate * (classes - 1) / classes) for c in range(classes)]).T
    return score


@pytest.mark.parametrize("task,classes", [("regression", 1), ("classification", 2), ("classification", 3)])
def test_boosting_on_sums_equals_boosting_on_rows(task, classes):
    rng = np.random.default_rng(classes)
    bins = rng.integers(0, 12, 300)
    raw = np.sin(bins / 2) + rng.normal(0, 0.4, 300)
    y = raw if task == "regression" else np.digitize(raw, [0.0] if classes == 2 else [-0.4, 0.4])
    n = np.bincount(bins, minlength=12)
    sums = np.bincount(bins, y, 12) if task == "regression" else np.array([np.bincount(bins[y == c], minlength=12) for c in range(classes)]).T
    got = binboost.boosted(n, sums.astype(float), task, 25, 0.1, 3)
    assert np.allclose(got[bins], plain_boosting(bins, y, task, classes, 25, 0.1, 3), atol=1e-6)


def test_single_column_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.normal()), str(rng.choice(["u", "v"])), float(i % 50)) for i in range(600)]
    rows = [(i, x, c, z, 3 * x, int(x > 0), ["lo", "mid", "hi"][int(np.digitize(x, [-0.5, 0.5]))]) for i, x, c, z in rows]
    df = spark.createDataFrame(rows, "id long, x double, c string, z double, y double, two int, three string")
    for target, task, metric, good, poor in (("y", "regression", "r2", 0.9, 0.1), ("two", "classification", "roc_auc", 0.95, 0.65), ("three", "classification", "accuracy", 0.9, 0.6)):
        got = {r["column"]: r for r in binboost.single_column_scores(df, ["x", "c", "z"], target, task, ["id"]).collect()}
        assert {r["metric"] for r in got.values()} == {metric} and len(got) == 3
        assert got["x"]["score"] > good and max(got["c"]["score"], got["z"]["score"]) < poor and len(got["x"]["fold_scores"]) == 5


def test_area_and_accuracy_from_sums():
    sums = np.array([[3.0, 1.0], [2.0, 2.0], [0.0, 5.0]])
    scores = np.array([0.1, 0.1, 0.7])
    negative, positive = [0.1] * 5, [0.1] * 3 + [0.7] * 5
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / 40
    assert binboost.held_out_score(sums.sum(axis=1), sums, sums, scores, "classification") == pytest.approx(wins)


def _plain_neighbors(near_of, labels, how, k):
    """(prediction) of one row from its (distance, key, label) list."""
    head = near_of[:k]
    weights = [1.0] * len(head)
    if how == "distance":
        weights = [float(d == 0) for d, _, _ in head] if any(d == 0 for d, _, _ in head) else [1 / d for d, _, _ in head]
    return sum(w * y for w, (_, _, y) in zip(weights, head)) / sum(weights)


def test_neighbor_search_equals_each_set_on_its_own(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    x[100:130] = x[:30]  # equal rows
    y = np.round(x[:, 0] * 2 + rng.normal(size=150) * 0.3, 3)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    grid = {"neighbors": [1, 4, 7], "weights": ["uniform", "distance"]}
    got = {r["params"]: r["mean"] for r in tuning.search(df, ["a", "b"], "y", ["id"], "regression", "knn", grid).collect()}
    rows, _ = learners.base_table(df, ["a", "b"], "y", "regression", ["id"])
    fold = {r["__key0"]: r["fold"] for r in learners.with_folds(rows, "regression", ["__key0"], 3).collect()}
    for one in tuning.combinations(grid):
        scores = []
        for f in range(3):
            train, test = [i for i in range(150) if fold[i] != f], [i for i in range(150) if fold[i] == f]
            m, s = x[train].mean(axis=0), x[train].std(axis=0, ddof=1)
            z = (x - m) / s
            guess = []
            for i in test:
                near = sorted(((float(np.sqrt(((z[i] - z[j]) ** 2).sum())), str(j), y[j]) for j in train), key=lambda e: (round(e[0], 9), e[1]))
                guess.append(_plain_neighbors([(0.0 if d < 1e-12 else d, j, t) for d, j, t in near], y, one["weights"], one["neighbors"]))
            t = y[test]
            scores.append(1 - ((t - guess) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert got[json.dumps(one, sort_keys=True)] == pytest.approx(np.mean(scores), abs=1e-6)
    few = tuning.grid_search(df.withColumn("c", (F.col("y") > 0).cast("int")), ["a", "b"], "c", ["id"], "classification", "knn", grid, folds=2).collect()
    assert 1 <= len(few) <= 5 and all(0.8 < r["mean"] <= 1 for r in few)


def test_classification_query_trains_at_full_strength(spark, monkeypatch):
    """No parameter lowers the rounds of its models, and rounds over few rows are not dealt over many tasks."""
    seen = []

    def noted(rows, model, task, features, folds, classes, params):
        seen.append((model, params or {}, folds, rows.rdd.getNumPartitions()))
        return rows, spark.createDataFrame([("accuracy", 1.0, 0.0)], "metric string, mean double, std double")

    docs = spark.createDataFrame([(i, i * 7 % 50, "en" if i % 3 else "de", "web", i % 2, 0) for i in range(60)], "doc_id long, n_chars int, lang string, source string, quality int, toxic int")
    monkeypatch.setattr(models, "_docs", lambda *_: docs.repartition(6))
    monkeypatch.setattr(learners, "cross_validate", noted)
    QUERIES["train_models_classification"](spark, "").count()
    assert [x[:3] for x in seen] == [("baseline", {}, 5), ("svm", {}, 5), ("knn", {}, 5)]
    assert [x[3] for x in seen[:2]] == [1, 1]

"""Pivot neighbours, stacked k-means and density clusters against plain readings."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector

from tabsight.operators import cluster, kmeans, neighbors

RNG = np.random.default_rng(0)
MIDDLES = RNG.normal(0, 10, (30, 4))
SHAPES = {
    "clustered": (np.concatenate([RNG.normal(x, 0.05, (40, 4)) for x in MIDDLES]), 100),
    "a third equal": (np.concatenate([np.zeros((200, 2)), RNG.normal(0, 1, (400, 2))]), 50),
    "many ties": (RNG.integers(0, 4, (400, 2)).astype(float), 40),
    "few": (RNG.normal(0, 1, (3, 3)), 50),
}


def framed(spark, points):
    rows = [(i, p.tolist(), float(i % 3)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "key long, vector array<double>, label double").repartition(4)


@pytest.mark.parametrize("shape", SHAPES)
def test_neighbours_equal_the_distance_matrix(spark, shape):
    points, size = SHAPES[shape]
    df = framed(spark, points)
    got = {r["key"]: [(n["key"], n["label"]) for n in r["near"]] for r in neighbors.nearest(df, df.select("key", "vector"), 5, True, size).collect()}
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        d[i] = np.inf
        want = [(int(x), float(x % 3)) for x in np.lexsort((np.arange(len(d)), d))[:5] if np.isfinite(d[x])]
        assert got[i] == want  # ties by number, 9 before 10


def test_clustered_rows_visit_few_leaves(spark):
    points, size = SHAPES["clustered"]
    start = "CAST('inf' AS double) AS r", "'0' AS node"
    leaves, levels = neighbors.grow(framed(spark, points).selectExpr("key AS id", "vector", "label", *start), size)
    assert levels and leaves.groupBy("node").count().agg({"count": "max"}).first()[0] <= size
    asked = framed(spark, points).selectExpr("key AS id", "vector", "label", "CAST(0.3 AS double) AS r", "'0' AS node")
    assert neighbors.leaves_of(asked, levels, size, True).count() < 4 * len(points)


def test_no_rows_on_a_side(spark):
    df = framed(spark, SHAPES["few"][0])
    assert [r["near"] for r in neighbors.nearest(df.limit(0), df, 5).collect()] == [[]] * 3
    assert neighbors.nearest(df, df.limit(0), 5).count() == 0


def test_text_keys(spark):
    points = SHAPES["many ties"][0][:60]
    df = framed(spark, points)
    by_text = df.withColumn("key", df["key"].cast("string"))
    a = {str(r["key"]): [n["distance"] for n in r["near"]] for r in neighbors.nearest(df, df, 3, True, 10).collect()}
    b = {r["key"]: [n["distance"] for n in r["near"]] for r in neighbors.nearest(by_text, by_text, 3, True, 10).collect()}
    assert a == b


def test_stacked_models_equal_separate_ones(spark):
    points = np.concatenate([RNG.normal(c, 0.4, (60, 3)) for c in ([0, 0, 0], [5, 5, 0], [0, 5, 5], [2, 2, 9])])
    rows = kmeans.vectors(framed(spark, points), "vector").persist()
    stacked = kmeans.fit(rows, [2, 3, 4], 3)
    for m in stacked:
        alone = [x for x in kmeans.fit(rows.repartition(2), [m.k], m.restart + 1) if x.restart == m.restart][0] if m.restart == 2 else m
        assert np.allclose(alone.centers, m.centers) and alone.cost == pytest.approx(m.cost)
        # a fixed point: centres are the means of their rows, the cost is that of the rows
        d = kmeans.square_distances(points, m.centers)
        near = d.argmin(axis=1)
        assert m.cost == pytest.approx(d.min(axis=1).sum()) and m.sizes.tolist() == np.bincount(near, minlength=len(m.centers)).tolist()
        assert np.allclose(m.centers, [points[near == c].mean(axis=0) for c in range(len(m.centers))], atol=1e-3)
    best = kmeans.best_of(stacked)
    assert best[4].sizes.tolist() == [60.0] * 4 and best[4].cost == min(m.cost for m in stacked if m.k == 4)
    values = kmeans.silhouettes(rows, [best[k] for k in (2, 3, 4)])
    for k, value in zip((2, 3, 4), values):
        labelled = kmeans.labels(framed(spark, points).withColumn("features", array_to_vector("vector")), best[k].centers)
        evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
        assert value == pytest.approx(evaluator.evaluate(labelled), abs=1e-9)
    rows.unpersist()


def test_fewer_points_than_clusters(spark):
    rows = kmeans.vectors(framed(spark, np.array([[1.0, 2.0]] * 30 + [[3.0, 4.0]] * 5)), "vector")
    (model,) = kmeans.fit(rows, [4], 1)
    assert model.cost == 0 and model.centers.tolist() == [[1.0, 2.0], [3.0, 4.0]] and model.sizes.tolist() == [30.0, 5.0]
    assert kmeans.silhouettes(rows, [model]) == [1.0]
    with pytest.raises(ValueError):
        kmeans.fit(rows.limit(0), [2], 1)


@pytest.mark.parametrize("shape", ["constant leading dimension", "one-hot columns"])
def test_density_clusters_in_many_dimensions(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 30)
    monkeypatch.setattr(neighbors.within, "__defaults__", (30,))
    rng = np.random.default_rng(5)
    if shape == "one-hot columns":
        flat = np.concatenate([rng.normal(0, 0.2, (60, 1)), rng.normal(3, 0.3, (60, 1))])
        points = np.concatenate([np.eye(5)[rng.integers(0, 5, 120)], flat], axis=1)
        eps, least = 0.4, 4
    else:
        points = np.concatenate([np.full((150, 3), 7.0), rng.normal(0, 1, (150, 3)) + rng.integers(0, 3, (150, 1)) * 4], axis=1)
        eps, least = 0.9, 4
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(points), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    df = framed(spark, points).withColumn("features", array_to_vector("vector"))
    got = {r["key"]: r["cluster"] for r in cluster.dbscan(df, "features", "key", eps, least).collect()}
    mine = np.array([got[i] for i in range(len(points))])
    assert (mine[core] >= 0).all() and len(set(zip(label[core], mine[core]))) == len(set(label[core])) == len(set(mine[core])) > 1
    for i in np.flatnonzero(~core):
        reach = {mine[j] for j in np.flatnonzero(near[i] & core)}
        assert mine[i] == min(reach, default=-1)

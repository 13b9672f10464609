"""k-means and density clustering, their evaluation and description."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from ..session import materialize
from . import kmeans as stacked, neighbors
from .ingest import normalize_missing
from .prep import check_labels, feature_pipeline, split_columns

RESTARTS = 10
REFINE = 4  # parts per side of a cell when two cells need a closer look


def prepare(df: DataFrame, columns: Sequence[str], least: int = 10) -> DataFrame:
    """Complete rows with a `features` vector: scaled numbers, one-hot categories."""
    if len(columns) < 2:
        raise ValueError("clustering needs at least two columns")
    complete = normalize_missing(df).dropna(subset=list(columns))
    if complete.limit(least).count() < least:
        raise ValueError(f"clustering needs at least {least} complete rows")
    numeric, categorical = split_columns(complete, columns)
    ready = complete
    for c in categorical:
        ready = ready.withColumn(c, col(c).cast("string"))
    check_labels(ready, categorical)
    model = feature_pipeline(numeric, categorical).fit(ready)
    return model.transform(ready).select(*[col(c) for c in df.columns], "features")


def kmeans(prepared: DataFrame, k: int, restarts: int = RESTARTS, seed: int = 42) -> DataFrame:
    """Add `cluster`: the run with the lowest cost among `restarts` seeds, all fitted together."""
    if not 2 <= k <= 20:
        raise ValueError("k must lie between 2 and 20")
    rows = stacked.vectors(prepared).persist()
    try:
        best = stacked.best_of(stacked.fit(rows, [k], restarts, seed))[k]
    finally:
        rows.unpersist()
    return stacked.labels(prepared, best.centers)


# -- density clustering -----------------------------------------------------


def _axes(d: int) -> range:
    return range(d)


def _box_gap(d: int) -> Column:
    """Squared smallest distance between boxes a and b."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}")) for i in _axes(d)]
    return functools.reduce(operator.add, [g * g for g in gaps])


def _box_reach(d: int) -> Column:
    """Squared largest distance between boxes a and b."""
    reach = [F.greatest(F.col(f"ahi{i}") - F.col(f"blo{i}"), F.col(f"bhi{i}") - F.col(f"alo{i}")) for i in _axes(d)]
    return functools.reduce(operator.add, [r * r for r in reach])


def _square_distance(d: int) -> Column:
    return functools.reduce(operator.add, [F.pow(F.col(f"ax{i}") - F.col(f"bx{i}"), 2) for i in _axes(d)])


def _boxes(points: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    """Tight bounding box and weight of every group."""
    return points.groupBy(*by).agg(
        F.sum("w").alias("w"), *[F.min(f"x{i}").alias(f"lo{i}") for i in _axes(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in _axes(d)]
    )


def _side(df: DataFrame, side: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(side + c) for c in df.columns])


def _near_cells(cells: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs (a, b) of different occupied cells whose boxes come within eps.

    A cell's box is at most eps wide from corner to corner, so the middles of
    such boxes are at most 2 eps apart: a search around pivots, in any number of dimensions.
    """
    middle = F.array(*[(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in _axes(d)])
    places = materialize(cells.select(F.col("cell").alias("id"), middle.alias("vector")))
    pairs = neighbors.within(places, places, 2 * eps).where("id <> other").select(F.col("id").alias("acell"), F.col("other").alias("bcell"))
    return pairs.join(_side(cells, "a", []), "acell").join(_side(cells, "b", []), "bcell").where(_box_gap(d) <= eps * eps)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): smallest node of each component, by neighbour minima and pointer jumping.

    `edges` lists both directions. Every round is checkpointed.
    """
    labels = materialize(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("mid"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("mid"), F.col("mid").alias("root"))
        new = materialize(step.join(jump, "mid", "left").select("node", F.least(F.coalesce("root", "mid"), "mid").alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def dbscan(df: DataFrame, features: str, key: str, eps: float, min_samples: int) -> DataFrame:
    """Add `cluster`: density clusters, -1 for noise.

    Equal points are merged with a weight. Points are laid on cells so small
    that all points of a cell are neighbours: a cell holding `min_samples`
    rows is core as a whole and never compares its own rows. Two cells join
    when their boxes settle it; only undecided ones look at sub-cells, and only
    undecided sub-cells at points. A border row takes the smallest neighbouring
    cluster. Clusters are numbered by their smallest cell.
    """
    first = df.select(F.size(vector_to_array(col(features))).alias("d")).first()
    if first is None:
        return df.withColumn("cluster", F.lit(-1))
    d, e2 = first["d"], eps * eps
    coords = [f"x{i}" for i in _axes(d)]
    side = eps / math.sqrt(d) * (1 - 1e-9)
    array = vector_to_array(col(features))
    keyed = df.select(col(key).alias("key"), *[array[i].alias(f"x{i}") for i in _axes(d)])
    cell = F.concat_ws(",", *[F.floor(F.col(c) / side).cast("string") for c in coords])
    points = keyed.groupBy(*coords).agg(F.count(F.lit(1)).alias("w"))
    points = materialize(points.withColumn("cell", cell).withColumn("pid", F.monotonically_increasing_id()))
    cells = materialize(_boxes(points, ["cell"], d))
    near = materialize(_near_cells(cells, d, eps).select("acell", "bcell", "aw", "bw", *[f"{s}{e}{i}" for s in "ab" for e in ("lo", "hi") for i in _axes(d)]))

    # neighbours of the points outside full cells; the cell's own rows always count
    sparse = points.join(cells.where(F.col("w") < min_samples).select("cell", F.col("w").alias("own")), "cell")
    a = sparse.select(F.col("cell").alias("acell"), F.col("pid").alias("apid"), *[F.col(c).alias(f"a{c}") for c in coords])
    b = points.select(F.col("cell").alias("bcell"), F.col("w").alias("bw"), *[F.col(c).alias(f"b{c}") for c in coords])
    around = a.join(near.select("acell", "bcell"), "acell").join(b, "bcell").where(_square_distance(d) <= e2)
    counts = around.groupBy("apid").agg(F.sum("bw").alias("others"))
    is_core = sparse.join(counts, sparse["pid"] == counts["apid"], "left").where(F.col("own") + F.coalesce("others", F.lit(0)) >= min_samples)
    full = cells.where(F.col("w") >= min_samples).select("cell")
    core = points.join(full, "cell", "left_semi").select("pid").unionByName(is_core.select("pid"))
    points = materialize(points.join(core.withColumn("core", F.lit(True)), "pid", "left").withColumn("core", F.coalesce("core", F.lit(False))))

    core_points = points.where("core")
    core_cells = materialize(_boxes(core_points, ["cell"], d))
    boxed = lambda pairs, s: pairs.join(_side(core_cells, s, []), f"{s}cell")
    candidates = boxed(boxed(near.select("acell", "bcell").where("acell < bcell"), "a"), "b").where(_box_gap(d) <= e2)
    candidates = materialize(candidates.withColumn("sure", _box_reach(d) <= e2))
    sure = candidates.where("sure").select("acell", "bcell")
    open_pairs = candidates.where("not sure").select("acell", "bcell")
    part = F.concat_ws(",", *[F.floor(F.col(c) / (side / REFINE)).cast("string") for c in coords])
    fine_points = core_points.withColumn("part", part)
    fine = _boxes(fine_points, ["cell", "part"], d)
    sub = open_pairs.join(_side(fine, "a", []), "acell").join(_side(fine, "b", []), "bcell").where(_box_gap(d) <= e2)
    sub = materialize(sub.select("acell", "bcell", "apart", "bpart", (_box_reach(d) <= e2).alias("sure")))
    settled = sub.where("sure").select("acell", "bcell").distinct()
    undecided = sub.where("not sure").join(settled, ["acell", "bcell"], "left_anti")
    pa = fine_points.select(F.col("cell").alias("acell"), F.col("part").alias("apart"), *[F.col(c).alias(f"a{c}") for c in coords])
    pb = fine_points.select(F.col("cell").alias("bcell"), F.col("part").alias("bpart"), *[F.col(c).alias(f"b{c}") for c in coords])
    touching = undecided.join(pa, ["acell", "apart"]).join(pb, ["bcell", "bpart"]).where(_square_distance(d) <= e2)
    links = sure.unionByName(settled).unionByName(touching.select("acell", "bcell")).distinct()
    edges = materialize(
        links.select(F.col("acell").alias("u"), F.col("bcell").alias("v")).unionByName(links.select(F.col("bcell").alias("u"), F.col("acell").alias("v")))
    )
    roots = connected_components(edges, core_cells.select(F.col("cell").alias("node")))
    numbered = roots.select("root").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("root")  # one row per cluster
    numbered = numbered.withColumn("cluster", F.row_number().over(order) - 1)
    cell_label = roots.join(numbered, "root").select(F.col("node").alias("cell"), "cluster")

    core_labels = core_points.join(cell_label, "cell").select("pid", "cluster")
    loose = points.where("not core")
    la = loose.select(F.col("cell").alias("acell"), F.col("pid").alias("apid"), *[F.col(c).alias(f"a{c}") for c in coords])
    lb = core_points.join(cell_label, "cell").select(F.col("cell").alias("bcell"), "cluster", *[F.col(c).alias(f"b{c}") for c in coords])
    same = la.select("acell", "apid").join(cell_label.withColumnRenamed("cell", "acell"), "acell").select("apid", "cluster")
    other = la.join(near.select("acell", "bcell"), "acell").join(lb, "bcell").where(_square_distance(d) <= e2).select("apid", "cluster")
    border = same.unionByName(other).groupBy(F.col("apid").alias("pid")).agg(F.min("cluster").alias("cluster"))
    by_point = points.select("pid", *coords).join(core_labels.unionByName(border), "pid").select(*coords, "cluster")
    labels = keyed.join(by_point, coords, "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return df.join(labels, key)


# -- evaluation and description ----------------------------------------------


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """One row: clusters without noise, and noise rows."""
    real = F.col("cluster") >= 0
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"))


def silhouette(labelled: DataFrame, features: str = "features") -> float | None:
    """Mean silhouette (squared Euclidean, linear cost) of the rows in clusters; None below two clusters."""
    kept = labelled.where("cluster >= 0")
    if kept.select("cluster").distinct().limit(2).count() < 2:
        return None
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol="cluster", metricName="silhouette")
    return evaluator.evaluate(kept.withColumn("cluster", F.col("cluster").cast("int")))


def silhouette_band(value: float | None) -> str:
    if value is None:
        return "undefined"
    return "strong" if value > 0.5 else "moderate" if value > 0.25 else "weak"


def project(prepared: DataFrame, features: str = "features") -> tuple[DataFrame, list[float]]:
    """(x, y added, explained shares): two principal components of the centred vectors."""
    d = prepared.select(F.size(vector_to_array(col(features))).alias("d")).first()["d"]
    if d <= 2:
        values = vector_to_array(col(features))
        return prepared.withColumn("x", values[0]).withColumn("y", values[1] if d == 2 else F.lit(0.0)), [1.0]
    model = PCA(k=2, inputCol=features, outputCol="__pc").fit(prepared)
    mean = prepared.select(Summarizer.mean(col(features)).alias("m")).first()["m"]
    components = model.pc.toArray()
    shift = [float(v) for v in mean.toArray() @ components]
    pc = vector_to_array("__pc")
    out = model.transform(prepared).withColumn("x", pc[0] - shift[0]).withColumn("y", pc[1] - shift[1]).drop("__pc")
    return out, [float(v) for v in model.explainedVariance]


def best_k(prepared: DataFrame, highest: int = 10, restarts: int = RESTARTS, seed: int = 42) -> DataFrame:
    """(k, silhouette, cost, best) for k = 2 .. min(highest, n - 1); the first best k wins.

    All values of k and all restarts share their scans.
    """
    rows = stacked.vectors(prepared).persist()
    found = []
    try:
        ks = range(2, min(highest, rows.count() - 1) + 1)
        if ks:
            best = stacked.best_of(stacked.fit(rows, ks, restarts, seed))
            found = [(k, value, best[k].cost) for k, value in zip(ks, stacked.silhouettes(rows, [best[k] for k in ks]))]
    finally:
        rows.unpersist()
    top = max((r[1] for r in found if r[1] is not None), default=None)
    winner = next((r[0] for r in found if r[1] == top and top is not None), None)
    return prepared.sparkSession.createDataFrame([(*r, r[0] == winner) for r in found], "k int, silhouette double, cost double, best boolean")


def numeric_profile(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cluster, column, cluster_mean, global_mean, z) of the rows in clusters."""
    kept = labelled.where("cluster >= 0")
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("x")) for c in columns]
    long = kept.select("cluster", F.inline(F.array(*cells)))
    inside = long.groupBy("cluster", "column").agg(F.avg("x").alias("cluster_mean"))
    whole = long.groupBy("column").agg(F.avg("x").alias("global_mean"), F.stddev_samp("x").alias("s"))
    z = F.when(F.col("s") > 1e-6, (F.col("cluster_mean") - F.col("global_mean")) / F.col("s")).otherwise(F.lit(0.0))
    return inside.join(F.broadcast(whole), "column").select("cluster", "column", "cluster_mean", "global_mean", z.alias("z"))  # one row per column


def categorical_profile(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cluster, column, cluster_mode, global_mode, share, global_share, z)."""
    kept = labelled.where("cluster >= 0")
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in columns]
    long = kept.select("cluster", F.inline(F.array(*cells)))
    counts = long.groupBy("cluster", "column", "v").agg(F.count(F.lit(1)).alias("n"))
    smallest = F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v")))
    known = counts.where("v is not null")
    inside = known.groupBy("cluster", "column").agg(smallest.alias("cluster_mode"), F.max("n").alias("top"))
    sizes = counts.groupBy("cluster", "column").agg(F.sum("n").alias("size"))
    whole = known.groupBy("column", "v").agg(F.sum("n").alias("n"))
    global_mode = whole.groupBy("column").agg(F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v"))).alias("global_mode"))
    total = sizes.groupBy("column").agg(F.sum("size").alias("rows"))
    out = inside.join(sizes, ["cluster", "column"]).join(global_mode, "column").join(total, "column")
    out = out.join(whole.select("column", F.col("v").alias("cluster_mode"), F.col("n").alias("everywhere")), ["column", "cluster_mode"])
    p, g = F.col("top") / F.col("size"), F.col("everywhere") / F.col("rows")
    s = F.sqrt(g * (1 - g))
    z = F.when(s > 1e-6, (p - g) / s).otherwise(F.lit(0.0))
    return out.select("cluster", "column", "cluster_mode", "global_mode", p.alias("share"), g.alias("global_share"), z.alias("z"))


def characterize(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cluster, size, rank, column, type, cluster_value, global_value, z, text): most telling feature first."""
    numeric, categorical = split_columns(labelled, columns)
    parts = []
    sigma = F.format_string("%.1f", F.abs("z"))
    if numeric:
        side = F.when(F.col("z") >= 0, "above").otherwise("below")
        parts.append(
            numeric_profile(labelled, numeric).select(
                "cluster", "column", F.lit("numeric").alias("type"), F.round("cluster_mean", 2).cast("string").alias("cluster_value"),
                F.round("global_mean", 2).cast("string").alias("global_value"), F.round("z", 2).alias("z"),
                F.concat("column", F.lit(" lies "), sigma, F.lit(" sd "), side, F.lit(" average")).alias("text"),
            )
        )
    if categorical:
        parts.append(
            categorical_profile(labelled, categorical).select(
                "cluster", "column", F.lit("categorical").alias("type"), F.col("cluster_mode").alias("cluster_value"),
                F.col("global_mode").alias("global_value"), F.round("z", 2).alias("z"),
                F.format_string("%s is mostly %s (%.1f%% here, %.1f%% overall)", "column", "cluster_mode", F.col("share") * 100, F.col("global_share") * 100).alias("text"),
            )
        )
    rows = functools.reduce(DataFrame.unionByName, parts)
    sizes = labelled.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "column")  # one row per column
    return rows.join(sizes, "cluster").withColumn("rank", F.row_number().over(order))


def with_clusters(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """All rows with their cluster; rows that were not clustered get -1."""
    return df.join(labels.select(key, "cluster"), key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))

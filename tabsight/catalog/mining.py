"""Anomaly and clustering queries (J, K, A7)."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import anomaly, cluster, prep
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query


@query(
    "fill_median_mode",
    f"""WITH {MESSY_ORDERS_SQL}, n AS (SELECT o_orderkey, price, CASE WHEN trim(priority) <> '' THEN priority END AS priority FROM messy)
    SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM n)), 4) AS price,
           coalesce(priority, (SELECT priority FROM n WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM n""",
)
def _(spark, sf):
    return rounded(prep.fill_rows(messy_orders(spark, sf).select("o_orderkey", "price", "priority"), ["price", "priority"]), 4)


@query("isolation_scores")
def _(spark, sf):
    cols = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    scored = anomaly.isolation_scores(load(spark, sf, "orders", spread=True), cols, ["o_orderkey"])
    return scored.select("o_orderkey", F.round("score", 6).alias("score"))


@query("detect_anomalies")
def _(spark, sf):
    found = anomaly.detect_anomalies(load(spark, sf, "part"), ["p_size", "p_retailprice", "p_brand", "p_type"], ["p_partkey"])
    top = F.array_join(F.transform("drivers", lambda d: d["column"]), ",")
    return found.select("p_partkey", F.round("score", 6).alias("score"), top.alias("drivers"))


_FLAGGED = """f AS (SELECT *, abs(c_acctbal) AS score FROM customer), cut AS (SELECT quantile_cont(abs(c_acctbal), 0.95) AS c FROM customer),
    flagged AS (SELECT f.* FROM f, cut WHERE score > c)"""


def _scored_customers(spark, sf):
    c = load(spark, sf, "customer").withColumn("nation", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return c, c.withColumn("score", F.abs("c_acctbal"))


@query("anomaly_threshold", f"WITH {_FLAGGED} SELECT c_custkey, score FROM flagged")
def _(spark, sf):
    return anomaly.flag_anomalies(_scored_customers(spark, sf)[1]).select("c_custkey", "score")


@query(
    "anomaly_drivers",
    f"""WITH {_FLAGGED}, s AS (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS w FROM customer),
    n AS (SELECT c_nationkey, count(*) * 1.0 / (SELECT count(*) FROM customer) AS f FROM customer GROUP BY 1),
    g AS (SELECT c_mktsegment, count(*) * 1.0 / (SELECT count(*) FROM customer) AS f FROM customer GROUP BY 1),
    d AS (SELECT c_custkey, score, 'c_acctbal' AS c, abs(c_acctbal - m) / w AS v FROM flagged, s
          UNION ALL SELECT c_custkey, score, 'nation', (0.05 - f) / 0.05 * 3 FROM flagged JOIN n USING (c_nationkey) WHERE f < 0.05
          UNION ALL SELECT c_custkey, score, 'c_mktsegment', (0.05 - f) / 0.05 * 3 FROM flagged JOIN g USING (c_mktsegment) WHERE f < 0.05),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, c) AS rk FROM d)
    SELECT c_custkey, score, string_agg(c, ',' ORDER BY rk) AS drivers, round(max(v), 6) AS deviation FROM r WHERE rk <= 3 GROUP BY 1, 2""",
)
def _(spark, sf):
    table, scored = _scored_customers(spark, sf)
    found = anomaly.drivers(anomaly.flag_anomalies(scored), table, ["c_acctbal", "nation", "c_mktsegment"])
    names = F.array_join(F.transform("drivers", lambda d: d["column"]), ",")
    return rounded(found.select("c_custkey", "score", names.alias("drivers"), F.col("drivers")[0]["deviation"].alias("deviation")))


def _prepared(spark, sf):
    return cluster.prepare(load(spark, sf, "part"), ["p_size", "p_retailprice", "p_type"])


@query("cluster_prepare")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return _prepared(spark, sf).select("p_partkey", F.round(v[0], 6).alias("f0"), F.round(v[1], 6).alias("f1"), F.size(v).alias("width"))


@query("kmeans")
def _(spark, sf):
    return cluster.kmeans(_prepared(spark, sf), 4).select("p_partkey", "cluster")


def _dbscan(spark, sf):
    ready = cluster.prepare(load(spark, sf, "part"), ["p_size", "p_retailprice"])
    return cluster.dbscan(ready, "features", "p_partkey", 0.08, 8)


@query("dbscan")
def _(spark, sf):
    return _dbscan(spark, sf).select("p_partkey", "cluster")


@query("best_k")
def _(spark, sf):
    return rounded(cluster.best_k(_prepared(spark, sf)))


@query("silhouette")
def _(spark, sf):
    labelled = cluster.kmeans(_prepared(spark, sf), 3)
    value = cluster.silhouette(labelled)
    return spark.createDataFrame([(round(value, 6), cluster.silhouette_band(value))], "silhouette double, band string")


@query("pca_projection")
def _(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    points, shares = cluster.project(e)
    return points.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.lit(round(sum(shares), 6)).alias("explained"))


# labels that both engines can derive: return flags as clusters, R as noise
_LABELLED = "z AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS cluster FROM lineitem)"


def _labelled(spark, sf):
    flag = F.col("l_returnflag")
    return load(spark, sf, "lineitem").withColumn("cluster", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(-1))


@query("cluster_counts", f"WITH {_LABELLED} SELECT count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS clusters, count(*) FILTER (WHERE cluster < 0) AS noise FROM z")
def _(spark, sf):
    return cluster.cluster_counts(_labelled(spark, sf))


@query(
    "cluster_numeric_profile",
    f"""WITH {_LABELLED}, k AS (SELECT * FROM z WHERE cluster >= 0)
    SELECT cluster, 'l_quantity' AS "column", round(avg(l_quantity), 6) AS cluster_mean, round((SELECT avg(l_quantity) FROM k), 6) AS global_mean,
           round((avg(l_quantity) - (SELECT avg(l_quantity) FROM k)) / (SELECT stddev_samp(l_quantity) FROM k), 6) + 0.0 AS z FROM k GROUP BY 1
    UNION ALL SELECT cluster, 'l_extendedprice', round(avg(l_extendedprice), 6), round((SELECT avg(l_extendedprice) FROM k), 6),
           round((avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM k)) / (SELECT stddev_samp(l_extendedprice) FROM k), 6) + 0.0 FROM k GROUP BY 1""",
)
def _(spark, sf):
    return rounded(cluster.numeric_profile(_labelled(spark, sf), ["l_quantity", "l_extendedprice"]))


@query(
    "cluster_categorical_profile",
    f"""WITH {_LABELLED}, k AS (SELECT cluster, l_linestatus AS v FROM z WHERE cluster >= 0), c AS (SELECT cluster, v, count(*) AS n FROM k GROUP BY 1, 2),
    m AS (SELECT cluster, v, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS rk, sum(n) OVER (PARTITION BY cluster) AS size FROM c),
    g AS (SELECT v, count(*) AS n FROM k GROUP BY 1), t AS (SELECT count(*) AS t FROM k)
    SELECT m.cluster, 'l_linestatus' AS "column", m.v AS cluster_mode, (SELECT v FROM g ORDER BY n DESC, v LIMIT 1) AS global_mode, round(m.n / m.size, 6) AS share, round(g.n * 1.0 / t, 6) AS global_share,
           round((m.n / m.size - g.n * 1.0 / t) / sqrt(g.n * 1.0 / t * (1 - g.n * 1.0 / t)), 6) + 0.0 AS z FROM m JOIN g ON g.v = m.v, t WHERE rk = 1""",
)
def _(spark, sf):
    return rounded(cluster.categorical_profile(_labelled(spark, sf), ["l_linestatus"]))


@query(
    "cluster_feature_order",
    f"""WITH {_LABELLED}, k AS (SELECT * FROM z WHERE cluster >= 0),
    p AS (SELECT cluster, 'l_quantity' AS "column", round((avg(l_quantity) - (SELECT avg(l_quantity) FROM k)) / (SELECT stddev_samp(l_quantity) FROM k), 2) + 0.0 AS z, count(*) AS size FROM k GROUP BY 1
    UNION ALL SELECT cluster, 'l_discount', round((avg(l_discount) - (SELECT avg(l_discount) FROM k)) / (SELECT stddev_samp(l_discount) FROM k), 2) + 0.0, count(*) FROM k GROUP BY 1
    UNION ALL SELECT cluster, 'l_tax', round((avg(l_tax) - (SELECT avg(l_tax) FROM k)) / (SELECT stddev_samp(l_tax) FROM k), 2) + 0.0, count(*) FROM k GROUP BY 1)
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, "column") AS rank FROM p""",
)
def _(spark, sf):
    out = cluster.characterize(_labelled(spark, sf), ["l_quantity", "l_discount", "l_tax"])
    return rounded(out.select("cluster", "column", "z", "size", "rank"))


@query(
    "export_clustered",
    "SELECT p_partkey, p_size, CASE WHEN p_size <= 40 THEN p_size % 3 ELSE -1 END AS cluster FROM part",
)
def _(spark, sf):
    p = load(spark, sf, "part")
    labels = p.where("p_size <= 40").select("p_partkey", (F.col("p_size") % 3).alias("cluster"))
    return cluster.with_clusters(p.select("p_partkey", "p_size"), labels, "p_partkey")

"""Version, run-record and catalog queries (A1, A2, A8, N). Folders go to the shared checkpoint folder."""

import os
import uuid

from pyspark.sql import functions as F

from ..operators import ingest
from ..session import drop_at_exit, load, shared_dir
from ..sources import files, versions as op
from .registry import query


def _folder(spark):
    """A fresh folder on storage all executors reach, gone at the end of the session."""
    path = os.path.join(shared_dir(spark), f"tables-{uuid.uuid4().hex}")
    drop_at_exit(spark, path)
    return path


@query("read_delimited", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, sf):
    path = _folder(spark)
    load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.csv(path, sep=";", header=True)
    return files.read_delimited(spark, path)


@query("read_column_arrays", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, sf):
    path = _folder(spark)
    c = load(spark, sf, "customer")
    names = ["c_custkey", "c_name", "c_nationkey"]
    # one document of arrays per nation
    c.groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("r")).select(
        F.transform("r", lambda x: x["c_custkey"]).alias("c_custkey"), F.transform("r", lambda x: x["c_name"]).alias("c_name"),
        F.transform("r", lambda x: F.col("c_nationkey")).alias("c_nationkey"),
    ).write.json(path)
    return files.read_column_arrays(spark, path, one_per_line=True).select(*names)


@query("ingest", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = _folder(spark)
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.csv(path, header=True)
    return ingest.ingest(files.read_delimited(spark, path))


@query(
    "version_round_trip",
    """SELECT 1 AS version, '' AS note, count(*) AS rows, 6 AS cols FROM orders UNION ALL SELECT 2, 'big', count(*), 6 FROM orders WHERE o_totalprice > 250000
    UNION ALL SELECT 3, 'Restored from version 1', count(*), 6 FROM orders""",
)
def _(spark, sf):
    root, o = _folder(spark), load(spark, sf, "orders")
    op.append_version(o, root)
    op.append_version(o.where("o_totalprice > 250000"), root, "big")
    op.restore_version(spark, root, 1)
    return op.manifest(spark, root).select("version", "note", "rows", "cols")


@query("version_restore", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    root = _folder(spark)
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    op.append_version(o, root)
    op.append_version(o.where("o_totalprice > 250000"), root)
    op.restore_version(spark, root, 1)
    return op.read_version(spark, root)


@query(
    "version_list",
    "SELECT 2 AS version, 'second' AS note FROM region WHERE r_regionkey = 0 UNION ALL SELECT 1, 'first' FROM region WHERE r_regionkey = 0",
)
def _(spark, sf):
    root, s = _folder(spark), load(spark, sf, "supplier")
    op.append_version(s, root, "first")
    op.append_version(s.drop("s_acctbal"), root, "second")
    return op.list_versions(spark, root).select("version", "note")


@query("version_metadata", "SELECT 1 AS version, count(*) AS rows, 4 AS cols, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns FROM supplier")
def _(spark, sf):
    root = _folder(spark)
    op.append_version(load(spark, sf, "supplier"), root)
    return op.version_metadata(spark, root, 1).withColumn("columns", F.array_join("columns", ","))


@query(
    "upsert_latest",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rk FROM events) WHERE rk = 1""",
)
def _(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    half = F.col("event_id") < 5000
    return op.upsert_latest(e.where(half), e.where(~half), ["user_id", "event_type"], "ts").drop("ts")


@query(
    "upsert_null_times",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t IS NOT NULL DESC, t DESC, event_id DESC) AS rk
    FROM (SELECT user_id, event_id, value, CASE WHEN user_id % 3 <> 0 AND event_id % 2 = 0 THEN ts END AS t FROM events)) WHERE rk = 1""",
)
def _(spark, sf):
    """Times that are null for some rows of a key or for all of them; ties go to updates, which have the larger ids."""
    t = F.when((F.col("user_id") % 3 != 0) & (F.col("event_id") % 2 == 0), F.col("ts")).alias("t")
    e = load(spark, sf, "events").select("user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), "value", t)
    old = F.col("event_id") < "000000000400"
    done = op.upsert_latest(e.where(old), e.where(~old), ["user_id"], "t")
    return done.select("user_id", F.col("event_id").cast("long").alias("event_id"), "value")


@query(
    "update_repeated_keys",
    """SELECT c_custkey, c_name, coalesce(p, c_acctbal) AS c_acctbal FROM customer
    LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(spark, sf):
    """Several updates to a key: the latest that gives a value counts, and no row is repeated."""
    o = load(spark, sf, "orders")
    given = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("c_acctbal")
    new = o.select(F.col("o_custkey").alias("c_custkey"), given, F.struct("o_orderdate", "o_orderkey").alias("at"))
    return op.update_rows(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey", at="at")


@query(
    "export_round_trip",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN (SELECT p_type FROM part WHERE p_size % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE p_type END AS p_type FROM part",
)
def _(spark, sf):
    """The cleaned table written as CSV and read back, every cell a string."""
    path, gap = _folder(spark), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("p_type")
    files.export_clean(load(spark, sf, "part").select("p_partkey", "p_name", gap), path)
    back = files.read_delimited(spark, path, ",")
    return back.withColumn("p_partkey", F.col("p_partkey").cast("double").cast("long").cast("string"))


@query("delete_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    o, c = load(spark, sf, "orders", "customer")
    gone = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return op.delete_rows(o.select("o_orderkey", "o_custkey"), gone)


@query(
    "update_rows",
    """SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def _(spark, sf):
    c = load(spark, sf, "customer")
    new = c.where("c_nationkey in (3, 5)").select(
        "c_custkey", F.when(F.col("c_nationkey") == 3, 0.0).alias("c_acctbal"), F.when(F.col("c_nationkey") == 5, "MOVED").alias("c_mktsegment")
    )
    return op.update_rows(c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, "c_custkey")


@query(
    "retain_latest",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rk FROM events) WHERE rk <= 50",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    return op.retain_latest(e, ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id")


# runs derived from orders: one per customer, the priority as model
_RUNS = """r AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, min(o_orderpriority) AS model, min(o_orderdate) AS created_at, min(o_totalprice) AS rmse, max(o_totalprice) AS r2 FROM orders GROUP BY 1)"""


def _runs(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(
        F.min("o_orderpriority").alias("model"),
        F.min("o_orderdate").alias("created_at"),
        F.create_map(F.lit("rmse"), F.min("o_totalprice"), F.lit("r2"), F.max("o_totalprice")).alias("metrics"),
    )


@query("list_runs", f"WITH {_RUNS} SELECT run_id, model FROM r WHERE model = '1-URGENT' ORDER BY created_at DESC, run_id LIMIT 100")
def _(spark, sf):
    return op.list_runs(_runs(spark, sf), 100, "1-URGENT").select("run_id", "model")


@query("best_runs", f"WITH {_RUNS} SELECT model, arg_min(run_id, rmse) AS run_id, min(rmse) AS value FROM r GROUP BY 1")
def _(spark, sf):
    return op.best_runs(_runs(spark, sf), "rmse")


@query(
    "compare_runs",
    f"""WITH {_RUNS}, l AS (SELECT run_id, model, 'rmse' AS metric, rmse AS value FROM r UNION ALL SELECT run_id, model, 'r2', r2 FROM r)
    SELECT *, value = CASE metric WHEN 'rmse' THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END AS best FROM l""",
)
def _(spark, sf):
    return op.compare_runs(_runs(spark, sf))


# a catalog of datasets derived from parts: brand as name, types as tags
_DATASETS = """d AS (SELECT p_brand AS name, list_sort(list(DISTINCT p_type)) AS tags, count(*) AS rows, max(p_size) AS cols, max(p_size) % 2 = 0 AS favorite,
    TIMESTAMP '2024-01-01' + to_days(CAST(count(*) AS INTEGER)) AS created_at, CASE WHEN min(p_partkey) % 3 <> 0 THEN TIMESTAMP '2025-01-01' + to_days(CAST(min(p_partkey) AS INTEGER)) END AS last_opened_at FROM part GROUP BY 1)"""


def _datasets(spark, sf):
    day = lambda start, n: F.timestamp_add("DAY", n.cast("int"), F.lit(start).cast("timestamp_ntz"))
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.array_sort(F.collect_set("p_type")).alias("tags"),
        F.count(F.lit(1)).alias("rows"),
        F.max("p_size").alias("cols"),
        (F.max("p_size") % 2 == 0).alias("favorite"),
        day("2024-01-01 00:00:00", F.count(F.lit(1))).alias("created_at"),
        F.when(F.min("p_partkey") % 3 != 0, day("2025-01-01 00:00:00", F.min("p_partkey"))).alias("last_opened_at"),
    )


@query("catalog_tags", "SELECT DISTINCT p_type AS tag FROM part")
def _(spark, sf):
    return op.unique_tags(_datasets(spark, sf))


@query("catalog_recent", f"WITH {_DATASETS} SELECT name FROM d WHERE last_opened_at IS NOT NULL ORDER BY last_opened_at DESC, name LIMIT 5")
def _(spark, sf):
    return op.recently_opened(_datasets(spark, sf)).select("name")


@query(
    "catalog_search",
    f"WITH {_DATASETS} SELECT name, rows FROM d WHERE lower(name) LIKE '%brand#1%' AND list_contains(tags, 'PROMO') AND favorite = (SELECT count(*) > 0 FROM part)",
)
def _(spark, sf):
    return op.search_datasets(_datasets(spark, sf), " BRAND#1", favorites=True, tags=["PROMO"], sort="size").select("name", "rows")

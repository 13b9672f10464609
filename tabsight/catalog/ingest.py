"""Ingest, cleaning, schema and preview queries (A, B9-B12)."""

from pyspark.sql import functions as F

from ..functions.columns import parse_number, rounded
from ..operators import ingest as op
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query


@query(
    "normalize_missing",
    f"""WITH {MESSY_ORDERS_SQL}
    SELECT o_orderkey, CASE WHEN trim(priority) <> '' THEN priority END AS priority, price,
           CASE WHEN trim(cust_text) <> '' THEN cust_text END AS cust_text, status FROM messy""",
)
def _(spark, sf):
    return op.normalize_missing(messy_orders(spark, sf))


@query(
    "coerce_numeric",
    f"""WITH {MESSY_ORDERS_SQL}
    SELECT count(price) AS prices, round(sum(cust), 4) AS cust_sum, count(cust) AS custs, min(priority) AS first_priority
    FROM (SELECT price, CASE WHEN trim(priority) <> '' THEN priority END AS priority,
                 CAST(CASE WHEN trim(cust_text) <> '' THEN cust_text END AS DOUBLE) AS cust FROM messy)""",
)
def _(spark, sf):
    df = op.coerce_numeric(op.normalize_missing(messy_orders(spark, sf)))
    return df.agg(
        F.count("price").alias("prices"),
        F.round(F.sum("cust_text"), 4).alias("cust_sum"),
        F.count("cust_text").alias("custs"),
        F.min("priority").alias("first_priority"),
    )


@query(
    "stringify_categoricals",
    "SELECT event_id, user_id, event_type, value, props, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM events",
)
def _(spark, sf):
    df = op.stringify_categoricals(load(spark, sf, "events"))
    return df.withColumn("ts", F.substring("ts", 1, 16))


@query(
    "export_clean",
    f"""WITH {MESSY_ORDERS_SQL},
    n AS (SELECT o_orderkey, price, CASE WHEN trim(priority) <> '' THEN priority END AS priority,
                 CASE WHEN trim(cust_text) <> '' THEN cust_text END AS cust_text FROM messy),
    p AS (SELECT priority FROM n WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    c AS (SELECT cust_text FROM n WHERE cust_text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, round(coalesce(price, (SELECT avg(price) FROM n)), 4) AS price,
           coalesce(priority, (SELECT priority FROM p)) AS priority,
           coalesce(cust_text, (SELECT cust_text FROM c)) AS cust_text
    FROM n""",
)
def _(spark, sf):
    return rounded(op.clean_for_export(messy_orders(spark, sf), '["status"]'), 4)


@query(
    "impute_missing",
    f"""WITH {MESSY_ORDERS_SQL}, n AS (SELECT price, CASE WHEN trim(priority) <> '' THEN priority END AS priority FROM messy)
    SELECT coalesce(priority, (SELECT priority FROM n WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
           count(*) AS n, round(sum(coalesce(price, (SELECT avg(price) FROM n))), 2) AS total
    FROM n GROUP BY 1""",
)
def _(spark, sf):
    df = op.impute_missing(op.normalize_missing(messy_orders(spark, sf)).select("priority", "price"))
    return df.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(
    "drop_duplicate_rows",
    "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def _(spark, sf):
    return load(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query(
    "apply_cleaning",
    f"""WITH {MESSY_ORDERS_SQL}
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, coalesce(price, round((SELECT avg(price) FROM messy), 2)) AS price, status
    FROM messy""",
)
def _(spark, sf):
    plan = spark.createDataFrame(
        [("cust_text", "drop_column"), ("priority", "drop_column"), ("price", "impute_missing")],
        "column string, suggested_action string",
    )
    return op.apply_cleaning(messy_orders(spark, sf), plan)


@query(
    "number_parse_commas",
    """SELECT o_orderkey, CAST(replace(s, ',', '') AS DOUBLE) AS value
    FROM (SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS s FROM orders)""",
)
def _(spark, sf):
    o = load(spark, sf, "orders")
    text = F.concat(F.lit(" "), F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), "^$", "0"), F.lit(" "))
    return o.select("o_orderkey", parse_number(text).alias("value"))


@query(
    "sanitize_result",
    """SELECT event_id, round(value, 4) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (SELECT count(*) FROM events) > 1000 AS truncated
    FROM events ORDER BY event_id LIMIT 1000""",
)
def _(spark, sf):
    df = load(spark, sf, "events").select("event_id", F.round("value", 4).alias("value"), "ts").orderBy("event_id")
    return op.sanitize_result(df)


@query(
    "schema_summary",
    """WITH s AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION SELECT 'p_brand', p_brand FROM part
               UNION SELECT 'p_type', p_type FROM part UNION SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part
               UNION SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part UNION SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) AS rk FROM s)
    SELECT "column", CASE "column" WHEN 'p_partkey' THEN 'bigint' WHEN 'p_size' THEN 'int' WHEN 'p_retailprice' THEN 'double' ELSE 'string' END AS dtype,
           string_agg(v, '|' ORDER BY v) AS samples FROM r WHERE rk <= 3 GROUP BY "column" """,
)
def _(spark, sf):
    df = op.schema_summary(load(spark, sf, "part"))
    return df.select("column", "dtype", F.array_join("samples", "|").alias("samples"))


_TYPES = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))


@query("schema_browser", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS present FROM events""" for c, t in _TYPES))
def _(spark, sf):
    return op.browse_schema(load(spark, sf, "events")).drop("position")


@query("preview", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def _(spark, sf):
    return op.preview(load(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"])

"""Event-time queries (S), run here on the whole table; the tests run them on a stream too."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.ranks import melt, value_counts
from ..operators import timelines
from ..session import load, materialize
from ..sources import sketches
from ..streaming import events as op
from .registry import query


def _at(name):
    return F.date_format(F.col(name).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "sessions",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events, round(sum(value), 4) AS total
    FROM s GROUP BY user_id, sid""",
)
def _(spark, sf):
    s = op.sessions(load(spark, sf, "events"), "user_id", "ts", "value")
    return s.select("user_id", _at("start"), _at("end"), "events", F.round("total", 4).alias("total"))


@query(
    "sessions_hot_user",
    """WITH h AS (SELECT ts, value, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id FROM events),
    g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM h),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events, round(sum(value), 4) AS total
    FROM s GROUP BY user_id, sid""",
)
def _(spark, sf):
    hot = load(spark, sf, "events").withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END"))
    s = timelines.sessions(hot, "user_id", "ts", "value")
    return s.select("user_id", _at("start"), _at("end"), "events", F.round("total", 4).alias("total"))


_SKETCHED = ["value", "user_id", "event_type"]


@query(
    "sketch_profile",
    """SELECT 'value' AS "column", count(*) AS "rows", count(*) - count(value) AS missing, CAST(min(value) AS DOUBLE) AS "min", CAST(max(value) AS DOUBLE) AS "max",
           count(DISTINCT value) AS "unique", true AS unique_near, 3 AS quantiles_near FROM events
    UNION ALL SELECT 'user_id', count(*), count(*) - count(user_id), min(user_id), max(user_id), count(DISTINCT user_id), true, 3 FROM events
    UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), NULL, NULL, count(DISTINCT event_type), true, 0 FROM events""",
)
def _(spark, sf):
    """Sketches of every day merged, beside the exact values: distinct counts within four standard errors, ranks within twice the stated error."""
    e = load(spark, sf, "events")
    probs = (0.25, 0.5, 0.75)
    found = sketches.merged(materialize(sketches.sketch(e, _SKETCHED, F.to_date("ts"))), probs).withColumnRenamed("unique", "estimate")
    exact = value_counts(e, _SKETCHED).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    ranks = melt(e, _SKETCHED).where("number is not null").join(F.broadcast(found.select("column", "q")), "column")  # one row per column
    spread = [F.avg((F.col("number") < F.col("q")[i]).cast("double")) - p <= 2 * sketches.RANK_ERROR for i, p in enumerate(probs)]
    spread = [s & (F.avg((F.col("number") <= F.col("q")[i]).cast("double")) - p >= -2 * sketches.RANK_ERROR) for i, (s, p) in enumerate(zip(spread, probs))]
    near = ranks.groupBy("column").agg(sum((s.cast("int") for s in spread), F.lit(0)).alias("quantiles_near"))
    out = found.join(exact, "column").join(near, "column", "left")
    off = F.abs(F.col("estimate") - F.col("unique")) <= F.greatest(F.lit(1.0), F.col("unique") * 4 * sketches.DISTINCT_ERROR)
    return out.select("column", "rows", "missing", "min", "max", "unique", off.alias("unique_near"), F.coalesce("quantiles_near", F.lit(0)).alias("quantiles_near"))


@query(
    "incremental_profile",
    """WITH e AS (SELECT *, date_trunc('day', ts) AS d FROM events)
    SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, 'value' AS "column", count(*) AS "count", count(*) - count(value) AS missing, count(value) AS numbers, round(sum(value), 4) AS "sum", min(value) AS "min", max(value) AS "max" FROM e GROUP BY d
    UNION ALL SELECT strftime(d, '%Y-%m-%d %H:%M:%S'), 'user_id', count(*), 0, count(user_id), round(sum(user_id), 4), min(user_id), max(user_id) FROM e GROUP BY d
    UNION ALL SELECT strftime(d, '%Y-%m-%d %H:%M:%S'), 'event_type', count(*), 0, 0, NULL, NULL, NULL FROM e GROUP BY d""",
)
def _(spark, sf):
    p = op.incremental_profile(load(spark, sf, "events"), "ts", columns=["value", "user_id", "event_type"])
    return rounded(p.withColumn("start", _at("start")), 4)


@query(
    "trust_alerts",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, 'net_price' AS "column", count(*) AS checks, count(*) FILTER (WHERE value - 30 < 0) AS violations FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = load(spark, sf, "events").select("ts", (F.col("value") - 30).alias("net_price"))
    return op.trust_alerts(e, "ts").withColumn("start", _at("start"))


@query(
    "sliding_stats",
    """WITH e AS (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)) AS start, value FROM events, range(24) t(h))
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM e GROUP BY 1""",
)
def _(spark, sf):
    s = op.sliding_stats(load(spark, sf, "events"), "ts", "value")
    return rounded(s.withColumn("start", _at("start")))

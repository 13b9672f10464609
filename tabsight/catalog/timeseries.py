"""Time-series queries (H). Orders have days without rows, so grids get filled."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import timeseries as op
from ..session import load
from .registry import query

# daily means of orders per status, on the full calendar, straight lines in the gaps;
# prices are converted by a rate so that means do not end on a rounding tie
RATE = 1.0937
DAILY = f"""p AS (SELECT o_orderstatus AS k, o_orderdate AS ts, avg(o_totalprice / {RATE}) AS v FROM orders GROUP BY 1, 2),
    e AS (SELECT k, min(ts) AS lo, max(ts) AS hi, date_diff('day', min(ts), max(ts)) + 1 AS size FROM p GROUP BY k),
    g AS (SELECT k, lo, size, unnest(range(size)) AS idx FROM e),
    j AS (SELECT g.k, g.idx, g.size, g.lo + to_days(CAST(g.idx AS INTEGER)) AS ts, p.v FROM g LEFT JOIN p ON p.k = g.k AND p.ts = g.lo + to_days(CAST(g.idx AS INTEGER))),
    n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY k ORDER BY idx) AS pi,
                 min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY k ORDER BY idx DESC) AS qi FROM j),
    y AS (SELECT n.k, n.idx, n.size, n.ts, CASE WHEN n.v IS NOT NULL THEN n.v ELSE a.v + (b.v - a.v) * (n.idx - pi) / (qi - pi) END AS v
          FROM n LEFT JOIN j a ON a.k = n.k AND a.idx = pi LEFT JOIN j b ON b.k = n.k AND b.idx = qi)"""


def _orders(spark, sf):
    return load(spark, sf, "orders").withColumn("price", F.col("o_totalprice") / RATE)


def _day(c="ts"):
    return F.date_format(c, "yyyy-MM-dd").alias("ts")


@query(
    "detect_datetime_column",
    "SELECT 'o_orderdate' AS \"column\", 'type' AS reason FROM orders LIMIT 1",
)
def _(spark, sf):
    return op.detect_datetime_column(load(spark, sf, "orders"))


@query("detect_datetime_text", "SELECT 'day' AS \"column\", 'name' AS reason FROM orders LIMIT 1")
def _(spark, sf):
    o = load(spark, sf, "orders")
    texts = o.select("o_orderstatus", F.date_format("o_orderdate", "yyyy/MM/dd").alias("stamp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return op.detect_datetime_column(texts)


@query(
    "ts_prepare",
    "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS ts, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2",
)
def _(spark, sf):
    rows = op.prepare(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return rounded(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "ts_frequency",
    """WITH u AS (SELECT DISTINCT 'daily' AS k, o_orderdate AS ts FROM orders UNION SELECT DISTINCT 'monthly', date_trunc('month', o_orderdate) FROM orders
        UNION SELECT DISTINCT 'weekly', date_trunc('week', o_orderdate) FROM orders),
    g AS (SELECT k, ts, date_diff('day', lag(ts) OVER (PARTITION BY k ORDER BY ts), ts) AS gap FROM u)
    SELECT k, CASE WHEN k = 'monthly' THEN 'month' WHEN count(DISTINCT gap) = 1 THEN 'micro' ELSE 'day' END AS unit,
           CASE WHEN k = 'monthly' THEN 1 WHEN count(DISTINCT gap) = 1 THEN max(gap) * 86400000000 ELSE 86400000000 END AS step,
           CASE WHEN k <> 'monthly' AND count(DISTINCT gap) > 1 THEN date_diff('day', min(ts), max(ts)) + 1 ELSE count(*) END AS size FROM g GROUP BY k""",
)
def _(spark, sf):
    o = load(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    kinds = F.array(
        F.struct(F.lit("daily").alias("k"), day.alias("t")),
        F.struct(F.lit("weekly").alias("k"), F.date_trunc("week", day).cast("timestamp_ntz").alias("t")),
        F.struct(F.lit("monthly").alias("k"), F.date_trunc("month", day).cast("timestamp_ntz").alias("t")),
    )
    long = o.select(F.inline(kinds), "o_totalprice")
    return op.frequency(op.prepare(long, "t", "o_totalprice", ["k"]), ["k"]).drop("lo")


@query(
    "ts_interpolated_grid",
    f"WITH {DAILY} SELECT k AS o_orderstatus, idx, strftime(ts, '%Y-%m-%d') AS ts, round(v, 4) AS value FROM y",
)
def _(spark, sf):
    rows = op.regular_series(_orders(spark, sf), "o_orderdate", "price", ["o_orderstatus"])
    return rounded(rows.select("o_orderstatus", "idx", _day(), "value"), 4)


@query(
    "ts_seasonal_period",
    f"WITH {DAILY} SELECT k AS o_orderstatus, CASE WHEN max(size) <= 14 THEN greatest(2, max(size) // 2) ELSE 7 END AS period FROM y GROUP BY k",
)
def _(spark, sf):
    rows = op.frequency(op.prepare(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"]), ["o_orderstatus"])
    return rows.select("o_orderstatus", op.seasonal_period().alias("period"))


@query(
    "ts_decompose",
    f"""WITH {DAILY},
    m AS (SELECT *, CASE WHEN idx >= 3 AND idx <= size - 4 THEN avg(v) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS t0 FROM y),
    e1 AS (SELECT k, regr_slope(t0, idx) AS s, regr_intercept(t0, idx) AS b FROM m WHERE idx >= 3 AND idx < 10 GROUP BY k),
    e2 AS (SELECT k, regr_slope(t0, idx) AS s, regr_intercept(t0, idx) AS b FROM m WHERE idx <= size - 4 AND idx > size - 11 GROUP BY k),
    t AS (SELECT m.*, coalesce(t0, CASE WHEN idx < 3 THEN e1.b + e1.s * idx ELSE e2.b + e2.s * idx END) AS trend FROM m JOIN e1 USING (k) JOIN e2 USING (k)),
    ph AS (SELECT k, idx % 7 AS phase, avg(v - trend) AS pm FROM t GROUP BY 1, 2), c AS (SELECT k, avg(pm) AS c FROM ph GROUP BY 1)
    SELECT t.k AS o_orderstatus, idx, strftime(ts, '%Y-%m-%d') AS ts, round(v, 4) AS observed, round(trend, 4) AS trend, round(pm - c, 4) + 0.0 AS seasonal,
           round(v - trend - (pm - c), 4) + 0.0 AS residual,
           round(avg(v) OVER (PARTITION BY t.k ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_mean,
           round(coalesce(stddev_samp(v) OVER (PARTITION BY t.k ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 4) AS rolling_std
    FROM t JOIN ph ON ph.k = t.k AND ph.phase = idx % 7 JOIN c ON c.k = t.k""",
)
def _(spark, sf):
    d = op.decompose(_orders(spark, sf), "o_orderdate", "price", ["o_orderstatus"])
    return rounded(d.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "ts_rolling",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(v) AS v FROM (SELECT event_type, ts, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT event_type, strftime(day, '%Y-%m-%d') AS ts,
           round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_mean,
           round(coalesce(stddev_samp(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0), 6) AS rolling_std FROM d""",
)
def _(spark, sf):
    rows = op.regular_series(load(spark, sf, "events"), "ts", "value", ["event_type"])
    out = op.rolling_stats(rows, ["event_type"], window=5)
    return rounded(out.select("event_type", _day(), "rolling_mean", "rolling_std"))


@query(
    "ts_forecast_ar",
    f"""WITH RECURSIVE {DAILY}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY idx) AS d FROM y),
    l AS (SELECT *, lag(d) OVER (PARTITION BY k ORDER BY idx) AS d1 FROM d),
    f AS (SELECT k, greatest(-0.99, least(0.99, sum(d * d1) / sum(CASE WHEN d IS NOT NULL THEN d1 * d1 END))) AS phi, arg_max(v, idx) AS last, arg_max(d, idx) AS ld, max(ts) AS hi FROM l GROUP BY k),
    s AS (SELECT l.k, avg(pow(d - phi * d1, 2)) AS s2 FROM l JOIN f USING (k) GROUP BY 1),
    r AS (SELECT k, 1 AS h, last + ld * phi AS mean, ld * phi AS inc, 1.0::DOUBLE AS psi, 1.0::DOUBLE AS ss FROM f
          UNION ALL SELECT r.k, h + 1, mean + inc * phi, inc * phi, psi * phi + 1, ss + pow(psi * phi + 1, 2) FROM r JOIN f USING (k) WHERE h < 14)
    SELECT k AS o_orderstatus, h AS step_ahead, strftime(hi + to_days(h), '%Y-%m-%d') AS ts, round(mean, 4) AS forecast,
           round(mean - 1.959963984540054 * sqrt(s2 * ss), 4) AS lower, round(mean + 1.959963984540054 * sqrt(s2 * ss), 4) AS upper
    FROM r JOIN f USING (k) JOIN s USING (k)""",
)
def _(spark, sf):
    f = op.forecast_ar(_orders(spark, sf), "o_orderdate", "price", 14, ["o_orderstatus"])
    return rounded(f.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "ts_forecast_seasonal",
    f"""WITH {DAILY}, f AS (SELECT k, regr_slope(v, idx) AS s, regr_intercept(v, idx) AS b, max(size) AS size, max(ts) AS hi FROM y GROUP BY k),
    r AS (SELECT y.*, v - (b + s * idx) AS r0, dayofweek(ts) AS dow, month(ts) AS mon FROM y JOIN f USING (k)),
    w AS (SELECT k, dow, avg(r0) AS w FROM r GROUP BY 1, 2), r1 AS (SELECT r.*, r0 - w AS r1 FROM r JOIN w USING (k, dow)),
    m AS (SELECT k, mon, avg(r1) AS m FROM r1 WHERE size > 365 GROUP BY 1, 2),
    z AS (SELECT r1.k, stddev_pop(r1 - coalesce(m, 0)) AS z FROM r1 LEFT JOIN m USING (k, mon) GROUP BY 1),
    a AS (SELECT f.*, h, size - 1 + h AS idx, hi + to_days(CAST(h AS INTEGER)) AS ts FROM f, range(1, 15) t(h))
    SELECT a.k AS o_orderstatus, h AS step_ahead, strftime(ts, '%Y-%m-%d') AS ts, round(b + s * idx + w + coalesce(m, 0), 4) AS forecast,
           round(b + s * idx + w + coalesce(m, 0) - 1.959963984540054 * z, 4) AS lower, round(b + s * idx + w + coalesce(m, 0) + 1.959963984540054 * z, 4) AS upper
    FROM a JOIN w ON w.k = a.k AND w.dow = dayofweek(a.ts) LEFT JOIN m ON m.k = a.k AND m.mon = month(a.ts) JOIN z ON z.k = a.k""",
)
def _(spark, sf):
    f = op.forecast_seasonal(_orders(spark, sf), "o_orderdate", "price", 14, ["o_orderstatus"])
    return rounded(f.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "ts_history_and_forecast",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(v) AS v FROM (SELECT ts, avg(value) AS v FROM events GROUP BY 1) GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS ts, round(v, 6) AS observed, CAST(NULL AS DOUBLE) AS forecast FROM d
    UNION ALL SELECT strftime(max(day) + 1, '%Y-%m-%d'), round(arg_max(v, day), 6), round(arg_max(v, day), 6) FROM d""",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    past = op.regular_series(e, "ts", "value").select("ts", "value")
    both = op.history_and_forecast(past, op.forecast_ar(e, "ts", "value", 1))
    return rounded(both.select(_day(), "observed", "forecast"))

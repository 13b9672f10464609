"""Chart queries (F)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import charts as op, profile as prof
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query


@query(
    "scatter_fit",
    """SELECT count(*) AS n, round(corr(l_extendedprice, l_quantity), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
    CASE WHEN abs(corr(l_extendedprice, l_quantity)) > 0.7 THEN 'strong' WHEN abs(corr(l_extendedprice, l_quantity)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN corr(l_extendedprice, l_quantity) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM lineitem""",
)
def _(spark, sf):
    fit = op.scatter_fit(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(fit.withColumn("intercept", F.round("intercept", 4)))


@query("scatter_points")
def _(spark, sf):
    return op.chart(load(spark, sf, "orders"), "scatter", "o_custkey", "o_totalprice", key=["o_orderkey"])


@query("quick_scatter")
def _(spark, sf):
    return op.scatter(load(spark, sf, "events"), "user_id", "value", ["event_id"], points=400)


def histogram_sql(col, source, bins_sql):
    return f"""WITH s AS (SELECT CAST(count({col}) AS DOUBLE) AS n, CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi,
        quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM {source}),
    b AS (SELECT *, CAST({bins_sql} AS BIGINT) AS bins FROM s), w AS (SELECT *, (hi - lo) / bins AS width FROM b),
    c AS (SELECT CAST(least(floor(({col} - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM {source}, w GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * width, 6) AS lo, round(lo + (g.bin + 1) * width, 6) AS hi, coalesce(c.n, 0) AS n,
           g.bin = (SELECT bin FROM c ORDER BY n DESC, bin LIMIT 1) AS peak
    FROM (SELECT unnest(range(bins)) AS bin FROM b) g LEFT JOIN c ON c.bin = g.bin, w"""


AUTO_BINS = "ceil((hi - lo) / least(2 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1)))"


@query("histogram", histogram_sql("l_extendedprice", "lineitem", AUTO_BINS))
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "lineitem"), "histogram", "l_extendedprice"))


_TAIL = "CASE WHEN l_orderkey = (SELECT min(l_orderkey) FROM lineitem) THEN 1e7 ELSE l_quantity END"


@query("histogram_long_tail", f"SELECT * FROM ({histogram_sql('v', f'(SELECT {_TAIL} AS v FROM lineitem)', AUTO_BINS)}) WHERE n > 0")
def _(spark, sf):
    """A few values far beyond all others: very many bins, nearly all of them empty."""
    d = load(spark, sf, "lineitem")
    least = d.agg(F.min("l_orderkey")).scalar()
    far = d.select(F.when(F.col("l_orderkey") == least, F.lit(1e7)).otherwise(F.col("l_quantity")).alias("v"))
    return rounded(op.histogram(far, "v").where("n > 0"))


@query("histogram_auto_12", histogram_sql("o_totalprice", "orders", "12"))
def _(spark, sf):
    return rounded(op.auto_histogram(load(spark, sf, "orders"), "o_totalprice"))


def box_sql(value, source, group):
    q = ", ".join(f"round(quantile_cont(CAST({value} AS DOUBLE), {p}), 6) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    return f'SELECT {group} AS "group", round(min({value}), 6) AS "min", {q}, round(max({value}), 6) AS "max" FROM {source} GROUP BY 1'


@query("boxplot", box_sql("l_extendedprice", "lineitem", "'l_extendedprice'"))
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "lineitem"), "boxplot", "l_extendedprice"))


@query("boxplot_grouped", box_sql("o_totalprice", "orders", "o_orderpriority"))
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "orders"), "boxplot", "o_orderpriority", "o_totalprice"))


@query(
    "box_segments",
    f"""SELECT "group", "min" AS base, round(q1 - "min", 4) AS whisker_low, round(median - q1, 4) AS box_low,
        round(q3 - median, 4) AS box_high, round("max" - q3, 4) AS whisker_high FROM ({box_sql('value', 'events', 'event_type')})""",
)
def _(spark, sf):
    return rounded(op.box_segments(op.boxplot(load(spark, sf, "events"), "value", "event_type")), 4)


@query(
    "kde",
    """WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, 1.06 * stddev_pop(value) * pow(count(*), -0.2) AS h FROM events)
    SELECT CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 99, 6) AS x,
           round(sum(exp(-0.5 * pow((value - (lo + i * (hi - lo) / 99)) / h, 2))) / max(n * h * sqrt(2 * pi())), 8) AS density
    FROM events, s, range(100) g(i) GROUP BY i, lo, hi""",
)
def _(spark, sf):
    k = op.chart(load(spark, sf, "events"), "kde", "value")
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("bar_mean", "SELECT p_brand AS category, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1")
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "part"), "bar", "p_brand", "p_retailprice"))


@query(
    "bar_filtered",
    "SELECT l_returnflag AS category, round(avg(l_extendedprice), 6) AS value FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linestatus IN ('F') GROUP BY 1",
)
def _(spark, sf):
    picked = [{"column": "l_quantity", "type": "numeric", "value": [10, 20]}, {"column": "l_linestatus", "type": "categorical", "value": ["F"]}]
    return rounded(op.chart(load(spark, sf, "lineitem"), "bar", "l_returnflag", "l_extendedprice", filters=picked))


@query(
    "heatmap_many_values",
    """WITH c AS (SELECT l_linestatus AS x, CAST(l_partkey AS VARCHAR) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT x, y, coalesce(n, 0) AS count FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)""",
)
def _(spark, sf):
    return op.chart(load(spark, sf, "lineitem"), "heatmap", "l_linestatus", "l_partkey")


@query(
    "heatmap",
    """SELECT a.x, b.y, (SELECT count(*) FROM part WHERE p_brand = a.x AND p_type = b.y) AS "count"
    FROM (SELECT DISTINCT p_brand AS x FROM part) a, (SELECT DISTINCT p_type AS y FROM part) b""",
)
def _(spark, sf):
    return op.chart(load(spark, sf, "part"), "heatmap", "p_brand", "p_type")


@query(
    "grouped_bar",
    """SELECT l_returnflag AS name, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    return op.chart(load(spark, sf, "lineitem"), "grouped_bar", "l_returnflag", "l_linestatus")


@query(
    "line",
    """WITH r AS (SELECT o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_totalprice) - 1 AS position, count(*) OVER () AS n FROM orders)
    SELECT position, strftime(o_orderdate, '%Y-%m-%d') AS x, round(o_totalprice, 4) AS y FROM r WHERE position % (CASE WHEN n > 2000 THEN n // 2000 ELSE 1 END) = 0""",
)
def _(spark, sf):
    pts = op.chart(load(spark, sf, "orders"), "line", "o_orderdate", "o_totalprice")
    return pts.select("position", F.date_format("x", "yyyy-MM-dd").alias("x"), F.round("y", 4).alias("y"))


@query(
    "line_direction",
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY user_id, value) - 1 AS p, count(*) OVER () AS n FROM events),
    k AS (SELECT * FROM r WHERE p % (CASE WHEN n > 2000 THEN n // 2000 ELSE 1 END) = 0)
    SELECT CASE WHEN arg_max(value, p) > arg_min(value, p) THEN 'increasing' ELSE 'decreasing' END AS direction FROM k""",
)
def _(spark, sf):
    return op.line_direction(op.line(load(spark, sf, "events"), "user_id", "value"))


@query(
    "pie",
    """WITH c AS (SELECT p_brand AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk FROM part GROUP BY 1)
    SELECT CASE WHEN rk <= 8 THEN name ELSE 'Other' END AS name, CAST(sum(n) AS BIGINT) AS value, round(sum(n) * 100.0 / (SELECT count(*) FROM part), 1) AS pct
    FROM c GROUP BY 1""",
)
def _(spark, sf):
    return op.chart(load(spark, sf, "part"), "pie", "p_brand")


@query("treemap_count", "SELECT p_brand AS name, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return op.chart(load(spark, sf, "part"), "treemap", "p_brand")


@query("treemap_sum", "SELECT c_name AS name, round(sum(c_acctbal), 4) AS value FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "customer"), "treemap", "c_name", "c_acctbal"), 4)


@query("funnel", "SELECT source AS stage, count(*) AS value FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return op.chart(load(spark, sf, "documents"), "funnel", "source")


@query(
    "waterfall",
    """WITH d AS (SELECT p_brand AS name, sum(p_retailprice) AS delta FROM part GROUP BY 1 ORDER BY 1 LIMIT 15),
    e AS (SELECT name, delta, sum(delta) OVER (ORDER BY name) AS upto FROM d)
    SELECT name, round(upto - delta, 2) AS start, round(upto, 2) AS "end", round(delta, 2) AS delta FROM e""",
)
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "part"), "waterfall", "p_brand", "p_retailprice"), 2)


@query("gauge", 'SELECT round(avg(s_acctbal), 6) AS value, min(s_acctbal) AS "min", max(s_acctbal) AS "max" FROM supplier')
def _(spark, sf):
    return rounded(op.chart(load(spark, sf, "supplier"), "gauge", "s_acctbal"))


@query("top_categories", "SELECT p_name AS name, count(*) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, sf):
    return op.top_categories(load(spark, sf, "part"), "p_name")


@query("mini_bar", "SELECT substr(p_name, 1, 12) AS name, n AS value FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
def _(spark, sf):
    return op.top_categories(load(spark, sf, "part"), "p_name", keep=5, width=12)


@query("monthly_line", "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(op.monthly_line(load(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 4)


@query(
    "missing_widget",
    f"""WITH {MESSY_ORDERS_SQL} SELECT * FROM (
    SELECT 'priority' AS name, round(count(*) FILTER (WHERE coalesce(trim(priority), '') = '') * 100.0 / count(*), 6) AS missing_pct FROM messy
    UNION ALL SELECT 'price', round(count(*) FILTER (WHERE price IS NULL) * 100.0 / count(*), 6) FROM messy
    UNION ALL SELECT 'cust_text', round(count(*) FILTER (WHERE trim(cust_text) = '') * 100.0 / count(*), 6) FROM messy)""",
)
def _(spark, sf):
    return rounded(op.missing_widget(prof.profile(messy_orders(spark, sf))))


@query(
    "chart_insights",
    """SELECT 'bar' AS chart, printf('Largest: %s with %.2f.', c, v) AS insight FROM (SELECT l_returnflag AS c, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 1)
    UNION ALL SELECT 'boxplot', printf('Highest median: %s with %.2f.', c, v) FROM (SELECT o_orderpriority AS c, quantile_cont(o_totalprice / 1.0937, 0.5) AS v FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 1)
    UNION ALL SELECT 'gauge', printf('Average %.2f within %.2f to %.2f.', avg(value), min(value), max(value)) FROM events""",
)
def _(spark, sf):
    l, o, e = load(spark, sf, "lineitem", "orders", "events")
    made = {
        "bar": op.bar(l, "l_returnflag", "l_extendedprice"),
        # converted by a rate, so that no median ends on a rounding tie of the text
        "boxplot": op.boxplot(o.withColumn("price", F.col("o_totalprice") / 1.0937), "price", "o_orderpriority"),
        "gauge": op.gauge(e, "value"),
    }
    out = None
    for kind, data in made.items():
        one = op.insight(data, kind).select(F.lit(kind).alias("chart"), "insight")
        out = one if out is None else out.unionByName(one)
    return out

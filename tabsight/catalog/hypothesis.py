"""Hypothesis-test queries (G)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import hypothesis as op, profile as prof
from ..session import load
from .registry import query

_TWO = """WITH a AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'F'),
    b AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'O')"""


@query(
    "t_test",
    f"""{_TWO} SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic,
    round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS dof,
    'F' AS group1, a.n AS n1, round(a.m, 6) AS mean1, 'O' AS group2, b.n AS n2, round(b.m, 6) AS mean2 FROM a, b""",
)
def _(spark, sf):
    t = op.t_test(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")
    t = t.select("statistic", F.round("dof", 4).alias("dof"), "group1", "n1", "mean1", "group2", "n2", "mean2")
    return rounded(t)


@query("z_test", f"{_TWO} SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic, a.n AS n1, b.n AS n2 FROM a, b")
def _(spark, sf):
    return rounded(op.z_test(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus").select("statistic", "n1", "n2"))


@query(
    "anova",
    """WITH g AS (SELECT o_orderstatus AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
    t AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS n, count(*) AS k FROM g)
    SELECT round((sum(g.n * pow(m - grand, 2)) / (max(k) - 1)) / (sum((g.n - 1) * v) / (max(t.n) - max(k))), 6) AS statistic,
           CAST(max(k) - 1 AS DOUBLE) AS dof_between, CAST(max(t.n) - max(k) AS DOUBLE) AS dof_within, max(k) AS groups,
           arg_max(s, m) AS highest, round(max(m), 4) AS highest_mean, arg_min(s, m) AS lowest, round(min(m), 4) AS lowest_mean FROM g, t""",
)
def _(spark, sf):
    a = op.anova(load(spark, sf, "orders"), "o_totalprice", "o_orderstatus").drop("p_value", "significant", "interpretation")
    a = a.withColumn("highest_mean", F.round("highest_mean", 4)).withColumn("lowest_mean", F.round("lowest_mean", 4))
    return rounded(a)


def chi_sql(a, b, source):
    """Every cell of the table, empty ones included."""
    return f"""WITH r AS (SELECT {a} AS a, count(*) AS ra FROM {source} GROUP BY 1), c AS (SELECT {b} AS b, count(*) AS cb FROM {source} GROUP BY 1),
    o AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2), t AS (SELECT count(*) AS t FROM {source}),
    d AS (SELECT (count(DISTINCT {a}) - 1) * (count(DISTINCT {b}) - 1) AS dof FROM {source}),
    x AS (SELECT coalesce(o.n, 0) AS obs, ra * cb / CAST(t AS DOUBLE) AS e FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b)
    SELECT round(sum(pow(abs(obs - e) - CASE WHEN dof = 1 THEN least(0.5, abs(obs - e)) ELSE 0 END, 2) / e), 6) AS statistic, max(dof) AS dof, max(t) AS n FROM x, d, t"""


@query("chi_square", chi_sql("o_orderstatus", "o_orderpriority", "orders"))
def _(spark, sf):
    return rounded(op.chi_square(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select("statistic", "dof", "n"))


@query("chi_square_two_by_two", chi_sql("l_linestatus", "(l_returnflag = 'R')", "lineitem"))
def _(spark, sf):
    l = load(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").alias("returned"))
    return rounded(op.chi_square(l, "l_linestatus", "returned").select("statistic", "dof", "n"))


@query("chi_square_sparse", chi_sql("p_brand", "p_name", "part"))
def _(spark, sf):
    return rounded(op.chi_square(load(spark, sf, "part"), "p_brand", "p_name").select("statistic", "dof", "n"))


@query(
    "contingency_table",
    """WITH r AS (SELECT l_returnflag AS a, count(*) AS ra FROM lineitem GROUP BY 1), c AS (SELECT l_linestatus AS b, count(*) AS cb FROM lineitem GROUP BY 1)
    SELECT a, b, count(*) AS observed, round(max(ra) * max(cb) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 6) AS expected
    FROM lineitem JOIN r ON a = l_returnflag JOIN c ON b = l_linestatus GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(op.contingency(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("a", "b", "observed", "expected"))


@query(
    "confidence_interval",
    "SELECT round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 8) AS sem, count(*) AS n FROM events",
)
def _(spark, sf):
    c = op.confidence_interval(load(spark, sf, "events"), "value", 0.95)
    return c.select(F.round("mean", 6).alias("mean"), F.round("sem", 8).alias("sem"), "n")


@query(
    "eligible_columns",
    """SELECT * FROM (VALUES ('test_value','o_orderkey'),('test_value','o_custkey'),('test_value','o_totalprice'),
    ('test_group','o_orderstatus'),('test_group','o_orderdate'),('test_group','o_orderpriority'),
    ('clustering','o_orderkey'),('clustering','o_custkey'),('clustering','o_totalprice'),('clustering','o_orderstatus'),('clustering','o_orderpriority'),
    ('time_axis','o_orderdate'),('time_value','o_orderkey'),('time_value','o_custkey'),('time_value','o_totalprice')) t(role, name)
    WHERE (SELECT count(*) FROM orders) > 0""",
)
def _(spark, sf):
    return op.eligible_columns(prof.profile(load(spark, sf, "orders")))

"""Rule, chart-plan, fact and constraint queries (C16-C26, F19-F21, M, X)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import constraints, dependency, profile as prof, trust
from ..plans import chartplan, facts as facts_plan, rules
from ..session import load, materialize
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query

# a table with something to find: odd ages, negative money, constants, far dates, gaps, skew
ODD_SQL = """odd AS (SELECT l_quantity * 3 - 1 AS passenger_age, l_discount * 1200 AS discount_pct, l_extendedprice - 2000 AS net_price,
    7 AS fixed, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_linenumber < 5 THEN NULL ELSE l_quantity END AS sparse,
    pow(l_quantity / 50.0, 12) AS steep, l_shipdate + INTERVAL 40 YEAR AS start_date, l_shipdate AS end_date,
    CASE WHEN l_linenumber = 1 AND l_quantity < 20 THEN 'B' ELSE 'A' END AS grade FROM lineitem)"""


def settled(df):
    """The profile, written once: several rules read it."""
    return materialize(prof.profile(df))


def odd(spark, sf):
    l = load(spark, sf, "lineitem")
    line = F.col("l_linenumber")
    return l.select(
        (F.col("l_quantity") * 3 - 1).alias("passenger_age"),
        (F.col("l_discount") * 1200).alias("discount_pct"),
        (F.col("l_extendedprice") - 2000).alias("net_price"),
        F.lit(7).alias("fixed"),
        F.when(line != 3, F.col("l_tax")).alias("tax"),
        F.when(line >= 5, F.col("l_quantity")).alias("sparse"),
        F.pow(F.col("l_quantity") / 50.0, 12).alias("steep"),
        (F.col("l_shipdate") + F.make_ym_interval(F.lit(40))).alias("start_date"),
        F.col("l_shipdate").alias("end_date"),
        F.when((line == 1) & (F.col("l_quantity") < 20), "B").otherwise("A").alias("grade"),
    )


_SKEW = "avg(pow(steep - (SELECT avg(steep) FROM odd), 3)) / pow(stddev_pop(steep), 3)"
_CELLS = "(count(*) - count(tax) + count(*) - count(sparse)) * 100.0 / (count(*) * 10)"
_DUP = "(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM odd GROUP BY passenger_age, discount_pct, net_price, fixed, tax, sparse, steep, start_date, end_date, grade))"


@query(
    "human_errors",
    f"""WITH {ODD_SQL} SELECT * FROM (
    SELECT 'age_above_130' AS rule, 'passenger_age' AS "column", max(passenger_age) AS value FROM odd HAVING max(passenger_age) > 130
    UNION ALL SELECT 'age_below_zero', 'passenger_age', min(passenger_age) FROM odd HAVING min(passenger_age) < 0
    UNION ALL SELECT 'percent_range', 'discount_pct', max(discount_pct) FROM odd HAVING max(discount_pct) > 100
    UNION ALL SELECT 'negative_money', 'net_price', count(*) FILTER (WHERE net_price < 0) FROM odd HAVING min(net_price) < 0
    UNION ALL SELECT 'far_future', 'start_date', CAST(year(max(start_date)) AS DOUBLE) FROM odd HAVING year(max(start_date)) > 2031)""",
)
def _(spark, sf):
    return rules.human_errors(settled(odd(spark, sf)), 2026).select("rule", "column", "value")


@query(
    "near_duplicate_categories",
    f"""WITH {MESSY_ORDERS_SQL} SELECT 'status' AS "column", lower(trim(status)) AS normal, count(DISTINCT status) AS variants, count(*) AS rows,
    min(status) AS first, max(status) AS last FROM messy GROUP BY 2 HAVING count(DISTINCT status) > 1""",
)
def _(spark, sf):
    return rules.near_duplicate_categories(messy_orders(spark, sf), ["priority", "status"])


@query(
    "contradictions",
    f"""WITH {ODD_SQL} SELECT 'start_after_end' AS rule, 'start_date' AS "column" FROM odd HAVING min(start_date) > max(end_date)
    UNION ALL SELECT 'mean_far_from_median', c FROM (
      SELECT 'steep' AS c, avg(steep) AS m, quantile_cont(steep, 0.5) AS q, stddev_samp(steep) AS s FROM odd
      UNION ALL SELECT 'net_price', avg(net_price), quantile_cont(net_price, 0.5), stddev_samp(net_price) FROM odd) WHERE abs(m - q) > 2 * s""",
)
def _(spark, sf):
    return rules.contradictions(settled(odd(spark, sf))).select("rule", "column")


@query("start_after_end_rows", f"WITH {ODD_SQL} SELECT count(*) FILTER (WHERE start_date > end_date) AS violations, count(*) AS checked FROM odd")
def _(spark, sf):
    return rules.start_after_end_rows(odd(spark, sf), "start_date", "end_date")


@query(
    "behavior_notes",
    f"""WITH {ODD_SQL}, m AS (SELECT {_CELLS} AS m, {_DUP} AS dup FROM odd),
    b AS (SELECT greatest(count(*) FILTER (WHERE grade = 'A'), count(*) FILTER (WHERE grade = 'B')) * 1.0 / count(*) AS top, {_SKEW} AS sk FROM odd),
    f AS (SELECT quantile_cont(steep, 0.25) AS q1, quantile_cont(steep, 0.75) AS q3 FROM odd),
    o AS (SELECT count(*) FILTER (WHERE steep > q3 + 1.5 * (q3 - q1) OR steep < q1 - 1.5 * (q3 - q1)) > 0.05 * count(*) AS noisy FROM odd, f)
    SELECT 1 AS seq, CASE WHEN m > 15 THEN 'sparse' WHEN m > 3 THEN 'mildly_sparse' ELSE 'dense' END AS rule, round(m, 6) AS value FROM m
    UNION ALL SELECT 2, 'duplicate_rows', dup FROM m WHERE dup > 0
    UNION ALL SELECT 4, 'constant_columns', 1.0 FROM m
    UNION ALL SELECT 5, 'imbalanced_columns', 1.0 FROM b WHERE top > 0.8
    UNION ALL SELECT 6, 'outlier_columns', 1.0 FROM o WHERE noisy""",
)
def _(spark, sf):
    df = odd(spark, sf)
    return rounded(rules.behavior(settled(df), materialize(prof.dataset_shape(df))))


@query(
    "risks",
    f"""WITH {ODD_SQL} SELECT * FROM (SELECT 'skewed' AS rule, 'steep' AS "column", round({_SKEW}, 4) AS value, 'high' AS severity FROM odd HAVING abs({_SKEW}) > 1.5
    UNION ALL SELECT 'dominated', 'grade', round(count(*) FILTER (WHERE grade = 'A') * 1.0 / count(*), 4), 'high' FROM odd HAVING count(*) FILTER (WHERE grade = 'A') > 0.85 * count(*)
    UNION ALL SELECT 'high_cardinality', 'net_price', round(CAST(count(DISTINCT net_price) AS DOUBLE), 4), 'high' FROM odd HAVING count(DISTINCT net_price) > 0.5 * count(*))""",
)
def _(spark, sf):
    df = odd(spark, sf)
    found = rules.risks(settled(df), materialize(prof.dataset_shape(df)))
    return found.select("rule", "column", F.round("value", 4).alias("value"), rules.severity(F.col("text")).alias("severity"))


@query(
    "recommended_actions",
    f"""WITH {ODD_SQL} SELECT 'drop_duplicates' AS rule, NULL AS "column", CAST(d AS DOUBLE) AS value FROM (SELECT {_DUP} AS d) WHERE d > 0
    UNION ALL SELECT 'drop_constant', 'fixed', 1.0
    UNION ALL SELECT 'impute_median', 'tax', round((count(*) - count(tax)) * 100.0 / count(*), 4) FROM odd
    UNION ALL SELECT 'drop_sparse', 'sparse', round((count(*) - count(sparse)) * 100.0 / count(*), 4) FROM odd
    UNION ALL SELECT 'transform_skew', 'steep', round({_SKEW}, 4) FROM odd
    UNION ALL SELECT 'group_rare', 'net_price', CAST(count(DISTINCT net_price) AS DOUBLE) FROM odd HAVING count(DISTINCT net_price) > 0.5 * count(*)""",
)
def _(spark, sf):
    df = odd(spark, sf)
    acts = rules.recommended_actions(settled(df), materialize(prof.dataset_shape(df)))
    return acts.select("rule", "column", F.round("value", 4).alias("value"))


@query(
    "insight_list",
    f"""WITH {ODD_SQL} SELECT 1 AS seq, 'missing' AS tag, 'sparse' AS "column", round((count(*) - count(sparse)) * 100.0 / count(*), 4) AS value, 0.99 AS confidence FROM odd
    UNION ALL SELECT 2, 'duplicates', NULL, round({_DUP} * 100.0 / count(*), 4), 0.98 FROM odd HAVING {_DUP} > 0
    UNION ALL SELECT 3, 'distribution', 'passenger_age', round(avg(passenger_age), 4), 0.9 FROM odd
    UNION ALL SELECT 3, 'distribution', 'discount_pct', round(avg(discount_pct), 4), 0.9 FROM odd
    UNION ALL SELECT 3, 'distribution', 'net_price', round(avg(net_price), 4), 0.9 FROM odd
    UNION ALL SELECT 4, 'composition', 'grade', round(count(*) FILTER (WHERE grade = 'A') * 100.0 / count(*), 4), 0.85 FROM odd
    UNION ALL SELECT 5, 'relationship', 'passenger_age / sparse', 1.0, 0.8 FROM odd HAVING abs(corr(passenger_age, sparse)) > 0.999999
    UNION ALL SELECT 6, 'time_range', 'start_date', CAST(year(max(start_date)) AS DOUBLE), 0.95 FROM odd""",
)
def _(spark, sf):
    df = odd(spark, sf)
    matrix = dependency.pearson(df, min_pairs=3, max_cols=12).withColumn("pearson", F.round("pearson", 9))
    out = rules.insights(settled(df), materialize(prof.dataset_shape(df)), matrix)
    return out.withColumn("value", F.round("value", 4))


@query(
    "risk_level",
    f"""WITH {ODD_SQL}, m AS (SELECT {_CELLS} AS m, {_DUP} AS dup, max(passenger_age) > 130 OR min(passenger_age) < 0 OR max(discount_pct) > 100 OR min(net_price) < 0 OR year(max(start_date)) > 2031 AS errs,
        min(start_date) > max(end_date) AS clash, CAST(abs({_SKEW}) > 1.5 AS INT) + CAST(count(*) FILTER (WHERE grade = 'A') > 0.85 * count(*) AS INT) + CAST(count(DISTINCT net_price) > 0.5 * count(*) AS INT) AS risks FROM odd),
    p AS (SELECT CASE WHEN m > 20 THEN 3 WHEN m > 5 THEN 1 ELSE 0 END + CASE WHEN dup > 0 THEN 1 ELSE 0 END + CASE WHEN risks >= 4 THEN 2 WHEN risks > 0 THEN 1 ELSE 0 END
        + CASE WHEN errs THEN 2 ELSE 0 END + CASE WHEN clash THEN 1 ELSE 0 END AS points FROM m)
    SELECT points, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM p""",
)
def _(spark, sf):
    df = odd(spark, sf)
    p, s = settled(df), materialize(prof.dataset_shape(df))
    return rules.risk_level(s, rules.risks(p, s), rules.human_errors(p, 2026), rules.contradictions(p))


@query(
    "cleaning_suggestions",
    f"""WITH {ODD_SQL} SELECT 'tax' AS "column", 'impute_missing' AS suggested_action, 'medium' AS severity, printf('%.1f%% of values missing', round((count(*) - count(tax)) * 100.0 / count(*), 1)) AS issue FROM odd
    UNION ALL SELECT 'sparse', 'drop_column', 'high', printf('%.1f%% of values missing', round((count(*) - count(sparse)) * 100.0 / count(*), 1)) FROM odd
    UNION ALL SELECT 'fixed', 'drop_column', 'high', 'only one value'
    UNION ALL SELECT 'net_price', 'group_rare_categories', 'low', 'many distinct values' FROM odd HAVING count(DISTINCT net_price) > 0.5 * count(*)""",
)
def _(spark, sf):
    return rules.cleaning_suggestions(settled(odd(spark, sf)))


@query(
    "health_advice",
    f"""WITH {ODD_SQL} SELECT 'balance_classes' AS rule, 'grade' AS "column", round(count(*) FILTER (WHERE grade = 'A') * 1.0 / count(*), 4) AS value FROM odd HAVING count(*) FILTER (WHERE grade = 'A') > 0.85 * count(*)
    UNION ALL SELECT 'impute_or_drop', 'sparse', round((count(*) - count(sparse)) * 100.0 / count(*), 4) FROM odd""",
)
def _(spark, sf):
    df = odd(spark, sf)
    return rounded(rules.health_advice(settled(df), materialize(prof.dataset_shape(df))), 4)


def _plan_sql():
    kinds = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "c", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "c"}
    names = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(kinds.items()))
    return f"""WITH k(pos, name, kind) AS (VALUES {names}),
    s AS (SELECT unnest(CASE kind WHEN 'n' THEN ['histogram', 'kde', 'boxplot', 'gauge'] WHEN 'c' THEN ['pie', 'donut', 'treemap', 'funnel'] ELSE ['treemap', 'funnel'] END) AS chart_type, name AS col1, NULL AS col2 FROM k),
    p AS (SELECT a.name AS col1, b.name AS col2, a.kind AS ka, b.kind AS kb, a.pos < b.pos AS ordered FROM k a JOIN k b ON a.pos <> b.pos)
    SELECT * FROM s UNION ALL SELECT unnest(['scatter', 'line']), col1, col2 FROM p WHERE ka = 'n' AND kb = 'n' AND ordered
    UNION ALL SELECT 'line', col1, col2 FROM p WHERE ka = 'd' AND kb = 'n'
    UNION ALL SELECT unnest(['grouped_bar', 'heatmap']), col1, col2 FROM p WHERE ka <> 'n' AND kb <> 'n' AND ordered
    UNION ALL SELECT unnest(['bar', 'boxplot', 'waterfall', 'treemap']), col1, col2 FROM p WHERE ka <> 'n' AND kb = 'n'"""


@query("chart_plan", _plan_sql())
def _(spark, sf):
    return chartplan.chart_plan(settled(load(spark, sf, "orders")))


@query(
    "auto_charts",
    """SELECT * FROM (VALUES ('auto_histogram', 'o_orderkey', NULL), ('auto_histogram', 'o_custkey', NULL), ('top_categories', 'o_orderstatus', NULL),
    ('top_categories', 'o_orderpriority', NULL), ('monthly_line', 'o_orderdate', 'o_orderkey'), ('quick_scatter', 'o_orderkey', 'o_custkey'), ('correlation', NULL, NULL))
    t(chart_type, col1, col2)""",
)
def _(spark, sf):
    return chartplan.auto_charts(settled(load(spark, sf, "orders")))


@query(
    "default_dashboard",
    """WITH c AS (SELECT CASE WHEN count(DISTINCT p_name) <= greatest(20, floor(count(*) * 0.1)) THEN 'p_name' WHEN count(DISTINCT p_brand) <= greatest(20, floor(count(*) * 0.1)) THEN 'p_brand' ELSE 'p_type' END AS c FROM part)
    SELECT 'histogram' AS chart_type, 'p_partkey' AS col1, NULL AS col2 UNION ALL SELECT 'pie', c, NULL FROM c
    UNION ALL SELECT 'scatter', 'p_partkey', 'p_size' UNION ALL SELECT 'bar', c, 'p_partkey' FROM c""",
)
def _(spark, sf):
    return chartplan.default_dashboard(settled(load(spark, sf, "part")))


def _odd_facts(spark, sf):
    df = odd(spark, sf)
    p = dependency.top_correlations(dependency.pearson(df), "pearson")
    return facts_plan.build_facts(settled(df), materialize(prof.dataset_shape(df)), trust=trust.trust_score(df), pearson=p)


@query(
    "facts",
    f"""WITH {ODD_SQL} SELECT 'shape' AS section, 'table' AS subject, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM odd
    UNION ALL SELECT 'shape', 'table', 'cols', 10.0 UNION ALL SELECT 'shape', 'table', 'duplicates', CAST({_DUP} AS DOUBLE)
    UNION ALL SELECT 'shape', 'table', 'missing_pct', round({_CELLS}, 4) FROM odd
    UNION ALL SELECT 'columns', 'tax', 'missing_pct', round((count(*) - count(tax)) * 100.0 / count(*), 4) FROM odd
    UNION ALL SELECT 'columns', 'sparse', 'missing_pct', round((count(*) - count(sparse)) * 100.0 / count(*), 4) FROM odd
    UNION ALL SELECT 'columns', 'fixed', 'constant', 1.0
    UNION ALL SELECT 'columns', 'net_price', 'high_cardinality', CAST(count(DISTINCT net_price) AS DOUBLE) FROM odd HAVING count(DISTINCT net_price) > 0.5 * count(*)
    UNION ALL SELECT 'dependency', a || ' / ' || b, 'pearson', round(r, 4) FROM (
      SELECT 'passenger_age' AS a, 'net_price' AS b, corr(passenger_age, net_price) AS r FROM odd UNION ALL SELECT 'passenger_age', 'sparse', corr(passenger_age, sparse) FROM odd
      UNION ALL SELECT 'passenger_age', 'steep', corr(passenger_age, steep) FROM odd UNION ALL SELECT 'net_price', 'sparse', corr(net_price, sparse) FROM odd
      UNION ALL SELECT 'net_price', 'steep', corr(net_price, steep) FROM odd UNION ALL SELECT 'sparse', 'steep', corr(sparse, steep) FROM odd) WHERE abs(r) > 0.4""",
)
def _(spark, sf):
    return rounded(_odd_facts(spark, sf).where("section <> 'trust'").drop("text"), 4)


@query(
    "recommendations",
    f"""WITH {ODD_SQL} SELECT 1 AS seq, 'table' AS subject, printf('remove %.0f repeated rows', CAST(d AS DOUBLE)) AS text FROM (SELECT {_DUP} AS d) WHERE d > 0
    UNION ALL SELECT 2, 'tax', printf('fill gaps of tax, %.1f%% is missing', round((count(*) - count(tax)) * 100.0 / count(*), 1)) FROM odd
    UNION ALL SELECT 2, 'sparse', printf('drop sparse, %.1f%% is missing', round((count(*) - count(sparse)) * 100.0 / count(*), 1)) FROM odd
    UNION ALL SELECT 3, 'fixed', 'remove constant column fixed'
    UNION ALL SELECT 4, 'net_price', 'group or hash values of net_price' FROM odd HAVING count(DISTINCT net_price) > 0.5 * count(*)""",
)
def _(spark, sf):
    return facts_plan.recommendations(_odd_facts(spark, sf))


@query(
    "format_consistency",
    """WITH c AS (SELECT 'contact' AS "column", CASE WHEN c_custkey % 10 = 0 THEN 'n/a' WHEN c_custkey % 25 = 1 THEN '+1 555 ' || (1000 + c_custkey) ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS v FROM customer
      UNION ALL SELECT 'c_name', c_name FROM customer),
    f AS (SELECT "column", CASE WHEN v LIKE '%@%' THEN 'email' WHEN v LIKE '+1%' THEN 'phone' WHEN v LIKE 'Customer#%' THEN 'numeric_id' ELSE 'text' END AS format, count(*) AS rows FROM c GROUP BY 1, 2)
    SELECT *, round(rows * 1.0 / sum(rows) OVER (PARTITION BY "column"), 6) AS share, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC) = 1 AS dominant FROM f""",
)
def _(spark, sf):
    return rounded(constraints.format_consistency(contacts(spark, sf), ["contact", "c_name"]))


def contacts(spark, sf):
    c = load(spark, sf, "customer")
    key = F.col("c_custkey")
    contact = (
        F.when(key % 10 == 0, "n/a")
        .when(key % 25 == 1, F.concat(F.lit("+1 555 "), (1000 + key).cast("string")))
        .otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")))
    )
    return c.select("c_custkey", "c_name", contact.alias("contact"))


@query(
    "format_breaks",
    """SELECT c_custkey, c_name, 'contact' AS broken, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE '+1 555 ' || (1000 + c_custkey) END AS contact
    FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 25 = 1""",
)
def _(spark, sf):
    return constraints.format_breaks(contacts(spark, sf), ["contact", "c_name"]).withColumn("broken", F.array_join("broken", ","))


FD_COLUMNS = ["p_brand", "p_type", "p_size", "p_retailprice", "p_name"]


def _fd_sql():
    parts = [
        f"""SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS groups, count(*) FILTER (WHERE k > 1) AS violations
        FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM part GROUP BY 1)"""
        for a in FD_COLUMNS
        for b in FD_COLUMNS
        if a != b
    ]
    unique = " UNION ALL ".join(f"SELECT '{a}' AS c, count(DISTINCT {a}) AS k FROM part" for a in FD_COLUMNS)
    return f"""WITH u AS ({unique}), ok AS (SELECT c FROM u WHERE k > 1 AND k < (SELECT count(*) FROM part))
    SELECT determinant, dependent, groups, violations, round(violations * 1.0 / groups, 6) AS rate FROM ({" UNION ALL ".join(parts)})
    WHERE violations * 1.0 / groups <= 0.9 AND determinant IN (SELECT c FROM ok) AND dependent IN (SELECT c FROM ok)"""


@query("functional_dependencies", _fd_sql())
def _(spark, sf):
    return rounded(constraints.functional_dependencies(load(spark, sf, "part"), FD_COLUMNS, max_violation=0.9))


@query(
    "dependency_violations",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN
    (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)""",
)
def _(spark, sf):
    rows = constraints.dependency_violations(load(spark, sf, "lineitem"), "l_partkey", "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

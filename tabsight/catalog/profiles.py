"""Profile, trust and rule queries (C, D)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import profile as op, trust
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query

# (column, kind) of the tables the profile is checked on
SHAPES = {
    "lineitem": [
        ("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
        ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t"),
    ],
    "orders": [
        ("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "s"),
    ],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"), ("p_retailprice", "n")],
}
NUMBER_SQL = r"regexp_full_match(trim(v), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"


def profile_sql(shape, source) -> str:
    """Independent SQL of the profile: one SELECT per column, united."""
    parts = []
    for pos, (c, kind) in enumerate(shape):
        if kind == "n":
            parts.append(f"""
            SELECT {pos} AS pos, '{c}' AS name, 'numeric' AS type, count(*) AS "count", count(*) - count({c}) AS missing,
                   count(DISTINCT {c}) AS "unique", CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
                   avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, stddev_samp({c}) AS std,
                   quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                   (SELECT count(*) FROM {source} a, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS a3 FROM {source}) f
                    WHERE a.{c} < a1 - 1.5 * (a3 - a1) OR a.{c} > a3 + 1.5 * (a3 - a1)) AS outliers,
                   count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives,
                   (avg(pow(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM {source}), 3)) / pow(stddev_pop({c}), 3)) AS skew,
                   stddev_pop({c}) AS std_pop, NULL AS top, NULL AS min_date, NULL AS max_date FROM {source}""")
        elif kind == "t":
            nulls = ", ".join(f"NULL AS {x}" for x in ('"min"', '"max"', "mean", "median", "std", "q1", "q3", "outliers", "zeros", "negatives", "skew", "std_pop", "top"))
            parts.append(f"""
            SELECT {pos}, '{c}', 'datetime', count(*), count(*) - count({c}), count(DISTINCT {c}), {nulls},
                   strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S') FROM {source}""")
        else:
            nulls = ", ".join(f"NULL AS {x}" for x in ('"min"', '"max"', "mean", "median", "std", "q1", "q3", "outliers", "zeros", "negatives", "skew", "std_pop"))
            parts.append(f"""
            SELECT {pos}, '{c}', CASE WHEN count(DISTINCT v) <= greatest(20, floor(count(v) * 0.1)) THEN 'categorical'
                                      WHEN count(v) > 20 AND count(DISTINCT v) > 0.95 * count(v) THEN 'id' ELSE 'text' END,
                   count(*), count(*) - count(v), count(DISTINCT v), {nulls},
                   (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM {source}
                     WHERE trim({c}) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)), NULL, NULL
            FROM (SELECT CASE WHEN trim({c}) <> '' THEN {c} END AS v FROM {source})""")
    floats = ["min", "max", "mean", "median", "std", "q1", "q3", "skew", "std_pop"]
    return f"""SELECT pos, name, type, "count", missing, "unique", outliers, zeros, negatives, top, min_date, max_date,
        round(missing * 100.0 / "count", 4) AS missing_pct, round("unique" * 100.0 / ("count" - missing), 4) AS unique_pct,
        "unique" <= 1 AS constant, "unique" > 50 AND "unique" * 100.0 / ("count" - missing) > 50 AS high_cardinality,
        {", ".join(f'round("{x}", 4) + 0.0 AS "{x}"' for x in floats)} FROM ({" UNION ALL ".join(parts)})"""


def flat_profile(df):
    p = op.profile(df)
    top = F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string"))), ";")
    return rounded(p.withColumn("top", top).drop("top_values", "is_free_text"), 4)


for _t, _shape in SHAPES.items():

    @query(f"profile_{_t}", profile_sql(_shape, _t))
    def _(spark, sf, t=_t):
        return flat_profile(load(spark, sf, t, spread=True))


_MESSY_SHAPE = [("o_orderkey", "n"), ("priority", "s"), ("price", "n"), ("cust_text", "s"), ("status", "s")]


@query(
    "profile_messy",
    f"""WITH {MESSY_ORDERS_SQL}, typed AS (SELECT o_orderkey, priority, price, CAST(CASE WHEN trim(cust_text) <> '' THEN cust_text END AS DOUBLE) AS cust_text, status FROM messy)
    {profile_sql([(c, 'n' if c == 'cust_text' else k) for c, k in _MESSY_SHAPE], 'typed')}""",
)
def _(spark, sf):
    return flat_profile(messy_orders(spark, sf))


@query(
    "value_votes",
    f"""WITH {MESSY_ORDERS_SQL}, v AS (SELECT 'cust_text' AS name, cust_text AS v FROM messy UNION ALL SELECT 'priority', priority FROM messy
          UNION ALL SELECT 'day', CASE WHEN o_orderkey % 9 = 0 THEN '2024-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders
          UNION ALL SELECT 'flag', CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE ' no' END FROM orders)
    SELECT name, count(*) FILTER (WHERE trim(v) <> '' AND {NUMBER_SQL}) AS numbers,
           count(*) FILTER (WHERE name = 'day' AND TRY_CAST(v AS DATE) IS NOT NULL) AS dates,
           count(*) FILTER (WHERE name = 'flag') AS bools,
           CASE name WHEN 'cust_text' THEN 'numeric' WHEN 'priority' THEN 'categorical' WHEN 'day' THEN 'datetime' ELSE 'boolean' END AS type
    FROM v GROUP BY name""",
)
def _(spark, sf):
    o = load(spark, sf, "orders")
    df = messy_orders(spark, sf).select("o_orderkey", "cust_text", "priority").join(
        o.select(
            "o_orderkey",
            F.when(F.col("o_orderkey") % 9 == 0, "2024-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
            F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise(" no").alias("flag"),
        ),
        "o_orderkey",
    ).drop("o_orderkey")
    facts = op.column_facts(df, df.columns).select(F.col("column").alias("name"), "numbers", "dates", "bools")
    return facts.join(op.profile(df).select("name", "type"), "name")


_WORDS = r"len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))"


@query(
    "free_text_flag",
    f"""SELECT 'text' AS name, avg({_WORDS}) >= 4 AND count(DISTINCT text) > 0.5 * count(*) AS is_free_text FROM documents
    UNION ALL SELECT 'lang', false UNION ALL SELECT 'source', false""",
)
def _(spark, sf):
    return op.profile(load(spark, sf, "documents", spread=True).select("text", "lang", "source")).select("name", "is_free_text")


@query(
    "dataset_shape",
    f"""WITH {MESSY_ORDERS_SQL}, t AS (SELECT priority, price, status FROM messy),
    d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY priority, price, status))
    SELECT count(*) AS rows, 3 AS cols, count(*) * 3 AS total_cells, (SELECT CAST(dup AS BIGINT) FROM d) AS duplicates,
           count(*) FILTER (WHERE coalesce(trim(priority), '') = '') + count(*) - count(price) AS missing_cells,
           round((count(*) FILTER (WHERE coalesce(trim(priority), '') = '') + count(*) - count(price)) * 100.0 / (count(*) * 3), 6) AS missing_pct FROM t""",
)
def _(spark, sf):
    return rounded(op.dataset_shape(messy_orders(spark, sf).select("priority", "price", "status")), 6)


@query(
    "top_values_text",
    """SELECT "column", rk, sha256(value) AS value_digest, n FROM (
      SELECT 'text' AS "column", text AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC,
             CASE WHEN length(text) > 64 THEN 'sha256:' || sha256(text) ELSE text END) AS rk FROM documents WHERE trim(text) <> '' GROUP BY text
      UNION ALL SELECT 'source', source, count(*), row_number() OVER (ORDER BY count(*) DESC, source) FROM documents GROUP BY source) WHERE rk <= 8""",
)
def _(spark, sf):
    top = op.top_values(load(spark, sf, "documents", spread=True), ["text", "source"])
    return top.select("column", "rk", F.sha2(F.col("value").cast("binary"), 256).alias("value_digest"), "n")


@query(
    "column_samples",
    """SELECT 'event_type' AS "column", string_agg(event_type, ',' ORDER BY event_id) AS vals FROM (SELECT * FROM events ORDER BY event_id LIMIT 8)
    UNION ALL SELECT 'user_id', string_agg(user_id, ',' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 8)
    UNION ALL SELECT 'event_id', string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 8)""",
)
def _(spark, sf):
    df = op.column_samples(load(spark, sf, "events").select("event_id", "user_id", "event_type"), ["event_id"])
    return df.select("column", F.array_join("values", ",").alias("vals"))


def trust_sql(source, columns, numeric, rules):
    """Component shares of a table, spelled out in SQL."""
    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')" for c in columns)
    const = " + ".join(f"CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END" for c in columns)
    fences = " UNION ALL ".join(
        f"""SELECT count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o, count(x) AS v FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source}),
            (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"""
        for c in numeric
    )
    bad = " + ".join(f"count(*) FILTER (WHERE {c} < {lo}{'' if hi is None else f' OR {c} > {hi}'})" for c, lo, hi in rules)
    checks = " + ".join(f"count({c})" for c, _, _ in rules)
    return f"""
    SELECT 1.0 - m * 1.0 / (n * {len(columns)}) AS completeness, 1.0 - dup * 1.0 / n AS uniqueness, 1.0 - k / {float(len(columns))} AS structure,
           {'1.0' if not rules else '1.0 - bad * 1.0 / checks'} AS consistency, 1.0 - o * 1.0 / v AS stability, m, dup
    FROM (SELECT count(*) AS n, {missing} AS m, {const} AS k, {bad or '0'} AS bad, {checks or '0'} AS checks FROM {source}),
         (SELECT sum(c - 1) AS dup FROM (SELECT count(*) AS c FROM {source} GROUP BY {', '.join(columns)})),
         (SELECT sum(o) AS o, sum(v) AS v FROM ({fences}))"""


_LINE = [c for c, _ in SHAPES["lineitem"]]
_LINE_NUM = [c for c, k in SHAPES["lineitem"] if k == "n"]
_LINE_TRUST = trust_sql("lineitem", _LINE, _LINE_NUM, [("l_extendedprice", 0, None)])
_SCORE = "CAST(round_even(round((0.30 * completeness + 0.25 * uniqueness + 0.20 * structure + 0.15 * consistency + 0.10 * stability) * 100, 9), 0) AS INTEGER)"
_PARTS = ("completeness", "uniqueness", "structure", "consistency", "stability")


@query(
    "trust_score",
    f"""SELECT {_SCORE} AS score, CASE WHEN {_SCORE} >= 80 THEN 'High' WHEN {_SCORE} >= 55 THEN 'Medium' ELSE 'Low' END AS tier,
    {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)} FROM ({_LINE_TRUST})""",
)
def _(spark, sf):
    return rounded(trust.trust_score(load(spark, sf, "lineitem", spread=True)), 6)


_MESSY_TRUST = trust_sql("typed", ["priority", "price", "status"], ["price"], [("price", 0, None)])


@query(
    "trust_score_messy",
    f"""WITH {MESSY_ORDERS_SQL}, typed AS (SELECT priority, price - 1000 AS price, status FROM messy)
    SELECT {_SCORE} AS score, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)} FROM ({_MESSY_TRUST})""",
)
def _(spark, sf):
    df = messy_orders(spark, sf).select("priority", (F.col("price") - 1000).alias("price"), "status")
    return rounded(trust.trust_score(df).drop("tier"), 6)


@query(
    "trust_breakdown",
    f"""WITH t AS ({_LINE_TRUST})
    SELECT 'Completeness' AS label, round(completeness * 100, 6) AS score, 0.30 AS weight FROM t
    UNION ALL SELECT 'Uniqueness', round(uniqueness * 100, 6), 0.25 FROM t
    UNION ALL SELECT 'Structure', round(structure * 100, 6), 0.20 FROM t
    UNION ALL SELECT 'Consistency', round(consistency * 100, 6), 0.15 FROM t
    UNION ALL SELECT 'Stability', round(stability * 100, 6), 0.10 FROM t""",
)
def _(spark, sf):
    return rounded(trust.trust_breakdown(load(spark, sf, "lineitem", spread=True)).drop("note"), 6)


@query(
    "trust_consistency_checks",
    """SELECT 'l_extendedprice' AS "column", count(*) AS checks, count(*) FILTER (WHERE l_extendedprice < 0) AS violations FROM lineitem
    UNION ALL SELECT 'discount_pct', count(*), count(*) FILTER (WHERE l_discount * 1100 < 0 OR l_discount * 1100 > 100) FROM lineitem
    UNION ALL SELECT 'page_size', count(*), count(*) FILTER (WHERE l_quantity * 3 < 0 OR l_quantity * 3 > 120) FROM lineitem""",
)
def _(spark, sf):
    l = load(spark, sf, "lineitem")
    return trust.consistency(
        l.select("l_extendedprice", (F.col("l_discount") * 1100).alias("discount_pct"), (F.col("l_quantity") * 3).alias("page_size"), "l_tax")
    )

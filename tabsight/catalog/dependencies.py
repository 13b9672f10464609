"""Dependency queries (E)."""

import itertools

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import dependency as op
from ..operators.knnmi import neighbor_information
from ..session import load
from .registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PART = ["p_partkey", "p_size", "p_retailprice"]


def _pairs(names):
    return list(itertools.combinations(range(len(names)), 2))


def pearson_sql(names, source, alias="pearson"):
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{names[i]}' AS col_a, '{names[j]}' AS col_b, coalesce(corr({names[i]}, {names[j]}), 0) AS {alias} FROM {source}"
        for i, j in _pairs(names)
    )


def spearman_sql(names, source):
    """Average ranks per pair on complete rows."""
    parts = []
    for i, j in _pairs(names):
        a, b = names[i], names[j]
        parts.append(f"""SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr(ra, rb), 0) AS spearman FROM (
            SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                   rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
            FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


def mi_sql(names, source, bins=10):
    edges = ", ".join(f"quantile_cont(CAST({n} AS DOUBLE), {[b / bins for b in range(1, bins)]}) AS e{k}" for k, n in enumerate(names))
    binned = ", ".join(f"len(list_filter(list_distinct(e{k}), lambda e: {n} > e)) AS b{k}" for k, n in enumerate(names))
    parts = []
    for i, j in _pairs(names):
        parts.append(f"""SELECT {i} AS i, {j} AS j, greatest(0, sum(n / t * ln(n * t / (na * nb)))) AS mi FROM (
            SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb
            FROM (SELECT b{i} AS a, b{j} AS b, count(*) AS n FROM binned GROUP BY 1, 2))""")
    label = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""WITH edges AS (SELECT {edges} FROM {source}), binned AS (SELECT {binned} FROM {source}, edges), m AS ({" UNION ALL ".join(parts)}),
        full_mi AS (SELECT i, j, mi FROM m UNION ALL SELECT j, i, mi FROM m)
        SELECT {label}[i + 1] AS source, {label}[j + 1] AS target, mi FROM full_mi"""


@query("pearson_matrix", f"SELECT i, j, col_a, col_b, round(pearson, 6) + 0.0 AS pearson FROM ({pearson_sql(NUMBERS, 'lineitem')})")
def _(spark, sf):
    return rounded(op.pearson(load(spark, sf, "lineitem"), NUMBERS))


_GAPS = """g AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS cust,
           o_orderkey, 7 AS fixed FROM orders)"""


def _gaps(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("cust"),
        "o_orderkey",
        F.lit(7).alias("fixed"),
    )


@query(
    "pearson_pairwise_gaps",
    f"""WITH {_GAPS} SELECT i, j, col_a, col_b, CASE WHEN isnan(pearson) THEN 0 ELSE round(pearson, 6) + 0.0 END AS pearson
    FROM ({pearson_sql(['price', 'cust', 'o_orderkey', 'fixed'], 'g')})""",
)
def _(spark, sf):
    return rounded(op.pearson(_gaps(spark, sf)))


@query("spearman_matrix", f"SELECT i, j, col_a, col_b, round(spearman, 6) + 0.0 AS spearman FROM ({spearman_sql(NUMBERS, 'lineitem')})")
def _(spark, sf):
    return rounded(op.spearman(load(spark, sf, "lineitem", spread=True), NUMBERS))


@query(
    "spearman_pairwise_gaps",
    f"WITH {_GAPS} SELECT i, j, col_a, col_b, round(spearman, 6) + 0.0 AS spearman FROM ({spearman_sql(['price', 'cust', 'o_orderkey'], 'g')})",
)
def _(spark, sf):
    return rounded(op.spearman(_gaps(spark, sf).drop("fixed")))


@query(
    "mutual_information",
    f"""SELECT source, target, round(mi, 6) AS mi FROM ({mi_sql(NUMBERS, 'lineitem')})
    UNION ALL SELECT n, n, 1.0 FROM (SELECT unnest({NUMBERS}) AS n)""",
)
def _(spark, sf):
    return rounded(op.mutual_information(load(spark, sf, "lineitem", spread=True), NUMBERS))


@query(
    "dependency_matrix",
    f"""SELECT col_a, col_b, p.i, p.j, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman, round(mi, 6) AS mi
    FROM ({pearson_sql(PART, 'part')}) p JOIN ({spearman_sql(PART, 'part')}) s USING (col_a, col_b)
    JOIN ({mi_sql(PART, 'part')}) m ON m.source = col_a AND m.target = col_b""",
)
def _(spark, sf):
    return rounded(op.dependency(load(spark, sf, "part"), PART))


@query("client_pearson", f"SELECT i, j, col_a, col_b, round(pearson, 6) + 0.0 AS pearson FROM ({pearson_sql(NUMBERS, 'lineitem')})")
def _(spark, sf):
    return rounded(op.pearson(load(spark, sf, "lineitem"), NUMBERS, min_pairs=3, max_cols=12))


@query("heatmap_widget", f"SELECT i, j, col_a, col_b, round(pearson, 6) + 0.0 AS pearson FROM ({pearson_sql(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice'], 'lineitem')})")
def _(spark, sf):
    return rounded(op.pearson(load(spark, sf, "lineitem"), min_pairs=3, max_cols=6))


@query(
    "top_dependencies",
    f"""SELECT 'pearson' AS kind, col_a, col_b, round(pearson, 4) AS score FROM ({pearson_sql(NUMBERS, 'lineitem')}) WHERE abs(pearson) > 0.4
    UNION ALL SELECT 'spearman', col_a, col_b, round(spearman, 4) FROM ({spearman_sql(NUMBERS, 'lineitem')}) WHERE abs(spearman) > 0.4
    UNION ALL SELECT 'mi', source, target, round(mi, 4) FROM ({mi_sql(NUMBERS, 'lineitem')}) WHERE mi > 0.1""",
)
def _(spark, sf):
    df = load(spark, sf, "lineitem")
    p = op.top_correlations(op.pearson(df, NUMBERS), "pearson").withColumnRenamed("correlation", "score")
    s = op.top_correlations(op.spearman(df, NUMBERS), "spearman").withColumnRenamed("correlation", "score")
    m = op.top_mutual_information(op.mutual_information(df, NUMBERS))
    m = m.select(F.lit("mi").alias("kind"), F.col("source").alias("col_a"), F.col("target").alias("col_b"), "score")
    return p.select(F.lit("pearson").alias("kind"), "*").unionByName(s.select(F.lit("spearman").alias("kind"), "*")).unionByName(m)


@query(
    "mutual_information_share",
    f"""WITH full_m AS ({mi_sql(NUMBERS, 'lineitem')}) SELECT source, target, round(mi / (SELECT max(mi) FROM full_m), 6) AS share FROM full_m""",
)
def _(spark, sf):
    m = op.normalized_mutual_information(op.mutual_information(load(spark, sf, "lineitem", spread=True), NUMBERS))
    return rounded(m.drop("mi"))


def _psi(n):
    z = f"(CAST({n} AS DOUBLE) + 10)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) - " + " - ".join(f"1 / (CAST({n} AS DOUBLE) + {j})" for j in range(10)) + ")"


def neighbor_mi_sql(names, source, k=3):
    """All rows against all rows: k-th distance, then counts strictly within it along each column."""
    grid = ", ".join(f"CAST(floor(({n} - (SELECT min({n}) FROM {source})) / (SELECT stddev_pop({n}) FROM {source}) * 1048576.0) AS BIGINT) AS x{i}" for i, n in enumerate(names))
    parts = []
    for i, j in _pairs(names):
        parts.append(f"""SELECT {i} AS i, {j} AS j, '{names[i]}' AS col_a, '{names[j]}' AS col_b,
            round(greatest(0, {_psi('count(*)')} + {_psi(k)} - avg({_psi('nx')}) - avg({_psi('ny')})), 4) + 0.0 AS mi FROM (
            SELECT d.id, count(*) FILTER (WHERE abs(g.x{i} - d.x) <= greatest(d.r - 1, 0)) AS nx, count(*) FILTER (WHERE abs(g.x{j} - d.y) <= greatest(d.r - 1, 0)) AS ny
            FROM g, (SELECT a.id, any_value(a.x{i}) AS x, any_value(a.x{j}) AS y,
                     list_sort(min(greatest(abs(a.x{i} - b.x{i}), abs(a.x{j} - b.x{j})), {k}))[{k}] AS r FROM g a JOIN g b ON a.id <> b.id GROUP BY a.id) d GROUP BY d.id)""")
    return f"WITH g AS (SELECT row_number() OVER () AS id, {grid} FROM {source}) " + " UNION ALL ".join(parts)


@query("mutual_information_neighbors", neighbor_mi_sql(PART, "part"))
def _(spark, sf):
    return rounded(neighbor_information(load(spark, sf, "part"), PART), 4)

"""Filter and formula-column queries (B)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.formula import add_calculated_column
from ..operators import filters as op
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query


@query("filter_numeric_range", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
def _(spark, sf):
    return op.apply_filters(load(spark, sf, "part"), [{"column": "p_size", "type": "numeric", "value": [10, 20]}])


@query("filter_categorical", "SELECT * FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def _(spark, sf):
    return op.apply_filters(load(spark, sf, "part"), [{"column": "p_type", "type": "categorical", "value": ["ECONOMY", "PROMO"]}])


_LISTED = [k / 2 for k in range(1, 2401) if k % 4 != 1]


@query("filter_long_list", f"SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity IN ({', '.join(map(str, _LISTED))}) GROUP BY 1")
def _(spark, sf):
    """More than a thousand values, given as text, of a column of doubles."""
    kept = op.apply_filters(load(spark, sf, "lineitem"), [{"column": "l_quantity", "type": "categorical", "value": [str(v) for v in _LISTED]}])
    return kept.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_conjunction",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem
    WHERE l_quantity BETWEEN 5 AND 30 AND l_returnflag IN ('A', 'R') GROUP BY 1""",
)
def _(spark, sf):
    kept = op.apply_filters(
        load(spark, sf, "lineitem"),
        [
            {"column": "l_quantity", "type": "numeric", "value": [5, 30]},
            {"column": "l_returnflag", "type": "categorical", "value": ["A", "R"]},
            {"column": "l_linestatus", "type": "categorical", "value": []},
            {"column": "nowhere", "type": "categorical", "value": ["x"]},
            {"column": "l_tax", "type": "numeric", "value": None},
        ],
    )
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query(
    "filter_selection",
    """SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_totalprice BETWEEN 100000.0 AND 300000.0 AND o_custkey BETWEEN 95 AND 105 GROUP BY 1""",
)
def _(spark, sf):
    picks = [("o_totalprice", 5), ("o_totalprice", "100000.00 - 300000.00"), ("o_custkey", 100)]
    return op.selection_filter(load(spark, sf, "orders"), picks).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("drop_features", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def _(spark, sf):
    return op.drop_features(load(spark, sf, "part"), ["p_name", "p_type"])


@query("drop_null_target", f"WITH {MESSY_ORDERS_SQL} SELECT status, count(*) AS n FROM messy WHERE price IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return op.with_target(messy_orders(spark, sf), "price").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("complete_pairs", f"WITH {MESSY_ORDERS_SQL} SELECT priority, price FROM messy WHERE price IS NOT NULL AND priority IS NOT NULL")
def _(spark, sf):
    return op.complete_pairs(messy_orders(spark, sf), "priority", "price")


# name -> (formula, SQL over lineitem); totals are rounded to 4 places in both
FORMULAS = {
    "formula_arithmetic": ("l_extendedprice * (1 - l_discount) + l_tax / l_quantity", "l_extendedprice * (1 - l_discount) + l_tax / l_quantity"),
    "formula_floor_mod": (
        "(l_linenumber - 4) // 2 * 100 + (l_linenumber - 4) % 3 + 7 % -3",
        "floor((l_linenumber - 4) / 2.0) * 100 + ((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3.0)) + (7 - (-3) * floor(7 / -3.0))",
    ),
    "formula_power": ("l_linenumber ** 2 - 2 ** l_linenumber", "pow(l_linenumber, 2) - pow(2, l_linenumber)"),
    "formula_div_zero": ("l_quantity / l_discount", "CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END"),
    "formula_round_half_even": ("ROUND(l_linenumber / 2) + ROUND(l_extendedprice * 0.1, 2)", "round_even(l_linenumber / 2.0, 0) + round_even(l_extendedprice * 0.1, 2)"),
    "formula_abs_unary": ("ABS(-l_quantity) - +l_tax", "abs(-l_quantity) - l_tax"),
    "formula_if": ("IF(l_quantity > 25, l_extendedprice, 0) if not l_discount > 0.05 else -1", "CASE WHEN NOT (l_discount > 0.05) THEN CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END ELSE -1 END"),
    "formula_total_avg": ("l_extendedprice - AVG(l_extendedprice)", "l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)"),
    "formula_total_sum_count": ("l_quantity / SUM(l_quantity) * COUNT(l_quantity)", "l_quantity / (SELECT sum(l_quantity) FROM lineitem) * (SELECT count(l_quantity) FROM lineitem)"),
}


def _formula(name, formula, sql):
    total = "total" in name  # sums depend on the order of addition
    value = f"round({sql}, 4) + 0.0" if total else f"CAST({sql} AS DOUBLE)"

    @query(name, f"SELECT l_orderkey, l_partkey, l_linenumber, {value} AS value FROM lineitem")
    def _(spark, sf):
        df = add_calculated_column(load(spark, sf, "lineitem"), "value", formula)
        df = df.select("l_orderkey", "l_partkey", "l_linenumber", "value")
        return rounded(df, 4) if total else df


for _name, (_formula_text, _sql) in FORMULAS.items():
    _formula(_name, _formula_text, _sql)


@query(
    "formula_chained_compare",
    f"""WITH {MESSY_ORDERS_SQL} SELECT o_orderkey, coalesce(100000 < price AND price <= 300000, false) AS mid,
        coalesce(price <> 5, true) AND NOT (coalesce(o_orderkey < 50, false) OR status = 'F') AS other FROM messy""",
)
def _(spark, sf):
    df = add_calculated_column(messy_orders(spark, sf), "mid", "100000 < price <= 300000")
    df = add_calculated_column(df, "other", "price != 5 and not (o_orderkey < 50 or status == 'F')")
    return df.select("o_orderkey", "mid", "other")


@query(
    "formula_isnull_impute",
    f"""WITH {MESSY_ORDERS_SQL} SELECT o_orderkey,
        round(CASE WHEN price IS NULL THEN (SELECT avg(price) FROM messy) ELSE price END, 4) AS price_imputed FROM messy""",
)
def _(spark, sf):
    df = add_calculated_column(messy_orders(spark, sf), "price_imputed", "IF(ISNULL(`price`), AVG(price), price)")
    return rounded(df.select("o_orderkey", "price_imputed"), 4)

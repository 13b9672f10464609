"""Tables with gaps and messy cells, derived from the driver tables in both engines.

The driver tables hold no nulls, so the missing-data operators need some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load

# orders with blanks, nulls, thousands separators and a repeated row pattern
MESSY_ORDERS_SQL = """
messy AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS cust_text,
         CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status
  FROM orders)
"""


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 7 == 0, None).when(k % 11 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 5 == 0, None).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 13 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("cust_text"),
        F.when(k % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
    )

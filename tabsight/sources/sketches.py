"""Column sketches kept as binary columns, merged without reading rows again.

A store is a Parquet folder with one part per label (a day, a table version, a
batch of files). A part holds, per column, its counts, a distinct sketch
and a quantile sketch; any set of parts merges into the facts of their union.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import present, number_of, scalar_columns, value_key, col

DISTINCT_LG = 14  # 2^14 registers: one standard error is 1.04 / 128 = 0.8 %
QUANTILE_K = 1000  # rank error below 0.4 % with 99 % confidence, some 10 KB a sketch
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_LG / 2)
RANK_ERROR = 0.004


def sketch(df: DataFrame, columns: Sequence[str] | None = None, by: Column | None = None) -> DataFrame:
    """(label, column, rows, missing, min, max, distincts, quantiles): one row per label and column.

    `by` is an expression whose text is the label (all rows are '' without it).
    Sketches are built map side: a task ships one of each per label and column.
    `distincts` is null where a column has no value, `quantiles` where it has no number.
    """
    names = list(columns) if columns is not None else scalar_columns(df)
    label = (F.lit("") if by is None else F.coalesce(by.cast("string"), F.lit(""))).alias("label")
    cells = [
        F.struct(
            F.lit(n).alias("column"),
            F.when(present(df, n), value_key(col(n), df.schema[n])).alias("value"),
            F.when(present(df, n), number_of(df, n)).alias("number"),
        )
        for n in names
    ]
    long = df.select(label, F.inline(F.array(*cells)))
    return long.groupBy("label", "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.when(F.count("value") > 0, F.hll_sketch_agg("value", DISTINCT_LG)).alias("distincts"),
        F.when(F.count("number") > 0, F.kll_sketch_agg_double("number", QUANTILE_K)).alias("quantiles"),
    )


def append(sketches: DataFrame, root: str) -> None:
    """Add parts to a store. A label written again replaces its part, so a repeated run changes nothing."""
    sketches.repartition("label").write.partitionBy("label").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def stored(spark: SparkSession, root: str, labels: Sequence[str] | None = None) -> DataFrame:
    """The parts of a store, or those of some labels; only their folders are read."""
    schema = "column string, rows long, missing long, min double, max double, distincts binary, quantiles binary, label string"
    parts = spark.read.schema(schema).parquet(os.fspath(root))
    return parts if labels is None else parts.where(F.col("label").isin(*labels))


def merged(parts: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, rows, missing, min, max, unique, q): facts of the union of all parts.

    `unique` is off by DISTINCT_ERROR of its size (one standard error), the rank of a
    quantile by RANK_ERROR; counts, min and max are exact. Without numbers q is null.
    """
    one = parts.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distincts").alias("d"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("s"),
    )
    at = F.array(*[F.lit(float(p)) for p in probs])
    return one.select(
        "column", "rows", "missing", "min", "max",
        F.coalesce(F.hll_sketch_estimate("d"), F.lit(0)).alias("unique"),
        F.when(F.col("s").isNotNull(), F.kll_sketch_get_quantile_double("s", at)).alias("q"),
    )

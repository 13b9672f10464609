"""Feature preparation for anomaly detection, clustering and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, is_numeric, number_of
from ..functions.ranks import column_quantiles
from .ingest import modes, normalize_missing

# One-hot labels live on the driver; a column with more values is refused.
MAX_LABELS = 10_000


def split_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric = [c for c in columns if is_numeric(df.schema[c])]
    return numeric, [c for c in columns if c not in numeric]


def fill_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric gaps become the median, categorical gaps the mode; categories become strings."""
    df = normalize_missing(df)
    numeric, categorical = split_columns(df, columns)
    medians = {r["column"]: r["q"][0] for r in column_quantiles(df, numeric, [0.5]).collect()} if numeric else {}
    top = {r["column"]: r["value"] for r in modes(df, categorical).collect()} if categorical else {}
    out = df
    for c in numeric:
        out = out.withColumn(c, F.coalesce(number_of(df, c), F.lit(medians.get(c, 0.0))))
    for c in categorical:
        out = out.withColumn(c, F.coalesce(col(c).cast("string"), F.lit(top.get(c, "MISSING"))))
    return out


def check_labels(df: DataFrame, columns: Sequence[str]) -> None:
    """Refuse columns with more than MAX_LABELS values, counted exactly."""
    for c in columns:
        if df.select(col(c)).distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
            raise ValueError(f"{c!r} has more than {MAX_LABELS} values for one-hot features")


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], drop_last: bool = False) -> Pipeline:
    """Standardised numbers and one-hot categories in one vector column `features`."""
    stages, inputs = [], []
    if numeric:
        stages += [
            VectorAssembler(inputCols=list(numeric), outputCol="__numbers", handleInvalid="keep"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        inputs.append("__scaled")
    if categorical:
        index = [f"__i{i}" for i in range(len(categorical))]
        hot = [f"__h{i}" for i in range(len(categorical))]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=drop_last, handleInvalid="keep"),
        ]
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages)

"""Table versions, run records and keyed maintenance, on plain Parquet folders.

One writer per table: a version folder appears first, its manifest row last,
so readers only see finished versions.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import col
from ..operators.metrics import LOWER_IS_BETTER

MANIFEST = "version int, note string, rows long, cols int, columns array<string>, created_at timestamp"


def _manifest_path(root: str) -> str:
    return os.path.join(root, "manifest")


def _version_path(root: str, version: int) -> str:
    return os.path.join(root, f"version={version}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All finished versions; empty before the first one. A storage error is raised, not taken for an empty folder."""
    path = _manifest_path(root)
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_version(df: DataFrame, root: str, note: str = "") -> int:
    """Write the table as the next version and record it; returns the number.

    Nothing is ever overwritten: the number of an unfinished attempt is skipped.
    """
    spark = df.sparkSession
    last = manifest(spark, root).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    while _exists(spark, _version_path(root, version)):
        version += 1
    path = _version_path(root, version)
    df.write.mode("errorifexists").parquet(path)
    rows = spark.read.parquet(path).count()
    entry = spark.createDataFrame([(version, note, rows, len(df.columns), list(df.columns))], "version int, note string, rows long, cols int, columns array<string>")
    entry.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(_manifest_path(root))
    return version


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, note, created_at), newest first, without the data."""
    return manifest(spark, root).select("version", "note", "created_at").orderBy(F.desc("version"))


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One version, by default the latest."""
    chosen = version or manifest(spark, root).agg(F.max("version")).first()[0]
    if not chosen:
        raise ValueError("there is no version yet")
    return spark.read.parquet(_version_path(root, chosen))


def version_metadata(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(version, rows, cols, columns) as recorded when it was written."""
    return manifest(spark, root).where(F.col("version") == version).select("version", "rows", "cols", "columns")


def restore_version(spark: SparkSession, root: str, version: int) -> int:
    """Make an old version the latest by appending it again."""
    if not manifest(spark, root).where(F.col("version") == version).limit(1).count():
        raise ValueError(f"there is no version {version}")
    return append_version(read_version(spark, root, version), root, f"Restored from version {version}")


# -- keyed tables --------------------------------------------------------------


def upsert_latest(table: DataFrame, updates: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Both tables together, only the newest row per key.

    A row without a time is older than any with one; of equal times an update
    wins, then the row that is last as text. max_by keeps one row per key and
    task before the shuffle, so a key with many versions stays cheap.
    """
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    row = F.struct(*[col(c) for c in rest])
    order = F.struct(col(at).isNotNull(), col(at), F.col("__new"), F.to_json(row))
    newest = both.groupBy(*[col(k) for k in keys]).agg(F.max_by(row, order).alias("r"))
    return newest.select(*[col(k) for k in keys], *[F.col("r")[c].alias(c) for c in rest]).select(*[col(c) for c in table.columns])


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the listed keys."""
    return table.join(keys.distinct(), list(keys.columns), "left_anti")


def newest_first(table: DataFrame, at: str, limit: int | None = None) -> DataFrame:
    ordered = table.orderBy(F.desc(at))
    return ordered if limit is None else ordered.limit(limit)


def update_rows(table: DataFrame, updates: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """Overwrite the fields that an update gives; its nulls change nothing.

    Of several updates to a key each field takes its latest value by `at`, of
    equal times (or without `at`) that of the update which is last as text.
    """
    changed = [c for c in updates.columns if c not in (key, at)]
    order = [col(at).isNotNull(), col(at)] if at else []
    order = F.struct(*order, F.to_json(F.struct(*[col(c) for c in changed])))
    one = [F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"__new_{c}") for c in changed]
    new = updates.groupBy(col(key)).agg(*one)
    out = table.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"`__new_{c}`"), col(c)).alias(c) if c in changed else col(c) for c in table.columns])


def retain_latest(table: DataFrame, keys: Sequence[str], at: Sequence[Column], n: int = 50) -> DataFrame:
    """The newest n rows per key; rows beyond n are dropped before the shuffle."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*at)
    return table.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n).drop("__rk")


# -- run records ----------------------------------------------------------------


def record_runs(results: DataFrame, path: str, params: dict | None = None, dataset: str = "") -> None:
    """Append one row per model: (run_id, dataset, model, params, metrics map, created_at)."""
    runs = results.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "mean"))).alias("metrics"))  # a few metrics per model
    rows = runs.select(
        F.expr("uuid()").alias("run_id"), F.lit(dataset).alias("dataset"), "model", F.lit(json.dumps(params or {}, sort_keys=True)).alias("params"), "metrics", F.current_timestamp().alias("created_at")
    )
    rows.coalesce(1).write.mode("append").parquet(path)


def list_runs(runs: DataFrame, limit: int = 50, model: str | None = None) -> DataFrame:
    """Newest first; the limit is held between 1 and 500."""
    chosen = runs if model is None else runs.where(F.col("model") == model)
    return chosen.orderBy(F.desc("created_at"), "run_id").limit(max(1, min(500, limit)))


def best_runs(runs: DataFrame, metric: str) -> DataFrame:
    """The best run of every model by one metric."""
    value = F.col("metrics")[metric]
    score = -value if metric in LOWER_IS_BETTER else value
    top = F.max_by(F.struct("run_id", value.alias("value")), F.struct(score.alias("s"), F.col("run_id")))
    return runs.where(value.isNotNull()).groupBy("model").agg(top.alias("t")).select("model", "t.run_id", "t.value")


def compare_runs(runs: DataFrame) -> DataFrame:
    """(run_id, model, metric, value, best): the best value per metric by its direction."""
    long = runs.select("run_id", "model", F.explode("metrics").alias("metric", "value"))
    ends = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    target = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("lo")).otherwise(F.col("hi"))
    return long.join(F.broadcast(ends), "metric").select("run_id", "model", "metric", "value", (F.col("value") == target).alias("best"))  # one row per metric


# -- dataset catalog -------------------------------------------------------------


def unique_tags(datasets: DataFrame) -> DataFrame:
    return datasets.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def recently_opened(datasets: DataFrame, n: int = 5) -> DataFrame:
    return datasets.where("last_opened_at is not null").orderBy(F.desc("last_opened_at"), "name").limit(n)


def search_datasets(datasets: DataFrame, text: str = "", favorites: bool = False, tags: Sequence[str] = (), sort: str = "recent") -> DataFrame:
    """Name contains the text, favourites only, all tags present; sorted by recent, name or size."""
    out = datasets
    if text.strip():
        out = out.where(F.lower("name").contains(text.strip().lower()))
    if favorites:
        out = out.where("favorite")
    for t in tags:
        out = out.where(F.array_contains("tags", t))
    orders = {
        "recent": [F.desc(F.coalesce("last_opened_at", "created_at"))],
        "name": [F.asc("name")],
        "size": [F.desc(F.coalesce("rows", F.lit(0)) * F.coalesce("cols", F.lit(0)))],
    }
    return out.orderBy(*orders[sort], "name")

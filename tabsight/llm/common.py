"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import drop_at_exit, shared_dir


def text_of(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    r"""Maximal runs of characters outside \x20 and \x09-\x0D (Java's `\s` is exactly this set)."""
    return F.array_remove(F.split(text, r"\s+"), "")


def whole_rows(df: DataFrame, leave_out: tuple[str, ...] = (), **added: Column) -> DataFrame:
    """The rows as one struct column `row`, beside added columns whose names can then clash with none of theirs."""
    names = [c for c in df.columns if c not in leave_out]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[v.alias(k) for k, v in added.items()])


def unpacked(df: DataFrame, names: list[str], replaced: dict[str, Column], *more: Column) -> DataFrame:
    """The fields of `row`, some replaced."""
    return df.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in names], *more)


def beside_content(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """`rows` (with id and content) with the columns of `lists` (one row a content), null where it has none.

    The lists go to the (id, content) pairs in a narrow join; whole rows are
    then dealt by both, so that copies of one text don't meet in one task.
    """
    pairs = rows.select("id", "content").distinct().join(lists, "content").withColumnsRenamed({"id": "_id", "content": "_content"})
    return rows.join(pairs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes at the end of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here.

    The folder goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of which nothing is read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partition by `keys` and store, with the slice number of each row in `slice`.

    A key that fills a third of the table is spread only as far as `keys` tell
    its rows apart, so callers end them with a column that does.
    """
    return stored(df.repartitionByRange(*keys).withColumn("slice", F.spark_partition_id()))


def running_total(df: DataFrame, keys: list[str], amounts: dict[str, str]) -> DataFrame:
    """Add, for each amount column, its sum over this row and all rows before it in the order of `keys`.

    Each slice is summed on its own and shifted by the slices before it; there
    are as many shifts as slices, and no row order crosses a task.
    """
    cut = slices(df, *keys)
    inside = Window.partitionBy("slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("slice").agg(*[F.sum(v).alias(f"_{k}") for k, v in amounts.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("slice", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in amounts])
    return (
        cut.join(F.broadcast(shift), "slice")  # one row a slice
        .select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"_{k}")).alias(k) for k, v in amounts.items()])
    )


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't add up in a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)

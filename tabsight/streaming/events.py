"""Event-time operators that give the same rows on a stream and on a table.

The watermark bounds the state on a stream and has no effect on a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col, number_of, numeric_columns, present, scalar_columns
from ..operators.trust import name_rule, violation


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; the batch size is bounded by files."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """Event time with a watermark, as the instant whose UTC reading is the local time.

    Windows then start at local midnights and hours whatever the session's time zone.
    """
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), col(at).cast("timestamp_ntz")))
    return df.withColumn(at, instant).withWatermark(at, late)


def _local(c: str) -> Column:
    """Back from that instant to the local time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(c)), _epoch())


def sessions(df: DataFrame, user: str, at: str, value: str | None = None, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, events, total): activity split where a user is idle for `gap`."""
    w = F.session_window(at, gap)
    total = F.sum(value) if value else F.lit(None).cast("double")
    grouped = _timed(df, at, late).groupBy(col(user), w.alias("w")).agg(F.count(F.lit(1)).alias("events"), total.alias("total"))
    return grouped.select(col(user), _local("w.start").alias("start"), _local("w.end").alias("end"), "events", "total")


def incremental_profile(df: DataFrame, at: str, every: str = "1 day", late: str = "1 hour", columns: Sequence[str] | None = None) -> DataFrame:
    """(start, column, count, missing, numbers, sum, min, max) per tumbling window: mergeable facts only."""
    names = [c for c in (columns or scalar_columns(df)) if c != at]
    cells = [
        F.struct(F.lit(n).alias("column"), (~present(df, n)).alias("gap"), F.when(present(df, n), number_of(df, n)).alias("x")) for n in names
    ]
    timed = _timed(df, at, late)
    long = timed.select(col(at), F.inline(F.array(*cells)))
    return (
        long.groupBy(F.window(at, every).alias("w"), "column")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if("gap").alias("missing"),
            F.count("x").alias("numbers"),
            F.sum("x").alias("sum"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        )
        .select(_local("w.start").alias("start"), "column", "count", "missing", "numbers", "sum", "min", "max")
    )


def trust_alerts(df: DataFrame, at: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, column, checks, violations) per window for columns whose name implies a range."""
    ruled = [(n, name_rule(n)) for n in numeric_columns(df)]
    cells = [
        F.struct(F.lit(n).alias("column"), number_of(df, n).alias("x"), violation(number_of(df, n), *rule).alias("bad"))
        for n, rule in ruled
        if rule is not None
    ]
    if not cells:
        raise ValueError("no column name implies a range")
    long = _timed(df, at, late).select(col(at), F.inline(F.array(*cells)))
    return (
        long.groupBy(F.window(at, every).alias("w"), "column")
        .agg(F.count("x").alias("checks"), F.count_if("bad").alias("violations"))
        .select(_local("w.start").alias("start"), "column", "checks", "violations")
    )


def sliding_stats(df: DataFrame, at: str, value: str, length: str = "1 day", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, n, mean, std) of every sliding window."""
    return (
        _timed(df, at, late)
        .groupBy(F.window(at, length, slide).alias("w"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
        .select(_local("w.start").alias("start"), "n", "mean", "std")
    )


def write_stream(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Process what has arrived and stop; restartable from the checkpoint after a lost executor."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

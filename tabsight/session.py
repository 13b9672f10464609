"""Session helpers shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabsight")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only on a local master, where driver and tasks share one disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tabsight-")
        drop_at_exit(spark, folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables when the session's file systems close."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_rows(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small file would keep them in fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, *names: str, spread: bool = False):
    """Parquet tables of one scale-factor folder, in the order asked for.

    `spread` is for work that is heavy per row: a file too small to be split
    would otherwise keep all of it in one task. Larger inputs are left alone.
    """
    tables = [spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")) for name in names]
    if spread:
        tables = [spread_rows(t) for t in tables]
    return tables[0] if len(tables) == 1 else tables

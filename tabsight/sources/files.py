"""Reading and writing tables as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import clean_for_export

SEPARATORS = (",", "\t", ";", "|")  # fixed value: tried in this order on ties
SNIFF_LINES = 20


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often in the first lines."""
    head = [r["value"] for r in spark.read.text(path).where("trim(value) <> ''").limit(SNIFF_LINES).collect()]
    return max(SEPARATORS, key=lambda s: (sum(line.count(s) for line in head), -SEPARATORS.index(s)))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, line_breaks: bool = False) -> DataFrame:
    """Delimited text with a header row, every cell a string, empty lines skipped.

    Files are split over tasks at line ends. With `line_breaks` quoted cells may
    hold line ends; a file is then one task, so give several.
    """
    sep = separator or detect_separator(spark, path)
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=line_breaks, escape='"')


def read_column_arrays(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """JSON documents that hold one array per column, turned into rows.

    A file holds one document, or with `one_per_line` one document per line;
    documents spread over the tasks.
    """
    doc = spark.read.json(path, multiLine=not one_per_line)
    names = doc.columns
    return doc.select(F.inline(F.arrays_zip(*[F.col(f"`{n}`").alias(n) for n in names])))


def export_clean(df: DataFrame, path: str, excluded: str | Iterable[str] | None = None, drop_duplicates: bool = False) -> DataFrame:
    """Write the cleaned table as CSV with a header and return it."""
    clean = clean_for_export(df, excluded, drop_duplicates)
    clean.write.mode("overwrite").csv(path, header=True)
    return clean

"""A training-text pipeline: five stages, each over all that the one before kept.

Quality rules reject documents; line deduplication removes passages that an
earlier document holds, and documents of which nothing stays; one document of
each near-duplicate group stays; secrets are replaced by a mark; what is left
is packed into sequences. Stages return the columns of `documents`, the last
one the packing plan: pieces of documents, their sequence and offset there.

Other columns of the input are dropped. n_chars is set anew where a stage
changes a text. Null and empty texts are rejected by the quality rules.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.llm import linededup, nearpath, packing, quality, secrets
from tabsight.llm.common import stored, text_of
from tabsight.llm.queries import WORD_TOKENIZER

NEAR_PERCENT = 80  # word shingles; op6 has its own contract of 85
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(docs)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.deduplicate(_documents(docs), run_words=linededup.RUN_WORDS)
    changed = F.col("removed_lines") > 0
    left = cut.where(~changed | text_of().rlike(r"\S"))
    return left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearpath.keep_one(_documents(docs), percent=NEAR_PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    clean = secrets.redact(docs.withColumn("_chars", F.length("text")), stored(secrets.scan(docs)))
    n = F.when(F.length("text") == F.col("_chars"), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", n).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_documents(docs), WORD_TOKENIZER)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("packing", best_fit_packing),
]

# Minwise hashing, content-defined chunks and tokenizers are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

"""Weighted trust score of a table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, number_of, numeric_columns, present, ratio, scalar_columns
from .profile import duplicate_rows, outlier_counts

# Component weights, and the value range a column name implies.
# The first rule whose word occurs in the lower-case name applies.
WEIGHTS = (("Completeness", 0.30), ("Uniqueness", 0.25), ("Structure", 0.20), ("Consistency", 0.15), ("Stability", 0.10))
NAME_RULES = (
    (("age",), 0.0, 120.0),
    (("percent", "pct", "%", "rate"), 0.0, 100.0),
    (("price", "amount", "cost", "salary", "revenue"), 0.0, None),
)


def name_rule(name: str, word_match: bool = False) -> tuple[float, float | None] | None:
    """The (low, high) range a column name implies, if any."""
    lowered = name.lower()
    parts = set(re.split(r"[^a-z%]+", lowered))
    for words, low, high in NAME_RULES:
        if any((w in parts) if word_match else (w in lowered) for w in words):
            return low, high
    return None


def violation(value: Column, low: float, high: float | None) -> Column:
    return (value < low) if high is None else ((value < low) | (value > high))


def consistency(df: DataFrame, word_match: bool = False) -> DataFrame:
    """(column, checks, violations) for every column whose name implies a range."""
    ruled = [(n, name_rule(n, word_match)) for n in scalar_columns(df)]
    cells = [
        F.struct(F.lit(n).alias("column"), number_of(df, n).alias("x"), violation(number_of(df, n), *rule).alias("bad"))
        for n, rule in ruled
        if rule is not None
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, checks long, violations long")
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column")
        .agg(F.count("x").alias("checks"), F.count_if("bad").alias("violations"))
    )


def completeness(df: DataFrame) -> DataFrame:
    """(rows, cells, missing)."""
    names = scalar_columns(df)
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~present(df, n)).alias(f"m{i}") for i, n in enumerate(names)])
    total = sum((F.col(f"m{i}") for i in range(len(names))), F.lit(0))
    return counted.select("rows", (F.col("rows") * len(names)).alias("cells"), total.alias("missing"))


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, constant): at most one distinct value; all-null columns count.

    A column is constant exactly when its smallest value equals its largest one.
    """
    names = scalar_columns(df)
    filled = [F.when(present(df, n), col(n)) for n in names]
    ends = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"k{i}") for i, c in enumerate(filled)])
    return ends.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"k{i}").alias("constant")) for i, n in enumerate(names)])))


def trust_components(df: DataFrame, numeric: Sequence[str] | None = None, word_match: bool = False) -> DataFrame:
    """One row: the counts behind all five components, joined as scalar subqueries."""
    numbers = list(numeric) if numeric is not None else numeric_columns(df)
    dup = duplicate_rows(df)
    cons = consistency(df, word_match).agg(
        F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"),
        F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"),
        F.concat_ws(
            "; ",
            F.array_sort(
                F.collect_list(F.when(F.col("violations") > 0, F.format_string("%s: %d values out of range", "column", "violations")))
            ),
        ).alias("notes"),
    )
    const = constant_columns(df).agg(F.count_if("constant").alias("n"))
    base = completeness(df).withColumn("duplicates", dup.select("duplicates").scalar())
    base = base.withColumn("constants", const.select("n").scalar()).withColumn("columns", F.lit(len(scalar_columns(df))))
    one = cons.select(F.struct("checks", "violations", "notes"))
    base = base.withColumn("c", one.scalar()).select("*", "c.checks", "c.violations", "c.notes").drop("c")
    if numbers:
        out = outlier_counts(df, numbers).agg(F.struct(F.sum("outliers").alias("o"), F.sum("numbers").alias("v")).alias("s"))
        base = base.withColumn("s", out.scalar()).withColumn("outliers", F.col("s.o")).withColumn("values", F.col("s.v")).drop("s")
    else:
        base = base.withColumn("outliers", F.lit(0)).withColumn("values", F.lit(0))
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return base.select(
        "*",
        (1 - share("missing", "cells")).alias("completeness"),
        (1 - share("duplicates", "rows")).alias("uniqueness"),
        (1 - share("constants", "columns")).alias("structure"),
        (1 - share("violations", "checks")).alias("consistency"),
        (1 - share("outliers", "values")).alias("stability"),
    )


def _score() -> Column:
    weighted = sum((w * F.col(label.lower()) for label, w in WEIGHTS), F.lit(0.0)) * 100
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(weighted, 9)))).cast("int")


def tier(score: Column, high: float = 80, medium: float = 55) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def trust_score(df: DataFrame, numeric: Sequence[str] | None = None, word_match: bool = False) -> DataFrame:
    """One row: score (0..100, half-even), tier, and the five component shares."""
    parts = trust_components(df, numeric, word_match)
    return parts.select(
        _score().alias("score"), tier(_score()).alias("tier"), *[F.col(label.lower()) for label, _ in WEIGHTS]
    )


def trust_breakdown(df: DataFrame, numeric: Sequence[str] | None = None, word_match: bool = False) -> DataFrame:
    """Five rows: (label, score, weight, note)."""
    pct = lambda c: F.format_string("%.1f%%", (1 - F.col(c)) * 100)
    notes = {
        "Completeness": F.concat(pct("completeness"), F.lit(" of cells missing")),
        "Uniqueness": F.concat(pct("uniqueness"), F.lit(" of rows repeated")),
        "Structure": F.format_string("%d columns without variation", F.col("constants")),
        "Consistency": F.when(F.col("notes") != "", F.col("notes")).otherwise("no rule broken"),
        "Stability": F.concat(pct("stability"), F.lit(" of values outlying")),
    }
    rows = [
        F.struct(F.lit(label).alias("label"), (F.col(label.lower()) * 100).alias("score"), F.lit(w).alias("weight"), notes[label].alias("note"))
        for label, w in WEIGHTS
    ]
    return trust_components(df, numeric, word_match).select(F.inline(F.array(*rows)))

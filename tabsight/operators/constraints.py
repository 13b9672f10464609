"""Format consistency and approximate functional dependencies."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, present, scalar_columns, value_key
from ..functions.ranks import value_counts

# Fixed patterns of the recognised formats, tried in this order.
FORMATS = (
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
    ("date", r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})([ T].*)?$"),
    ("number", r"^[+-]?[0-9]+([.][0-9]+)?$"),
    ("phone", r"^[+]?[0-9(][0-9() .-]{6,}$"),
    ("numeric_id", r"^[A-Za-z]+[^A-Za-z0-9]?[0-9]+$"),
)


def value_format(c: Column) -> Column:
    text = F.trim(c)
    return functools.reduce(lambda acc, f: acc.when(text.rlike(f[1]), f[0]), FORMATS[1:], F.when(text.rlike(FORMATS[0][1]), FORMATS[0][0])).otherwise("text")


def format_consistency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, format, rows, share, dominant): how many cells follow each format."""
    cells = [F.struct(F.lit(c).alias("column"), F.when(present(df, c), value_format(col(c).cast("string"))).alias("format")) for c in columns]
    counts = df.select(F.inline(F.array(*cells))).where("format is not null").groupBy("column", "format").agg(F.count(F.lit(1)).alias("rows"))
    best = counts.groupBy("column").agg(
        F.max_by("format", F.struct("rows", "format")).alias("top"), F.sum("rows").alias("total")
    )
    return counts.join(best, "column").select(
        "column", "format", "rows", (F.col("rows") / F.col("total")).alias("share"), (F.col("format") == F.col("top")).alias("dominant")
    )


def format_breaks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a cell outside its column's dominant format, and which columns those are."""
    top = {r["column"]: r["format"] for r in format_consistency(df, columns).where("dominant").collect()}  # one row per column
    broken = [
        F.when(present(df, c) & (value_format(col(c).cast("string")) != top[c]), F.lit(c)) for c in columns if c in top
    ]
    return df.withColumn("broken", F.array_compact(F.array(*broken))).where(F.size("broken") > 0)


def functional_dependencies(df: DataFrame, columns: Sequence[str] | None = None, max_violation: float = 0.02) -> DataFrame:
    """(determinant, dependent, groups, violations, rate) for pairs A -> B that nearly hold.

    One aggregation per determinant: within equal values of A, every other
    column has one value if the least and the greatest hash of its values are
    the same. Constant columns and keys are left out.
    """
    names = list(columns) if columns is not None else scalar_columns(df)
    n = df.count()
    keys = {c: value_key(col(c), df.schema[c]) for c in names}
    results = []
    for i, a in enumerate(names):
        others = [(j, F.when(keys[b].isNotNull(), F.xxhash64(keys[b]))) for j, b in enumerate(names) if j != i]
        ends = [x for j, b in others for x in (F.min(b).alias(f"lo{j}"), F.max(b).alias(f"hi{j}"))]
        groups = df.where(keys[a].isNotNull()).groupBy(keys[a].alias("a")).agg(F.count(F.lit(1)).alias("rows"), *ends)
        broken = [F.count_if(F.col(f"lo{j}") < F.col(f"hi{j}")).alias(f"v{j}") for j, _ in others]
        results.append(groups.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("groups"), F.array(*broken).alias("violations")))
    rows = functools.reduce(DataFrame.union, results).collect() if results else []  # one row a column
    kept = {names[r["i"]]: r for r in rows if 1 < r["groups"] < n}
    rules = []
    for a, r in kept.items():
        counts = iter(r["violations"])
        for b in names:
            if b != a:
                violations = next(counts)
                rate = violations / r["groups"]
                if b in kept and rate <= max_violation:
                    rules.append((a, b, r["groups"], violations, rate))
    return df.sparkSession.createDataFrame(rules, "determinant string, dependent string, groups long, violations long, rate double")


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """The rows whose determinant value goes with more than one dependent value."""
    broken = df.groupBy(col(determinant)).agg(F.min(col(dependent)).alias("lo"), F.max(col(dependent)).alias("hi")).where("lo < hi")
    return df.join(broken.select(col(determinant)), determinant, "left_semi")

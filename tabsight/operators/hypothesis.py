"""Hypothesis tests: one grouped aggregate each, p-values from the few numbers left."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import distributions as dist
from ..functions.columns import col, is_numeric

ALPHA = 0.05
TWO_GROUP_SCHEMA = (
    "statistic double, p_value double, dof double, significant boolean, "
    "group1 string, mean1 double, n1 long, group2 string, mean2 double, n2 long, interpretation string"
)


def _check(df: DataFrame, value: str, *others: str) -> None:
    for name in (value, *others):
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
    if not is_numeric(df.schema[value]):
        raise ValueError(f"{value!r} must be numeric")


def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, mean, var) of the complete rows."""
    data = df.select(col(value).cast("double").alias("x"), col(group).cast("string").alias("group")).dropna()
    return data.groupBy("group").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def _two_groups(df: DataFrame, value: str, group: str):
    _check(df, value, group)
    rows = group_summary(df, value, group).orderBy("group").limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"{group!r} must have exactly two values")
    if any(r["n"] < 2 for r in rows):
        raise ValueError("each group needs at least two rows")
    return rows


def _two_group_result(df, value, group, a, b, stat, p, dof, test):
    if stat is None:
        stat, p = 0.0, 1.0
    significant = p < ALPHA
    relation = "differs" if significant else "does not differ"
    text = f"{test}: mean of {value} {relation} significantly between {a['group']} and {b['group']} (p = {p:.4g})."
    row = (stat, p, dof, significant, a["group"], a["mean"], a["n"], b["group"], b["mean"], b["n"], text)
    return df.sparkSession.createDataFrame([row], TWO_GROUP_SCHEMA)


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two samples, unequal variances; groups in value order."""
    a, b = _two_groups(df, value, group)
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    if va + vb == 0:
        return _two_group_result(df, value, group, a, b, None, 1.0, None, "Welch t-test")
    stat = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return _two_group_result(df, value, group, a, b, stat, dist.t_two_sided(stat, dof), dof, "Welch t-test")


def z_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two samples, normal tail, sample variances."""
    a, b = _two_groups(df, value, group)
    spread = a["var"] / a["n"] + b["var"] / b["n"]
    if spread == 0:
        return _two_group_result(df, value, group, a, b, None, 1.0, None, "z-test")
    stat = (a["mean"] - b["mean"]) / math.sqrt(spread)
    return _two_group_result(df, value, group, a, b, stat, dist.normal_two_sided(stat), None, "z-test")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance; any number of groups, summed in Spark."""
    _check(df, value, group)
    groups = group_summary(df, value, group)
    moments = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.min("n").alias("least"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        F.max_by("group", "mean").alias("highest"),
        F.max("mean").alias("highest_mean"),
        F.min_by("group", "mean").alias("lowest"),
        F.min("mean").alias("lowest_mean"),
    )
    grand = moments.select("grand").scalar()
    m = moments.withColumn("between", groups.agg(F.sum(F.col("n") * F.pow(F.col("mean") - grand, 2))).scalar()).first()
    if m["k"] < 2:
        raise ValueError(f"{group!r} must have at least two values")
    if m["least"] < 2:
        raise ValueError("each group needs at least two rows")
    d1, d2 = m["k"] - 1, m["n"] - m["k"]
    stat, p = 0.0, 1.0
    if m["within"] and d2 > 0:
        stat = (m["between"] / d1) / (m["within"] / d2)
        p = dist.f_upper(stat, d1, d2)
    relation = "differs" if p < ALPHA else "does not differ"
    text = f"ANOVA: mean of {value} {relation} significantly across {group} (F = {stat:.4f}, p = {p:.4g})."
    row = (stat, p, float(d1), float(d2), p < ALPHA, m["k"], m["highest"], m["highest_mean"], m["lowest"], m["lowest_mean"], text)
    return df.sparkSession.createDataFrame(
        [row],
        "statistic double, p_value double, dof_between double, dof_within double, significant boolean, groups long, "
        "highest string, highest_mean double, lowest string, lowest_mean double, interpretation string",
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected) for the combinations that occur."""
    data = df.select(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).dropna()
    cells = data.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    rows = cells.groupBy("a").agg(F.sum("observed").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("observed").alias("cb"))
    total = cells.agg(F.sum("observed")).scalar()
    return cells.join(rows, "a").join(cols, "b").withColumn("total", total).select(
        "a", "b", "observed", (F.col("ra") * F.col("cb").cast("double") / F.col("total")).alias("expected"), "ra", "cb", "total"
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns, continuity-corrected for a 2 x 2 table.

    Only observed combinations are listed: empty cells enter through the
    identity sum((O-E)^2/E) = sum(O^2/E) - n, and in a 2 x 2 table all four
    deviations are equal, so one cell and the margins give the corrected value.
    """
    for name in (a, b):
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
    cells = contingency(df, a, b)
    margin_a = cells.groupBy("a").agg(F.first("ra").alias("n")).agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("n")).alias("inv")).alias("s"))
    margin_b = cells.groupBy("b").agg(F.first("cb").alias("n")).agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("n")).alias("inv")).alias("s"))
    r = (
        cells.agg(
            F.max("total").alias("n"),
            F.sum(F.col("observed") * F.col("observed") / F.col("expected")).alias("weighted"),
            F.max(F.abs(F.col("observed") - F.col("expected"))).alias("gap"),
        )
        .withColumn("sa", margin_a.scalar())
        .withColumn("sb", margin_b.scalar())
        .first()
    )
    if not r["n"] or r["n"] < 5:
        raise ValueError("at least five complete rows are needed")
    dof = (r["sa"]["k"] - 1) * (r["sb"]["k"] - 1)
    if dof == 0:
        stat, p = 0.0, 1.0
    elif dof == 1:
        stat = (r["gap"] - min(0.5, r["gap"])) ** 2 * r["n"] * r["sa"]["inv"] * r["sb"]["inv"]
        p = dist.chi2_upper(stat, 1)
    else:
        stat = max(0.0, r["weighted"] - r["n"])
        p = dist.chi2_upper(stat, dof)
    relation = "depends" if p < ALPHA else "does not depend"
    text = f"Chi-square: {a} {relation} significantly on {b} (chi2 = {stat:.4f}, p = {p:.4g}, dof = {dof})."
    return df.sparkSession.createDataFrame(
        [(stat, p, dof, p < ALPHA, r["n"], text)],
        "statistic double, p_value double, dof long, significant boolean, n long, interpretation string",
    )


def confidence_interval(df: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """Student t interval of a mean."""
    _check(df, value)
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    r = df.select(col(value).cast("double").alias("x")).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem")
    ).first()
    if r["n"] < 2:
        raise ValueError("at least two values are needed")
    margin = dist.t_quantile(confidence, r["n"] - 1) * r["sem"]
    text = f"{confidence:.0%} interval for the mean of {value}: {r['mean'] - margin:.4f} to {r['mean'] + margin:.4f} (n = {r['n']})."
    return df.sparkSession.createDataFrame(
        [(r["mean"], r["sem"], margin, r["mean"] - margin, r["mean"] + margin, confidence, r["n"], text)],
        "mean double, sem double, margin double, lower double, upper double, confidence double, n long, interpretation string",
    )


def eligible_columns(profile: DataFrame) -> DataFrame:
    """(role, name): which columns a test, clustering or time series can use."""
    numeric = F.col("type") == "numeric"
    roles = F.array_compact(
        F.array(
            F.when(numeric, "test_value"),
            F.when(~numeric | (F.col("unique") <= 10), "test_group"),
            F.when(F.col("type").isin("numeric", "categorical"), "clustering"),
            F.when(F.col("name").rlike("(?i)date|time|year|month|day") | (F.col("type") == "datetime"), "time_axis"),
            F.when(numeric, "time_value"),
        )
    )
    return profile.select(F.explode(roles).alias("role"), "name")

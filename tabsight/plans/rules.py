"""Rules over a profile: every finding is a row (rule, column, value, text).

A profile holds one row per column, so these plans are small whatever the
size of the table behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, present, ratio
from ..operators.timeseries import moment_of

FINDING = "struct<seq:int,rule:string,column:string,value:double,text:string>"
MONEY = r"(?i)price|amount|cost|salary|revenue"  # fixed patterns of column names
PERCENT = r"(?i)percent|%|rate|pct"
START = r"(?i)\b(start|from|begin)\b"
END = r"(?i)\b(end|to|finish)\b"


def finding(seq: int, rule: str, when: Column, value: Column, text: Column) -> Column:
    row = F.struct(
        F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), F.col("name").alias("column"), value.cast("double").alias("value"), text.alias("text")
    )
    return F.when(when, row)


def _findings(profile: DataFrame, *rules: Column) -> DataFrame:
    return profile.select("pos", F.inline(F.array_compact(F.array(*rules))))


def dominant_share() -> Column:
    """Share of the most frequent value among the filled cells."""
    return ratio(F.col("top_values")[0]["n"], F.greatest(F.col("count") - F.col("missing"), F.lit(1)))


def _top() -> Column:
    return F.col("top_values")[0]["value"]


def human_errors(profile: DataFrame, year: int) -> DataFrame:
    """Values that look mistyped, by column name: ages, percentages, money, far-future dates."""
    numeric, name, say = F.col("type") == "numeric", F.col("name"), F.format_string
    age, pct, money = name.rlike("(?i)age"), name.rlike(PERCENT), name.rlike(MONEY)
    last_year = F.substring("max_date", 1, 4).try_cast("int")
    return _findings(
        profile,
        finding(1, "age_above_130", numeric & age & (F.col("max") > 130), F.col("max"), say("%s: ages above 130", name)),
        finding(2, "age_below_zero", numeric & age & (F.col("min") < 0), F.col("min"), say("%s: negative ages", name)),
        finding(3, "percent_range", numeric & pct & ((F.col("max") > 100) | (F.col("min") < 0)), F.col("max"), say("%s: outside 0 to 100", name)),
        finding(4, "negative_money", numeric & money & (F.col("negatives") > 0), F.col("negatives"), say("%s: %d negative amounts", name, F.col("negatives"))),
        finding(5, "far_future", (F.col("type") == "datetime") & (last_year > year + 5), last_year, say("%s: dates up to %d", name, last_year)),
    )


def near_duplicate_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, normal, variants, rows, examples): spellings equal after trimming and lower-casing."""
    cells = [F.struct(F.lit(c).alias("column"), F.when(present(df, c), col(c)).alias("raw")) for c in columns]
    spelled = df.select(F.inline(F.array(*cells))).where("raw is not null").groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"))
    return (
        spelled.withColumn("normal", F.lower(F.trim("raw")))
        .groupBy("column", "normal")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"), F.min("raw").alias("first"), F.max("raw").alias("last"))
        .where("variants > 1")
    )


def contradictions(profile: DataFrame) -> DataFrame:
    """Start columns that begin after their end column, and means far from the median."""
    dated = profile.where("type = 'datetime'")
    lowered = F.regexp_replace(F.lower("name"), "[_-]", " ")
    start = dated.where(lowered.rlike(START)).agg(F.min_by(F.struct("name", "min_date"), "pos").alias("s"))
    end = dated.where(lowered.rlike(END)).agg(F.min_by(F.struct("name", "max_date"), "pos").alias("e"))
    pair = start.withColumn("e", end.scalar()).where("s.min_date > e.max_date").select(
        F.lit(-1).alias("pos"), F.lit(1).alias("seq"), F.lit("start_after_end").alias("rule"), F.col("s.name").alias("column"),
        F.lit(None).cast("double").alias("value"), F.format_string("%s lies after %s", "s.name", "e.name").alias("text"),
    )
    gap = F.abs(F.col("mean") - F.col("median"))
    apart = (F.col("type") == "numeric") & (F.col("std") > 0) & (gap > 2 * F.col("std"))
    return pair.unionByName(_findings(profile, finding(2, "mean_far_from_median", apart, gap, F.format_string("%s: mean %.2f, median %.2f", "name", "mean", "median"))))


def start_after_end_rows(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: how many rows start after they end."""
    a, b = (moment_of(df, start), moment_of(df, end))
    return df.agg(F.count_if(a > b).alias("violations"), F.count(F.when(a.isNotNull(), b)).alias("checked"))


def _count_where(profile: DataFrame, cond: Column) -> Column:
    return profile.agg(F.count_if(cond)).scalar()


def behavior(profile: DataFrame, shape: DataFrame) -> DataFrame:
    """(seq, rule, value): notes on density, duplicates, skew, constants, balance and outliers."""
    category = F.col("type") == "categorical"
    rows = shape.withColumn("skewed", _count_where(profile, F.abs("skew") > 1))
    rows = rows.withColumn("constant", _count_where(profile, F.col("constant")))
    rows = rows.withColumn("dominated", _count_where(profile, category & (dominant_share() > 0.8)))
    rows = rows.withColumn("noisy", _count_where(profile, F.col("outliers") > F.col("count") * 0.05))
    note = lambda seq, rule, value: F.struct(F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), value.cast("double").alias("value"))
    m = F.col("missing_pct")
    notes = F.array_compact(
        F.array(
            F.when(m > 15, note(1, "sparse", m)).when(m > 3, note(1, "mildly_sparse", m)).otherwise(note(1, "dense", m)),
            F.when(F.col("duplicates") > 0, note(2, "duplicate_rows", F.col("duplicates"))),
            F.when(F.col("skewed") >= 2, note(3, "skewed_columns", F.col("skewed"))),
            F.when(F.col("constant") > 0, note(4, "constant_columns", F.col("constant"))),
            F.when(F.col("dominated") > 0, note(5, "imbalanced_columns", F.col("dominated"))),
            F.when(F.col("noisy") > 0, note(6, "outlier_columns", F.col("noisy"))),
        )
    )
    return rows.select(F.inline(notes))


def risks(profile: DataFrame, shape: DataFrame, most: int = 6) -> DataFrame:
    """(pos, seq, rule, column, value, text): the first `most` risks, table-wide ones first."""
    name, say = F.col("name"), F.format_string
    table = shape.where("missing_pct > 20").select(
        F.lit(-1).alias("pos"), F.lit(0).alias("seq"), F.lit("high_missing").alias("rule"), F.lit(None).cast("string").alias("column"),
        F.col("missing_pct").alias("value"), F.lit("many cells are missing and may bias results").alias("text"),
    )
    columns = _findings(
        profile,
        finding(1, "skewed", (F.col("type") == "numeric") & (F.abs("skew") > 1.5), F.col("skew"), say("%s is heavily skewed", name)),
        finding(2, "dominated", (F.col("type") == "categorical") & (dominant_share() > 0.85), dominant_share(), say("%s is dominated by %s", name, _top())),
        finding(3, "high_cardinality", F.col("high_cardinality"), F.col("unique"), say("%s has very high cardinality", name)),
    )
    return table.unionByName(columns).orderBy("pos", "seq").limit(most)


def severity(text: Column) -> Column:
    """high, medium or low by the words of a risk text (fixed patterns)."""
    lowered = F.lower(text)
    return (
        F.when(lowered.rlike("heavily|dominated|very high|materially|bias"), "high")
        .when(lowered.rlike("skew|missing|outlier|imbalance|cardinality"), "medium")
        .otherwise("low")
    )


def recommended_actions(profile: DataFrame, shape: DataFrame, most: int = 8) -> DataFrame:
    """(pos, seq, rule, column, value, text): what to do next, without repeats."""
    name, say, m = F.col("name"), F.format_string, F.col("missing_pct")
    numeric = F.col("type") == "numeric"
    table = shape.where("duplicates > 0").select(
        F.lit(-1).alias("pos"), F.lit(0).alias("seq"), F.lit("drop_duplicates").alias("rule"), F.lit(None).cast("string").alias("column"),
        F.col("duplicates").cast("double").alias("value"), say("drop %d repeated rows", F.col("duplicates")).alias("text"),
    )
    columns = _findings(
        profile,
        finding(1, "drop_constant", F.col("constant"), F.col("unique"), say("remove constant column %s", name)),
        finding(2, "drop_sparse", m > 40, m, say("consider dropping %s (%.0f%% missing)", name, m)),
        finding(2, "impute_median", (m <= 40) & (m > 5) & numeric, m, say("fill %s with its median (%.0f%% missing)", name, m)),
        finding(3, "transform_skew", numeric & (F.abs("skew") > 1.5), F.col("skew"), say("try a log or root of %s", name)),
        finding(4, "group_rare", F.col("high_cardinality"), F.col("unique"), say("group rare values of %s", name)),
    )
    return table.unionByName(columns).dropDuplicates(["text"]).orderBy("pos", "seq").limit(most)


def risk_level(shape: DataFrame, risk_rows: DataFrame, errors: DataFrame, clashes: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """One row: points and low / medium / high (2 and 5 points)."""
    count = lambda d: d.agg(F.count(F.lit(1))).scalar()
    one = shape.withColumn("risks", count(risk_rows)).withColumn("errors", count(errors)).withColumn("clashes", count(clashes))
    one = one.withColumn("trust", trust.select("score").scalar() if trust is not None else F.lit(None).cast("int"))
    m = F.col("missing_pct")
    points = (
        F.when(m > 20, 3).when(m > 5, 1).otherwise(0)
        + F.when(F.col("duplicates") > 0, 1).otherwise(0)
        + F.when(F.col("risks") >= 4, 2).when(F.col("risks") > 0, 1).otherwise(0)
        + F.when(F.col("errors") > 0, 2).otherwise(0)
        + F.when(F.col("clashes") > 0, 1).otherwise(0)
        + F.when(F.col("trust") < 55, 2).when(F.col("trust") < 80, 1).otherwise(0)
    )
    return one.select(points.alias("points"), F.when(points >= 5, "high").when(points >= 2, "medium").otherwise("low").alias("level"))


def cleaning_suggestions(profile: DataFrame) -> DataFrame:
    """(column, issue, suggested_action, severity) by fixed thresholds."""
    m = F.col("missing_pct")
    row = lambda issue, action, level: F.struct(
        F.col("name").alias("column"), issue.alias("issue"), F.lit(action).alias("suggested_action"), F.lit(level).alias("severity")
    )
    found = F.array_compact(
        F.array(
            F.when(m > 40, row(F.format_string("%.1f%% of values missing", m), "drop_column", "high")).when(
                m > 5, row(F.format_string("%.1f%% of values missing", m), "impute_missing", "medium")
            ),
            F.when(F.col("constant"), row(F.lit("only one value"), "drop_column", "high")),
            F.when(F.col("high_cardinality"), row(F.lit("many distinct values"), "group_rare_categories", "low")),
        )
    )
    return profile.select(F.inline(found))


def health_advice(profile: DataFrame, shape: DataFrame, leakage: DataFrame | None = None) -> DataFrame:
    """(rule, column, value): balance dominated columns, drop leaking ones, fill gaps."""
    share = dominant_share()
    dominated = profile.where((F.col("type") == "categorical") & (share > 0.85)).select(
        F.lit("balance_classes").alias("rule"), F.col("name").alias("column"), share.alias("value")
    )
    gaps = profile.where("missing_pct > 30").select(F.lit("impute_or_drop").alias("rule"), F.col("name").alias("column"), F.col("missing_pct").alias("value"))
    wide = profile.agg(F.count_if(F.col("missing_pct") > 30) == 0).scalar()
    overall = shape.where(F.col("missing_pct") > 10).where(wide).select(
        F.lit("impute_cells").alias("rule"), F.lit(None).cast("string").alias("column"), F.col("missing_pct").alias("value")
    )
    out = dominated.unionByName(gaps).unionByName(overall)
    if leakage is not None:
        out = out.unionByName(leakage.select(F.lit("drop_leakage").alias("rule"), "column", F.col("score").cast("double").alias("value")).dropDuplicates(["column"]))
    return out


def insights(profile: DataFrame, shape: DataFrame, pearson: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(seq, tag, column, value, confidence): the main observations, at most `most`."""
    def pick(seq, tag, confidence, rows, column, value):
        return rows.select(F.lit(seq).alias("seq"), F.lit(tag).alias("tag"), column.alias("column"), value.cast("double").alias("value"), F.lit(confidence).alias("confidence"))

    name = F.col("name")
    rank = Window.partitionBy("type").orderBy("pos")
    typed = profile.withColumn("nth", F.row_number().over(rank))
    parts = [
        pick(1, "missing", 0.99, profile.where("missing_pct > 0").orderBy(F.desc("missing_pct"), "pos").limit(1), name, F.col("missing_pct")),
        pick(2, "duplicates", 0.98, shape.where("duplicates > 0"), F.lit(None).cast("string"), F.col("duplicates") * 100 / F.col("rows")),
        pick(3, "distribution", 0.9, typed.where("type = 'numeric' and nth <= 3"), name, F.col("mean")),
        pick(4, "composition", 0.85, typed.where("type = 'categorical' and nth <= 2"), name, dominant_share() * 100),
        pick(6, "time_range", 0.95, typed.where("type = 'datetime' and nth = 1"), name, F.substring("max_date", 1, 4).cast("double")),
    ]
    if pearson is not None:
        best = pearson.where(F.abs("pearson") > 0.4).orderBy(F.desc(F.abs("pearson")), "i", "j").limit(1)
        parts.append(pick(5, "relationship", 0.8, best, F.concat_ws(" / ", "col_a", "col_b"), F.col("pearson")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("seq", "column").limit(most)

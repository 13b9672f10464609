"""One long table of facts from all analyses, and recommendations from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

ANOMALIES_LISTED = 5


def _facts(rows: DataFrame, section: str, subject: Column, metric: str, value: Column, text: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"),
        subject.cast("string").alias("subject"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def build_facts(
    profile: DataFrame,
    shape: DataFrame,
    trust: DataFrame | None = None,
    breakdown: DataFrame | None = None,
    pearson: DataFrame | None = None,
    spearman: DataFrame | None = None,
    mutual: DataFrame | None = None,
    leakage: DataFrame | None = None,
    models: DataFrame | None = None,
    imbalance: DataFrame | None = None,
    anomalies: DataFrame | None = None,
) -> DataFrame:
    """(section, subject, metric, value, text) from whichever results exist."""
    table, name = F.lit("table"), F.col("name")
    parts = [_facts(shape, "shape", table, c, F.col(c)) for c in ("rows", "cols", "duplicates", "missing_pct")]
    parts.append(_facts(profile.where("missing > 0"), "columns", name, "missing_pct", F.col("missing_pct")))
    parts.append(_facts(profile.where("constant"), "columns", name, "constant", F.lit(1)))
    parts.append(_facts(profile.where("high_cardinality"), "columns", name, "high_cardinality", F.col("unique")))
    if trust is not None:
        parts.append(_facts(trust, "trust", table, "score", F.col("score"), F.col("tier")))
    if breakdown is not None:
        parts.append(_facts(breakdown, "trust", F.col("label"), "component", F.col("score"), F.col("note")))
    pair = lambda a, b: F.concat_ws(" / ", a, b)
    if pearson is not None:
        parts.append(_facts(pearson, "dependency", pair("col_a", "col_b"), "pearson", F.col("correlation")))
    if spearman is not None:
        parts.append(_facts(spearman, "dependency", pair("col_a", "col_b"), "spearman", F.col("correlation")))
    if mutual is not None:
        parts.append(_facts(mutual, "dependency", pair("source", "target"), "mutual_information", F.col("score")))
    if leakage is not None:
        parts.append(_facts(leakage, "leakage", F.col("column"), "score", F.round("score", 4), F.col("reason")))
    if models is not None:
        parts.append(_facts(models, "model", F.col("model"), "score", F.round("score", 4), F.col("metric")))
    if imbalance is not None:
        parts.append(_facts(imbalance.where("imbalanced"), "model", F.lit("target"), "majority_share", F.col("majority_share")))
    if anomalies is not None:
        worst = anomalies.orderBy(F.desc("score"), "row_id").limit(ANOMALIES_LISTED)
        parts.append(_facts(worst, "anomaly", F.col("row_id"), "score", F.round("score", 4)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommendations(facts: DataFrame) -> DataFrame:
    """(seq, subject, text): actions that follow from the facts; one default line if none do."""
    facts = materialize(facts)  # a few rows per column, read three times
    is_ = lambda s, m: (F.col("section") == s) & (F.col("metric") == m)
    say, v, s = F.format_string, F.col("value"), F.col("subject")
    row = lambda when, seq, text: F.when(when, F.struct(F.lit(seq).alias("seq"), s.alias("subject"), text.alias("text")))
    rules = F.array_compact(
        F.array(
            row(is_("shape", "duplicates") & (v > 0), 1, say("remove %.0f repeated rows", v)),
            row(is_("columns", "missing_pct") & (v > 40), 2, say("drop %s, %.1f%% is missing", s, v)),
            row(is_("columns", "missing_pct") & (v > 5) & (v <= 40), 2, say("fill gaps of %s, %.1f%% is missing", s, v)),
            row(is_("columns", "constant"), 3, say("remove constant column %s", s)),
            row(is_("columns", "high_cardinality"), 4, say("group or hash values of %s", s)),
            row(is_("leakage", "score"), 5, F.concat(F.lit("leave out "), s, F.coalesce(say(" (score %.4f)", v), F.concat(F.lit(" ("), F.col("text"), F.lit(")"))))),
            row(is_("model", "majority_share"), 6, F.lit("weight the classes or resample")),
        )
    )
    found = facts.select(F.inline(rules))
    odd = facts.where(is_("anomaly", "score")).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(7).alias("seq"), F.lit("rows").alias("subject"), F.format_string("look at the %d most unusual rows", "n").alias("text")
    )
    listed = materialize(found.unionByName(odd))
    nothing = listed.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(0).alias("seq"), F.lit("table").alias("subject"), F.lit("no cleaning needed").alias("text")
    )
    return listed.unionByName(nothing)

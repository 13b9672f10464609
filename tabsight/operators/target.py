"""Task detection, target checks and leakage scan: aggregates only, no model fits."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, is_numeric, number_of, present, ratio, value_key
from ..functions.ranks import column_quantiles, cumulative_counts, value_counts
from ..session import materialize

# Thresholds of the target and leakage rules.
REGRESSION_VALUES = 20
MAX_CLASSES = 50
IMBALANCE = 0.8
R2_LIMIT, AUC_LIMIT, ACCURACY_LIMIT = 0.95, 0.97, 0.97
ID_SHARE, CORRELATION_LIMIT, MI_LIMIT = 0.95, 0.98, 0.90


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """One row: regression for a numeric target with more than 20 values, else classification."""
    counts = df.where(present(df, target)).groupBy(col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("known"))
    many = F.lit(is_numeric(df.schema[target])) & (F.col("distinct") > REGRESSION_VALUES)
    return values.select("distinct", "known", F.when(many, "regression").otherwise("classification").alias("task"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: the largest class, its share (4 digits) and whether it exceeds 0.8."""
    counts = df.where(present(df, target)).groupBy(col(target).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.max_by("c", F.struct("n", "c")).alias("majority"), F.max("n").alias("top"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    share = ratio(F.col("top"), F.col("rows"))
    message = F.when(share > IMBALANCE, F.format_string("%s makes up %.1f%% of the rows", "majority", share * 100))
    return one.select("majority", "classes", F.round(share, 4).alias("majority_share"), F.coalesce(share > IMBALANCE, F.lit(False)).alias("imbalanced"), message.alias("message"))


def target_suitability(df: DataFrame, features: Sequence[str], target: str, task: str) -> DataFrame:
    """One row: issues (they block training), warnings, and whether the target is suitable."""
    here, wide = present(df, target), len(features)
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~here).alias("missing"),
        F.coalesce(F.stddev_samp(number_of(df, target)), F.lit(0.0)).alias("std"),
    )
    base = base.withColumn("i", class_imbalance(df, target).select(F.struct("classes", "imbalanced", "message")).scalar())
    missing = F.coalesce(ratio(F.col("missing") * 100, F.col("rows")), F.lit(0.0))
    classify = F.lit(task == "classification")
    issues = F.array_compact(
        F.array(
            F.when(missing > 10, F.format_string("target is missing in %.1f%% of the rows", missing)),
            F.when(classify & (F.col("i.classes") <= 1), F.lit("target has one class")),
            F.when(~classify & (F.col("std") < 1e-6), F.lit("target hardly varies")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(classify & (F.col("i.classes") > MAX_CLASSES), F.lit("target has more than 50 classes")),
            F.when(F.lit(wide > 0) & (F.col("rows") < 50 * wide), F.format_string("%d rows for %d features", F.col("rows"), F.lit(wide))),
            F.when(classify & F.col("i.imbalanced"), F.col("i.message")),
        )
    )
    return base.select(
        F.lit(task).alias("task"), "rows", F.lit(wide).alias("features"), missing.alias("missing_pct"), issues.alias("issues"), warnings.alias("warnings"), (F.size(issues) == 0).alias("suitable")
    )


def fold_of(keys: Sequence[str], folds: int, seed: int = 42) -> Column:
    """Fold by a hash of the key: the same row always falls into the same fold."""
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(folds)).cast("int")


def binned_cells(df: DataFrame, features: Sequence[str], bins: int) -> list[Column]:
    """Bin of each feature as a string: quantile bin of a number, key of a category."""
    edges = bin_edges(df, features, bins)
    out = []
    for c in features:
        if is_numeric(df.schema[c]):
            x = number_of(df, c)
            index = functools.reduce(lambda a, e: a + F.when(x > e, 1).otherwise(0), edges.get(c, []), F.lit(0))
            out.append(F.when(x.isNull(), "missing").otherwise(index.cast("string")))
        else:
            out.append(category_key(df, c))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """The different inner quantiles of each number."""
    numeric = [c for c in features if is_numeric(df.schema[c])]
    probs = [b / bins for b in range(1, bins)]
    return {r["column"]: sorted(set(r["q"])) for r in column_quantiles(df, numeric, probs).collect()} if numeric else {}


def category_key(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.when(present(df, name), value_key(col(name), df.schema[name])), F.lit("missing"))


def auc_table(counts: DataFrame, by: Sequence[str], score: str, positive: str, negative: str) -> DataFrame:
    """(by, auc, positives): rank-sum area from (by, score, positive, negative) counts, ties halved."""
    merged = counts.groupBy(*by, score).agg(F.sum(negative).alias("neg"), F.sum(positive).alias("pos"))
    placed = cumulative_counts(merged.select(*by, score, F.struct(F.col(score).alias("s"), "pos").alias("sp"), "neg"), by, "sp", "neg")
    sums = placed.select(*by, F.col("sp.pos").alias("pos"), "neg", "below", "total").groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("wins"), F.sum("pos").alias("positives"), F.max("total").alias("negatives")
    )
    return sums.select(*by, F.try_divide("wins", F.col("positives") * F.col("negatives").cast("double")).alias("auc"), "positives")


def single_feature_scores(
    df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str], folds: int = 5, bins: int = 20
) -> DataFrame:
    """(column, metric, score): cross-validated score of each feature alone.

    The learner is the target mean (or majority class) per bin, learnt on the
    other folds by subtraction; all features share one aggregation.
    """
    known = df.where(present(df, target))
    if task == "regression":
        return _regression_scores(_target_sums(known, features, target, keys, folds, bins))
    cells = [F.struct(F.lit(c).alias("column"), b.alias("bin")) for c, b in zip(features, binned_cells(known, features, bins))]
    rows = known.withColumn("__fold", fold_of(keys, folds)).select(F.col("__fold").alias("fold"), col(target).cast("string").alias("y"), F.inline(F.array(*cells)))
    classes = [r["y"] for r in known.select(col(target).cast("string").alias("y")).distinct().orderBy("y").limit(3).collect()]
    if len(classes) == 2:
        return _binary_scores(rows, classes[1])
    return _multiclass_scores(rows)


def _held_out(sums: DataFrame, *values: str) -> DataFrame:
    """Totals per (column, bin) and per column outside the row's own fold."""
    per_bin = Window.partitionBy("column", "bin")  # one row per fold
    folds = sums.groupBy("column", "fold").agg(*[F.sum(v).alias(f"fold_{v}") for v in values])
    whole = folds.groupBy("column").agg(*[F.sum(f"fold_{v}").alias(f"all_{v}") for v in values])
    out = sums.select("*", *[(F.sum(v).over(per_bin) - F.col(v)).alias(f"rest_{v}") for v in values])
    return out.join(F.broadcast(folds.join(whole, "column")), ["column", "fold"])  # features x folds rows


def _target_sums(known: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], folds: int, bins: int) -> DataFrame:
    """(column, bin, fold, n, s, ss): rows, sum and squares of the target less its mean.

    Numbers are binned and summed in an Arrow pass that ships a few rows a task; the
    nested comparisons of generated code are too long to be compiled. Categories are grouped by key.
    """
    y = number_of(known, target)
    centre = known.agg(F.avg(y)).first()[0] or 0.0
    fold, y = fold_of(keys, folds).alias("fold"), (y - F.lit(centre)).alias("y")
    numeric = [c for c in features if is_numeric(known.schema[c])]
    texts = [c for c in features if c not in numeric]
    edges = bin_edges(known, numeric, bins)
    cuts = [np.array(edges.get(c, []), float) for c in numeric]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((4, folds * (len(e) + 2))) for e in cuts]  # rows, known targets, sum, squares
        for batch in batches:
            f, t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            there = ~np.isnan(t)
            t = np.where(there, t, 0.0)
            for i, e in enumerate(cuts):
                x = batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float)
                place = f * (len(e) + 2) + np.where(np.isnan(x), len(e) + 1, np.searchsorted(e, x, "left"))
                for k, w in enumerate((None, there, t, t * t)):
                    sums[i][k] += np.bincount(place, w, sums[i].shape[1])
        found = [(numeric[i], "missing" if b == len(e) + 1 else str(b), f, *sums[i][:, f * (len(e) + 2) + b]) for i, e in enumerate(cuts) for f in range(folds) for b in range(len(e) + 2)]
        found = [(c, b, f, int(n), s if k else None, ss if k else None) for c, b, f, n, k, s, ss in found if n]
        if found:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*found), kinds)], names=["column", "bin", "fold", "n", "s", "ss"])

    parts = []
    if numeric:
        cells = known.select(fold, y, *[number_of(known, c).alias(f"x{i}") for i, c in enumerate(numeric)])
        some = cells.mapInArrow(add, "column string, bin string, fold int, n long, s double, ss double")
        parts.append(some.groupBy("column", "bin", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    if texts:
        cells = [F.struct(F.lit(c).alias("column"), category_key(known, c).alias("bin")) for c in texts]
        rows = known.select(fold, y, F.inline(F.array(*cells)))
        parts.append(rows.groupBy("column", "bin", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")))
    return materialize(functools.reduce(DataFrame.unionByName, parts))  # read three times


def _regression_scores(sums: DataFrame) -> DataFrame:
    held = _held_out(sums, "n", "s", "ss")
    guess = F.coalesce(F.try_divide("rest_s", F.col("rest_n").cast("double")), F.try_divide(F.col("all_s") - F.col("fold_s"), (F.col("all_n") - F.col("fold_n")).cast("double")), F.lit(0.0))
    error = held.withColumn("p", guess).groupBy("column", "fold").agg(
        F.sum(F.col("ss") - 2 * F.col("p") * F.col("s") + F.col("n") * F.col("p") * F.col("p")).alias("sse"),
        (F.max("fold_ss") - F.max("fold_s") * F.max("fold_s") / F.max("fold_n")).alias("sst"),
    )
    scores = error.groupBy("column").agg(F.avg(1 - F.try_divide("sse", "sst")).alias("score"))
    return scores.select("column", F.lit("r2").alias("metric"), "score")


def _binary_scores(rows: DataFrame, positive: str) -> DataFrame:
    sums = rows.groupBy("column", "bin", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == positive).alias("s"))
    held = _held_out(sums, "n", "s")
    guess = F.coalesce(F.try_divide("rest_s", F.col("rest_n").cast("double")), F.try_divide(F.col("all_s") - F.col("fold_s"), (F.col("all_n") - F.col("fold_n")).cast("double")), F.lit(0.0))
    counts = held.select("column", "fold", guess.alias("p"), F.col("s").alias("pos"), (F.col("n") - F.col("s")).alias("neg"))
    scores = auc_table(counts, ["column", "fold"], "p", "pos", "neg").groupBy("column").agg(F.avg("auc").alias("score"))
    return scores.select("column", F.lit("roc_auc").alias("metric"), "score")


def _multiclass_scores(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("column", "bin", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
    # a row for every (bin, class) in every fold that holds the bin, so that absent classes compete too
    totals = counts.groupBy("column", "bin", "y").agg(F.sum("n").alias("t"))
    folds = counts.select("column", "bin", "fold").distinct()
    options = folds.join(totals, ["column", "bin"]).join(counts, ["column", "bin", "fold", "y"], "left").na.fill({"n": 0})
    pick = options.withColumn("rest", F.col("t") - F.col("n")).groupBy("column", "bin", "fold").agg(
        F.min_by("y", F.struct((-F.col("rest")).alias("k"), F.col("y"))).alias("guess"), F.max("rest").alias("best")
    )
    overall = counts.groupBy("column", "y").agg(F.sum("n").alias("n")).groupBy("column").agg(F.min_by("y", F.struct((-F.col("n")).alias("k"), F.col("y"))).alias("common"))
    pick = pick.join(overall, "column").withColumn("guess", F.when(F.col("best") > 0, F.col("guess")).otherwise(F.col("common")))
    judged = counts.join(pick, ["column", "bin", "fold"]).groupBy("column", "fold").agg((F.sum(F.when(F.col("y") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))
    return judged.groupBy("column").agg(F.avg("a").alias("score")).select("column", F.lit("accuracy").alias("metric"), "score")


def _flag(rows: DataFrame, rule: int, name: str, when: Column, score: Column, reason: Column) -> DataFrame:
    return rows.where(when).select("column", F.lit(rule).alias("rule"), F.lit(name).alias("kind"), score.cast("double").alias("score"), reason.alias("reason"))


def single_feature_flags(scores: DataFrame) -> DataFrame:
    limit = F.when(F.col("metric") == "r2", R2_LIMIT).when(F.col("metric") == "roc_auc", AUC_LIMIT).otherwise(ACCURACY_LIMIT)
    return _flag(scores, 1, "single_feature", F.col("score") > limit, F.col("score"), F.format_string("%s of %.2f from this column alone", "metric", "score"))


def id_like_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    n = df.count()
    # numbers are told apart as they are, eight bytes each, not as text
    key = lambda c: col(c) if is_numeric(df.schema[c]) else value_key(col(c), df.schema[c])
    size = lambda c: df.where(present(df, c)).select(key(c).alias("v")).distinct().agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("k"))
    sizes = functools.reduce(DataFrame.unionByName, [size(c) for c in features])
    share = F.col("k") / F.lit(float(max(n, 1)))
    return _flag(sizes, 2, "id_like", F.lit(n > 5) & (share >= ID_SHARE), F.lit(None), F.format_string("%d distinct values in %d rows", "k", F.lit(n)))


def correlation_flags(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    names = [c for c in features if is_numeric(df.schema[c])]
    if not names or not is_numeric(df.schema[target]):
        return df.sparkSession.createDataFrame([], "column string, rule int, kind string, score double, reason string")
    y = number_of(df, target)
    aggs = []
    for i, c in enumerate(names):
        x = number_of(df, c)
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))).alias(f"r{i}"))
    rows = df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)])))
    return _flag(rows, 3, "correlation", F.abs("r") > CORRELATION_LIMIT, F.col("r"), F.format_string("correlation %.3f with the target", "r"))


def information_shares(df: DataFrame, features: Sequence[str], target: str, task: str, bins: int = 10) -> DataFrame:
    """(column, share): mutual information of a category with the target over the target's entropy."""
    names = [c for c in features if not is_numeric(df.schema[c])]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, share double")
    known = df.where(present(df, target))
    if task == "regression":
        y = number_of(known, target)
        ends = known.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        width = ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / bins or 1.0
        label = F.greatest(F.lit(0), F.least(F.ceil((y - F.lit(ends["lo"] or 0.0)) / F.lit(width)) - 1, F.lit(bins - 1))).cast("string")
    else:
        label = col(target).cast("string")
    cells = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.when(present(known, c), value_key(col(c), known.schema[c])), F.lit("missing")).alias("v")) for c in names
    ]
    joint = materialize(known.select(label.alias("y"), F.inline(F.array(*cells))).groupBy("column", "v", "y").agg(F.count(F.lit(1)).alias("n")))  # read four times
    by_v = joint.groupBy("column", "v").agg(F.sum("n").alias("nv"))
    by_y = joint.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    total = by_y.groupBy("column").agg(F.sum("ny").alias("t"))
    entropy = by_y.join(total, "column").groupBy("column").agg((-F.sum(F.col("ny") / F.col("t") * F.log(F.col("ny") / F.col("t")))).alias("h"))
    terms = joint.join(by_v, ["column", "v"]).join(by_y, ["column", "y"]).join(F.broadcast(total), "column")
    info = terms.groupBy("column").agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t").cast("double") / (F.col("nv") * F.col("ny").cast("double")))).alias("mi")
    )
    return info.join(entropy, "column").select("column", F.coalesce(F.try_divide("mi", "h"), F.lit(0.0)).alias("share"))


def information_flags(shares: DataFrame) -> DataFrame:
    return _flag(shares, 4, "information", F.col("share") > MI_LIMIT, F.col("share"), F.format_string("carries %.2f of the target's information", "share"))


def merge_flags(*flags: DataFrame) -> DataFrame:
    """(column, kind, score, reason): the first rule per column wins."""
    rows = functools.reduce(DataFrame.unionByName, flags)
    first = rows.groupBy("column").agg(F.min_by(F.struct("kind", "score", "reason"), "rule").alias("f"))
    return first.select("column", "f.kind", "f.score", "f.reason")


def leakage_scan(df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str], folds: int = 5) -> DataFrame:
    """(column, kind, score, reason) of the columns that give the target away."""
    known = df.where(present(df, target))
    return merge_flags(
        single_feature_flags(single_feature_scores(known, features, target, task, keys, folds)),
        id_like_flags(known, features),
        correlation_flags(known, features, target),
        information_flags(information_shares(known, features, target, task)),
    )


def feature_buckets(df: DataFrame, features: Sequence[str], leakage: DataFrame, importance: DataFrame) -> DataFrame:
    """(column, bucket, reason): leakage, harmful, high_signal or low_signal."""
    texts = [c for c in features if not is_numeric(df.schema[c])]
    n = df.count()
    sizes = value_counts(df, features).groupBy("column").agg(F.count(F.lit(1)).alias("k"))
    listed = df.sparkSession.createDataFrame([(c, c in texts) for c in features], "column string, is_text boolean")
    rows = listed.join(sizes, "column", "left").join(leakage.select("column", F.col("reason").alias("leak")), "column", "left")
    rows = rows.join(importance.select("column", "importance"), "column", "left")
    k, score = F.coalesce("k", F.lit(0)), F.coalesce("importance", F.lit(0.0))
    kind = lambda bucket, reason: F.struct(bucket.alias("b"), reason.alias("r"))
    said = lambda bucket, reason: kind(F.lit(bucket), F.lit(reason))
    chosen = (
        F.when(F.col("leak").isNotNull(), kind(F.lit("leakage"), F.col("leak")))
        .when(k <= 1, said("harmful", "constant"))
        .when(F.col("is_text") & (k > 0.5 * n), said("harmful", "high cardinality"))
        .when(score >= 0.01, said("high_signal", "importance"))
        .when(score < -0.005, said("harmful", "negative importance"))
        .otherwise(said("low_signal", "importance"))
    )
    return rows.withColumn("kind", chosen).select("column", F.col("kind.b").alias("bucket"), F.col("kind.r").alias("reason"))


def harmful_features(buckets: DataFrame, warnings: DataFrame) -> DataFrame:
    """(feature, reason): harmful and leaking columns and warned ones, each once, buckets first."""
    a = buckets.where(F.col("bucket").isin("harmful", "leakage")).select(F.col("column").alias("feature"), "reason", F.lit(1).alias("o"))
    b = warnings.select("feature", "reason", F.lit(2).alias("o"))
    first = a.unionByName(b).groupBy("feature").agg(F.min_by("reason", F.struct("o", "reason")).alias("reason"))
    return first

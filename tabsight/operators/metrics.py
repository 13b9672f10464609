"""Cross-validation metrics from a table of predictions: (fold, label, prediction[, score])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .target import auc_table

LOWER_IS_BETTER = ("rmse", "mae", "mape", "training_time", "inference_time")


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, accuracy, precision, recall, f1, balanced_accuracy), class-weighted, 0 where undefined."""
    cells = predictions.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy("fold", F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy("fold", F.col("prediction").alias("c")).agg(F.sum("n").alias("said"))
    per = truth.join(said, ["fold", "c"], "left")
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("said").cast("double")), F.lit(0.0))
    recall = F.col("hit") / F.col("support").cast("double")
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    per = per.select("fold", "support", "hit", precision.alias("p"), recall.alias("r")).withColumn("f", f1)
    weighted = lambda c: (F.sum(F.col("support") * F.col(c)) / F.sum("support"))
    return per.groupBy("fold").agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        weighted("p").alias("precision"),
        weighted("r").alias("recall"),
        weighted("f").alias("f1"),
        F.avg("r").alias("balanced_accuracy"),
    )


def roc_auc(predictions: DataFrame, positive=1.0, score: str = "score") -> DataFrame:
    """(fold, roc_auc) of a two-class score; null when a fold lacks a class."""
    hit = (F.col("label") == F.lit(positive)).cast("long")
    counts = predictions.select("fold", F.col(score).alias("s"), hit.alias("pos"), (1 - hit).alias("neg"))
    return auc_table(counts, ["fold"], "s", "pos", "neg").select("fold", F.col("auc").alias("roc_auc"))


def roc_auc_one_vs_rest(predictions: DataFrame, classes: Sequence, scores: str = "scores") -> DataFrame:
    """(fold, roc_auc): area of each class against the rest, weighted by class size."""
    per = [
        F.struct(F.lit(i).alias("c"), F.col(scores)[i].alias("s"), (F.col("label") == F.lit(c)).cast("long").alias("pos"), (F.col("label") != F.lit(c)).cast("long").alias("neg"))
        for i, c in enumerate(classes)
    ]
    long = predictions.select("fold", F.inline(F.array(*per)))
    areas = auc_table(long, ["fold", "c"], "s", "pos", "neg").where("auc is not null")
    return areas.groupBy("fold").agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, mae, rmse, r2, mape); mape over the rows whose label is not 0."""
    e = F.col("label") - F.col("prediction")
    return predictions.groupBy("fold").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))).alias("r2"),
        F.avg(F.when(F.col("label") != 0, F.abs(e / F.col("label")))).alias("mape"),
    )


def across_folds(per_fold: DataFrame) -> DataFrame:
    """(metric, mean, std): population deviation over the folds in which the metric exists."""
    names = [c for c in per_fold.columns if c != "fold"]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])
    long = per_fold.select(F.inline(cells)).where("v is not null and not isnan(v)")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def compare_models(results: DataFrame, metric: str) -> DataFrame:
    """(model, value, share, rank): best first by the metric's direction, missing last."""
    rows = results.where(F.col("metric") == metric).select("model", F.col("mean").alias("value"))
    lower = metric in LOWER_IS_BETTER
    order = F.col("value").asc_nulls_last() if lower else F.col("value").desc_nulls_last()
    one = Window.partitionBy(F.lit(0))  # one row per model
    return rows.select(
        "model", "value", F.try_divide("value", F.max("value").over(one)).alias("share"), F.row_number().over(one.orderBy(order, "model")).alias("rank")
    )


def best_model(results: DataFrame, task: str) -> DataFrame:
    """One row: the model with the highest ROC-AUC (classification) or R2 (regression)."""
    metric = "roc_auc" if task == "classification" else "r2"
    rows = results.where((F.col("metric") == metric) & F.col("mean").isNotNull())
    return rows.orderBy(F.desc("mean"), "model").limit(1).select("model", "metric", F.col("mean").alias("score"))


def top_candidates(candidates: DataFrame, keep: int = 5) -> DataFrame:
    """(rank, params, mean, std): the best parameter sets of a search; equal means share a rank."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"))  # one row per parameter set
    ranked = candidates.withColumn("rank", F.rank().over(w))
    return ranked.orderBy("rank", "params").limit(keep).select("rank", "params", "mean", "std")


def tuned_against_baseline(tuned: DataFrame, baseline: DataFrame) -> DataFrame:
    """(model, tuned, baseline, gain)."""
    a = tuned.select("model", F.col("score").alias("tuned"))
    b = baseline.select("model", F.col("score").alias("baseline"))
    return a.join(b, "model", "left").withColumn("gain", F.col("tuned") - F.col("baseline"))

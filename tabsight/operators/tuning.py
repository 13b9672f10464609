"""Grid and random search over the cross-validation folds of `learners`."""

from __future__ import annotations

import functools
import itertools
import json
import random
from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import metrics
from .learners import base_table, model_pipeline, neighbor_lists, with_folds
from .prep import split_columns

# The default grid of each model, by Spark parameter name.
GRIDS: dict[str, dict[str, list]] = {
    "baseline": {"regParam": [0.0, 0.01, 0.1, 1.0]},
    "boosting": {"maxIter": [50, 100], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "random_forest": {"numTrees": [50, 100], "maxDepth": [5, 10], "minInstancesPerNode": [1, 5]},
    "svm": {"regParam": [0.001, 0.01, 0.1], "maxIter": [50, 100]},
    "knn": {"neighbors": [3, 5, 7, 11, 15], "weights": ["uniform", "distance"]},
}


class AreaOneVsRest(Evaluator):
    """ROC-AUC of each class against the rest, weighted by class size."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes = classes

    def _evaluate(self, dataset: DataFrame) -> float:
        source = "probability" if "probability" in dataset.columns else "rawPrediction"
        scored = dataset.withColumn("fold", F.lit(0)).withColumn("scores", vector_to_array(source))
        first = metrics.roc_auc_one_vs_rest(scored, [float(c) for c in range(self.classes)]).first()
        return float("nan") if first is None or first["roc_auc"] is None else first["roc_auc"]

    def isLargerBetter(self) -> bool:
        return True


def scoring(task: str, classes: int) -> Evaluator:
    """R2, ROC-AUC, or one-against-rest ROC-AUC beyond two classes."""
    if task == "regression":
        return RegressionEvaluator(labelCol="label", metricName="r2")
    if classes == 2:
        return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    return AreaOneVsRest(classes)


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def _drawn(grid: Mapping[str, Sequence], n_iter: int | None, seed: int) -> list[dict]:
    tried = combinations(grid)
    return random.Random(seed).sample(tried, n_iter) if n_iter is not None and n_iter < len(tried) else tried


def _weights(near: Column, how: str) -> Column:
    """One weight per neighbour: 1, or the inverse distance; neighbours at distance 0 then count alone."""
    if how == "uniform":
        return F.transform(near, lambda e: F.lit(1.0))
    exact = F.exists(near, lambda e: e["distance"] == 0)
    return F.transform(near, lambda e: F.when(exact, (e["distance"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), e["distance"])))


def neighbor_search(folded: DataFrame, features: Sequence[str], task: str, tried: Sequence[Mapping], folds: int, classes: int) -> DataFrame:
    """(params, mean, std) of nearest-neighbour models, from one neighbour search a fold.

    The list of the greatest k holds those of all smaller ones as its head, so every
    set is a weighting of the same lists, and all sets are scored in one aggregation.
    """
    numeric, categorical = split_columns(folded, features)
    most = max(one["neighbors"] for one in tried)
    lists = []
    for f in range(folds):
        held = neighbor_lists(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), numeric, categorical, most)
        lists.append(materialize(held.where(F.size("near") > 0).select(F.lit(f).alias("f"), "label", "near")))
    near = functools.reduce(DataFrame.unionByName, lists)
    guesses = []
    for at, one in enumerate(tried):
        head = F.slice("near", 1, one["neighbors"])
        weights = _weights(head, one.get("weights", "uniform"))
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        part_of = lambda each: F.aggregate(F.zip_with(head, weights, each), F.lit(0.0), lambda a, v: a + v) / total
        fold = F.concat_ws("|", F.lit(at), "f").alias("fold")
        if task == "regression":
            guesses.append(F.struct(fold, part_of(lambda e, w: e["label"] * w).alias("prediction")))
        else:
            votes_for = lambda c: lambda e, w: F.when(e["label"] == float(c), w).otherwise(0.0)
            guesses.append(F.struct(fold, F.array(*[part_of(votes_for(c)) for c in range(classes)]).alias("scores")))
    scored = materialize(near.select("label", F.inline(F.array(*guesses))))
    if task == "regression":
        per_fold = metrics.regression_metrics(scored).select("fold", F.col("r2").alias("score"))
    elif classes == 2:
        per_fold = metrics.roc_auc(scored.withColumn("score", F.col("scores")[1])).select("fold", F.col("roc_auc").alias("score"))
    else:
        per_fold = metrics.roc_auc_one_vs_rest(scored, [float(c) for c in range(classes)]).select("fold", F.col("roc_auc").alias("score"))
    names = F.array(*[F.lit(json.dumps(one, sort_keys=True)) for one in tried])
    number = F.split("fold", "[|]")[0].cast("int")
    return per_fold.groupBy(names[number].alias("params")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def search(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], task: str, model: str, grid=None, n_iter: int | None = None, folds: int = 3,
    parallelism: int = 2, seed: int = 42, params=None,
) -> DataFrame:
    """(params, mean, std) of every tried set; `n_iter` draws that many sets from the grid."""
    rows, names = base_table(df, features, target, task, keys)
    folded = with_folds(rows, task, [c for c in rows.columns if c.startswith("__key")], folds).persist()
    if model == "knn":
        tried = _drawn(grid or GRIDS[model], n_iter, seed)
        try:
            return materialize(neighbor_search(folded, features, task, tried, folds, max(2, len(names))))
        finally:
            folded.unpersist()
    numeric, categorical = split_columns(rows, features)
    pipeline = model_pipeline(model, task, numeric, categorical, max(2, len(names)), params)
    learner = pipeline.getStages()[-1]
    tried = _drawn(grid or GRIDS[model], n_iter, seed)
    maps = [{learner.getParam(k): v for k, v in one.items()} for one in tried]
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=maps, evaluator=scoring(task, max(2, len(names))), foldCol="fold", numFolds=folds, parallelism=parallelism
    )
    try:
        fitted = cv.fit(folded)
    finally:
        folded.unpersist()
    data = [(json.dumps(t, sort_keys=True), float(m), float(s)) for t, m, s in zip(tried, fitted.avgMetrics, fitted.stdMetrics)]
    return df.sparkSession.createDataFrame(data, "params string, mean double, std double")


def grid_search(df, features, target, keys, task, model, grid=None, **more) -> DataFrame:
    """The best parameter sets of the whole grid."""
    return metrics.top_candidates(search(df, features, target, keys, task, model, grid, None, **more))


def random_search(df, features, target, keys, task, model, grid=None, n_iter: int = 5, **more) -> DataFrame:
    """The best of `n_iter` parameter sets drawn from the grid with a fixed seed."""
    return metrics.top_candidates(search(df, features, target, keys, task, model, grid, n_iter, **more))

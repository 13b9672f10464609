"""Learners, leakage-safe cross-validation and model comparison on Spark ML.

All preprocessing is fitted inside a fold, on its training rows only.
"""

from __future__ import annotations

import functools
import time
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, number_of, present
from ..functions.ranks import cumulative_counts
from ..session import materialize
from . import metrics, moments, neighbors
from .ingest import normalize_missing
from .prep import check_labels, split_columns
from .target import class_imbalance, detect_task, fold_of, leakage_scan

MODELS = ("baseline", "boosting", "random_forest", "svm", "knn")
DEFAULTS = {"iterations": 100, "trees": 100, "neighbors": 5, "depth": 5}
MAX_CLASSES = 1000
BLOCK_ROWS = 4_000  # rows of either side that meet in one nearest-neighbour task
ROUND_ROWS = 20_000  # rows a task of an iterative fit has at least: each of its rounds is a job


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], scale: bool) -> list:
    """Median-filled (and scaled) numbers, one-hot categories with unknown values allowed."""
    stages, inputs = [], []
    if numeric:
        filled = [f"__n{i}" for i in range(len(numeric))]
        stages.append(Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"))
        if scale:
            stages += [VectorAssembler(inputCols=filled, outputCol="__numbers"), StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True)]
            inputs.append("__scaled")
        else:
            inputs += filled
    if categorical:
        index = [f"__i{i}" for i in range(len(categorical))]
        hot = [f"__h{i}" for i in range(len(categorical))]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="keep"),
        ]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def estimator(model: str, task: str, classes: int, params: Mapping[str, Any] | None = None):
    """The Spark ML estimator behind a model key."""
    p = {**DEFAULTS, **(params or {})}
    if task == "regression":
        made = {
            "baseline": lambda: LinearRegression(maxIter=p["iterations"], regParam=p.get("reg", 0.0)),
            "boosting": lambda: GBTRegressor(maxIter=p["iterations"], maxDepth=p["depth"], seed=42),
            "random_forest": lambda: RandomForestRegressor(numTrees=p["trees"], maxDepth=p["depth"], seed=42),
        }
    else:
        boosted = GBTClassifier(maxIter=p["iterations"], maxDepth=p["depth"], seed=42)
        machine = LinearSVC(maxIter=p["iterations"], regParam=p.get("reg", 0.01))
        made = {
            "baseline": lambda: LogisticRegression(maxIter=max(p["iterations"], 1000) if not params else p["iterations"], regParam=p.get("reg", 0.0)),
            "boosting": lambda: boosted if classes <= 2 else OneVsRest(classifier=boosted),
            "random_forest": lambda: RandomForestClassifier(numTrees=p["trees"], maxDepth=p["depth"], seed=42),
            "svm": lambda: machine if classes <= 2 else OneVsRest(classifier=machine),
        }
    if model not in made:
        raise ValueError(f"{model} is not available for {task}")
    return made[model]().setFeaturesCol("features").setLabelCol("label")


def model_pipeline(model: str, task: str, numeric, categorical, classes: int = 2, params: Mapping[str, Any] | None = None) -> Pipeline:
    scale = model in ("baseline", "svm", "knn")
    return Pipeline(stages=[*preprocessing(numeric, categorical, scale), estimator(model, task, classes, params)])


def base_table(df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(rows with known target and a numeric `label`, class names in label order)."""
    known = normalize_missing(df).where(present(df, target))
    numeric, categorical = split_columns(known, features)
    check_labels(known, categorical)
    chosen = [col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    cells = [number_of(known, c).alias(c) if c in numeric else col(c).cast("string").alias(c) for c in features]
    if task == "regression":
        return known.select(*chosen, *cells, number_of(known, target).alias("label")), []
    names = [r["v"] for r in known.select(col(target).alias("v")).distinct().orderBy("v").limit(MAX_CLASSES + 1).collect()]
    if len(names) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
    code = F.array_position(F.array(*[F.lit(str(n)) for n in names]), col(target).cast("string")) - 1
    return known.select(*chosen, *cells, code.cast("double").alias("label")), [str(n) for n in names]


def with_folds(rows: DataFrame, task: str, keys: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """Add `fold`. Classes are dealt evenly over the folds unless one has fewer rows than folds.

    Dealing needs each row's place within its class: that comes from
    distributed prefix counts over the key's hash, not from one window per class.
    """
    if task == "classification":
        least = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        if least is not None and least >= folds:
            hashed = rows.withColumn("__h", F.xxhash64(*[col(k) for k in keys], F.lit(seed)))
            counts = hashed.groupBy("label", "__h").agg(F.count(F.lit(1)).alias("n"))
            place = cumulative_counts(counts, ["label"], "__h").select("label", "__h", (F.col("below") % folds).cast("int").alias("fold"))
            return hashed.join(place, ["label", "__h"]).drop("__h")
    return rows.withColumn("fold", fold_of(keys, folds, seed))


# -- nearest neighbours --------------------------------------------------------


def nearest_labels(train: DataFrame, test: DataFrame, k: int, exclude_same_key: bool = False) -> DataFrame:
    """Test rows with `near`: the k nearest training rows as (distance, key, label), exact, ties to the smaller key."""
    return neighbors.nearest(train, test, k, exclude_same_key, BLOCK_ROWS)


def vote(near: DataFrame, task: str) -> DataFrame:
    """Add `prediction`: the mean of the neighbours' labels, or the most frequent one (smallest on ties)."""
    labels = F.transform("near", lambda e: e["label"])
    if task == "regression":
        return near.withColumn("prediction", F.aggregate(labels, F.lit(0.0), lambda a, x: a + x) / F.size("near"))
    counted = F.transform(
        F.array_distinct(labels), lambda c: F.struct((-F.size(F.filter(labels, lambda x: x == c))).alias("n"), c.alias("label"))
    )
    return near.withColumn("prediction", F.array_min(counted)["label"])


# -- cross-validation ------------------------------------------------------------


def neighbor_lists(train, test, numeric, categorical, k: int) -> DataFrame:
    """(key, vector, label, near) of the test rows, with preprocessing learned on the training rows."""
    prep = Pipeline(stages=preprocessing(numeric, categorical, True)).fit(train)
    vec = vector_to_array("features")
    side = lambda d: prep.transform(d).select(F.concat_ws("|", *[c for c in d.columns if c.startswith("__key")]).alias("key"), vec.alias("vector"), "label")
    return nearest_labels(side(train), side(test), k)


def _predict_knn(train, test, task, numeric, categorical, classes, k):
    near = vote(neighbor_lists(train, test, numeric, categorical, k), task)
    if task == "regression":
        return near.select("label", "prediction")

    def share_of(c: int):
        return F.size(F.filter("near", lambda e: e["label"] == F.lit(float(c)))) / F.size("near")

    share = F.array(*[share_of(c) for c in range(classes)])
    return near.select("label", "prediction", share.alias("scores"))


def calibrated(fitted: PipelineModel, train: DataFrame):
    """Probability of class 1 from the margin, by a logistic fit on that one number."""
    margins = VectorAssembler(inputCols=["__m"], outputCol="__margin")
    side = fitted.transform(train).select("label", vector_to_array("rawPrediction")[1].alias("__m"))
    curve = LogisticRegression(featuresCol="__margin", maxIter=50).fit(margins.transform(side))
    slope, base = float(curve.coefficients[0]), float(curve.intercept)
    return lambda rows: 1 / (1 + F.exp(-(F.lit(slope) * vector_to_array("rawPrediction")[1] + F.lit(base))))


def fit_predict(model, train, test, task, numeric, categorical, classes, params=None) -> tuple[DataFrame, float]:
    """((label, prediction[, scores]) of the test rows, seconds spent fitting)."""
    start = time.perf_counter()
    if model == "knn":
        k = {**DEFAULTS, **(params or {})}["neighbors"]
        return _predict_knn(train, test, task, numeric, categorical, classes, k), time.perf_counter() - start
    fitted = model_pipeline(model, task, numeric, categorical, classes, params).fit(train)
    seconds = time.perf_counter() - start
    out = fitted.transform(test)
    if task == "regression":
        return out.select("label", "prediction"), seconds
    if model == "svm" and classes == 2:
        p = calibrated(fitted, train)(out)
        return out.select("label", "prediction", F.array(1 - p, p).alias("scores")), seconds
    scores = vector_to_array("probability") if "probability" in out.columns else vector_to_array("rawPrediction")
    return out.select("label", "prediction", scores.alias("scores")), seconds


def _linear_folds(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], penalty: float) -> tuple[DataFrame, DataFrame]:
    """Linear least squares of all folds from one scan of sums; the clock is shared evenly."""
    start = time.perf_counter()
    models, by, design = moments.fold_models(rows, numeric, categorical, penalties=(penalty,))
    folds = [f for f, _ in by]
    spent = (time.perf_counter() - start) / max(1, len(folds))
    start = time.perf_counter()
    kept = materialize(moments.predictions(rows, design, {f: w for (f, _), w in by.items()}))
    n = kept.count()
    clock = rows.sparkSession.createDataFrame([(f, spent, (time.perf_counter() - start) * 1000.0 / n if n else None) for f in folds], "fold int, training_time double, inference_time double")
    return kept, metrics.across_folds(metrics.regression_metrics(kept).join(clock, "fold"))


def cross_validate(rows: DataFrame, model: str, task: str, features: Sequence[str], folds: int, classes: int = 2, params=None) -> tuple[DataFrame, DataFrame]:
    """(predictions of all folds, (metric, mean, std))."""
    numeric, categorical = split_columns(rows, features)
    if model == "baseline" and task == "regression":
        try:
            return _linear_folds(rows, numeric, categorical, (params or {}).get("reg", 0.0))
        except moments.TooWide:  # such designs are fitted iteratively
            pass
    parts, timing = [], []
    for f in range(folds):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        predicted, seconds = fit_predict(model, train, test, task, numeric, categorical, classes, params)
        start = time.perf_counter()
        kept = materialize(predicted.withColumn("fold", F.lit(f)))
        n = kept.count()
        timing.append((f, seconds, (time.perf_counter() - start) * 1000.0 / n if n else None))
        parts.append(kept)
    predictions = functools.reduce(DataFrame.unionByName, parts)
    if task == "regression":
        per_fold = metrics.regression_metrics(predictions)
    else:
        per_fold = metrics.classification_metrics(predictions)
        if classes == 2:
            area = metrics.roc_auc(predictions.withColumn("score", F.col("scores")[1]))
        else:
            area = metrics.roc_auc_one_vs_rest(predictions, [float(c) for c in range(classes)])
        per_fold = per_fold.join(area, "fold", "left")
    clock = rows.sparkSession.createDataFrame(timing, "fold int, training_time double, inference_time double")
    per_fold = per_fold.join(clock, "fold")
    return predictions, metrics.across_folds(per_fold)


def train_models(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], task: str, selection: Sequence[str] = (), folds: int = 5, params=None
) -> DataFrame:
    """(model, metric, mean, std) for the chosen models; unknown names fall back to all of them.

    A model that cannot be fitted is skipped with a warning.
    """
    rows, names = base_table(df, features, target, task, keys)
    n = rows.count()
    if n < 2:
        raise ValueError("at least two rows with a known target are needed")
    folds = folds if n >= folds else max(2, n)
    folded = with_folds(rows, task, [c for c in rows.columns if c.startswith("__key")], folds).persist()
    chosen = [m for m in selection if m in MODELS] or list(MODELS)
    few = folded.coalesce(-(-n // ROUND_ROWS))
    parts = []
    try:
        for model in chosen:
            try:
                result = cross_validate(few if model in ("baseline", "svm") else folded, model, task, features, folds, max(2, len(names)), params)[1]
                parts.append(materialize(result.select(F.lit(model).alias("model"), "metric", "mean", "std")))
            except Exception as problem:  # a learner that does not fit the data must not stop the others
                warnings.warn(f"{model} skipped: {problem}", stacklevel=2)
    finally:
        folded.unpersist()
    if not parts:
        raise RuntimeError("no model could be trained")
    return functools.reduce(DataFrame.unionByName, parts)


def boosted_feature_scores(df: DataFrame, features: Sequence[str], target: str, task: str, keys: Sequence[str], folds: int = 5, params=None) -> DataFrame:
    """(column, metric, score): cross-validated boosting on each feature alone.

    The model-based variant of `target.single_feature_scores`; one small model
    per feature and fold, so meant for a shortlist of columns.
    """
    rows, names = base_table(df, features, target, task, keys)
    folded = with_folds(rows, task, [c for c in rows.columns if c.startswith("__key")], folds).persist()
    classes = max(2, len(names))
    metric = "r2" if task == "regression" else ("roc_auc" if classes == 2 else "accuracy")
    parts = []
    try:
        for c in features:
            scores = cross_validate(folded, "boosting", task, [c], folds, classes, params)[1]
            one = scores.where(F.col("metric") == metric).select(F.lit(c).alias("column"), "metric", F.col("mean").alias("score"))
            parts.append(materialize(one))
    finally:
        folded.unpersist()
    return functools.reduce(DataFrame.unionByName, parts)


def fit_best(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], task: str, model: str, params=None) -> tuple[PipelineModel, DataFrame]:
    """(pipeline refitted on all rows, the rows it saw)."""
    rows, names = base_table(df, features, target, task, keys)
    numeric, categorical = split_columns(rows, features)
    return model_pipeline(model, task, numeric, categorical, max(2, len(names)), params).fit(rows), rows


def run_modeling(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], selection=(), folds: int = 5, params=None) -> dict[str, DataFrame]:
    """Task, leakage flags, results without the leaking columns, best model and class balance, as DataFrames."""
    detected = detect_task(df, target)
    task = detected.first()["task"]
    leakage = materialize(leakage_scan(df, features, target, task, keys, folds))
    leaking = {r["column"] for r in leakage.select("column").collect()}  # at most one row per feature
    safe = [c for c in features if c not in leaking]
    if not safe:
        raise ValueError("every feature gives the target away")
    results = train_models(df, safe, target, keys, task, selection, folds, params)
    return {
        "task": detected,
        "leakage": leakage,
        "results": results,
        "best": metrics.best_model(results, task),
        "imbalance": class_imbalance(df, target),
    }

"""Modelling queries (L, F26, F27)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import binboost, charts, explain, learners, metrics, moments, target, tuning
from ..operators.prep import split_columns
from ..session import load
from .fixtures import MESSY_ORDERS_SQL, messy_orders
from .registry import query

LIGHT = {"iterations": 5, "trees": 5, "depth": 3}  # small learners keep the check short


@query(
    "detect_task",
    """SELECT 'l_extendedprice' AS target, 'regression' AS task, count(DISTINCT l_extendedprice) AS "distinct" FROM lineitem
    UNION ALL SELECT 'l_linenumber', 'classification', count(DISTINCT l_linenumber) FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'classification', count(DISTINCT l_returnflag) FROM lineitem""",
)
def _(spark, sf):
    l = load(spark, sf, "lineitem")
    out = None
    for t in ("l_extendedprice", "l_linenumber", "l_returnflag"):
        one = target.detect_task(l, t).select(F.lit(t).alias("target"), "task", "distinct")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "target_suitability",
    f"""WITH {MESSY_ORDERS_SQL} SELECT 'regression' AS task, count(*) AS rows, round((count(*) - count(price)) * 100.0 / count(*), 6) AS missing_pct,
    CAST((count(*) - count(price)) * 100.0 / count(*) > 10 AS INT) AS issues, CAST(count(*) < 50 * 2 AS INT) AS warnings, NOT ((count(*) - count(price)) * 100.0 / count(*) > 10) AS suitable FROM messy
    UNION ALL SELECT 'classification', count(*), 0.0, 0, CAST(count(*) FILTER (WHERE quality = 1) > 0.8 * count(*) AS INT) + CAST(count(*) < 100 AS INT), true FROM labels""",
)
def _(spark, sf):
    a = target.target_suitability(messy_orders(spark, sf), ["priority", "status"], "price", "regression")
    b = target.target_suitability(load(spark, sf, "labels"), ["doc_id", "toxic"], "quality", "classification")
    both = a.unionByName(b).select("task", "rows", "missing_pct", F.size("issues").alias("issues"), F.size("warnings").alias("warnings"), "suitable")
    return rounded(both)


@query(
    "class_imbalance",
    """WITH c AS (SELECT CAST(quality AS VARCHAR) AS q, count(*) AS n FROM labels GROUP BY 1)
    SELECT arg_max(q, n) AS majority, count(*) AS classes, round(max(n) * 1.0 / sum(n), 4) AS majority_share, max(n) > 0.8 * sum(n) AS imbalanced FROM c""",
)
def _(spark, sf):
    return target.class_imbalance(load(spark, sf, "labels"), "quality").drop("message")


# lineitem with columns that give the price away: a noisy copy and a coarse cut
_LEAKY_SQL = """k AS (SELECT *, l_extendedprice * 1.001 + l_quantity AS copy, 'cut' || CAST(floor(l_extendedprice / 12000) AS VARCHAR) AS cut,
    l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice AS tag FROM lineitem)"""
LEAKY = ["l_quantity", "l_discount", "copy", "cut", "l_returnflag"]
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def leaky(spark, sf):
    l = load(spark, sf, "lineitem")
    return l.withColumn("copy", F.col("l_extendedprice") * 1.001 + F.col("l_quantity")).withColumn(
        "cut", F.concat(F.lit("cut"), F.floor(F.col("l_extendedprice") / 12000).cast("string"))
    )


@query("leakage_single_feature_regression")
def _(spark, sf):
    return rounded(target.single_feature_scores(leaky(spark, sf), LEAKY, "l_extendedprice", "regression", ROW_KEY), 4)


def _docs(spark, sf):
    d, l = load(spark, sf, "documents", "labels")
    return d.join(l, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality", "toxic")


@query("leakage_single_feature_binary")
def _(spark, sf):
    return rounded(target.single_feature_scores(_docs(spark, sf), ["n_chars", "lang", "source", "toxic"], "quality", "classification", ["doc_id"]), 4)


@query("leakage_single_feature_multiclass")
def _(spark, sf):
    o = load(spark, sf, "orders").withColumn("half", F.substring("o_orderpriority", 1, 1))
    return rounded(target.single_feature_scores(o, ["half", "o_custkey", "o_orderstatus"], "o_orderpriority", "classification", ["o_orderkey"]), 4)


@query("boosted_scan_regression")
def _(spark, sf):
    return _boosted(leaky(spark, sf), LEAKY, "l_extendedprice", "regression", ROW_KEY)


@query("boosted_scan_binary")
def _(spark, sf):
    return _boosted(_docs(spark, sf), ["n_chars", "lang", "source", "toxic"], "quality", "classification", ["doc_id"])


@query("boosted_scan_multiclass")
def _(spark, sf):
    o = load(spark, sf, "orders").withColumn("half", F.substring("o_orderpriority", 1, 1))
    return _boosted(o, ["half", "o_custkey", "o_orderstatus", "o_totalprice"], "o_orderpriority", "classification", ["o_orderkey"])


def _boosted(df, features, goal, task, keys):
    return rounded(binboost.single_column_scores(df, features, goal, task, keys).drop("fold_scores"), 4)


_LINEAR_FOLDS = """WITH d AS (SELECT l_orderkey % 5 AS fold, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
    t AS (SELECT k AS fold, count(*) AS n, regr_slope(y, x) AS slope, avg(x) AS mx, avg(y) AS my FROM d JOIN range(5) AS r(k) ON d.fold <> k GROUP BY 1),
    w AS (SELECT *, slope / (1 + penalty) AS w FROM t, (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) AS p(penalty))
    SELECT w.fold::INTEGER AS fold, penalty, n AS train_rows, count(*) AS held_rows, round(my - w * mx, 4) AS intercept, round(w, 6) AS slope,
      round(sqrt(avg((y - my - w * (x - mx)) ** 2)), 4) AS rmse, round(1 - avg((y - my - w * (x - mx)) ** 2) / var_pop(y), 8) AS r2
    FROM w JOIN d ON d.fold = w.fold GROUP BY w.fold, penalty, n, w, mx, my"""


@query("linear_fold_models", _LINEAR_FOLDS)
def _(spark, sf):
    rows = load(spark, sf, "lineitem").withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))
    found, _, _ = moments.fold_models(rows, ["l_quantity"], label="l_extendedprice", penalties=(0.0, 0.5))
    names = ["fold", "penalty", "train_rows", "held_rows", F.round("intercept", 4).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope")]
    return found.select(*names, F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


@query(
    "leakage_id_like",
    """SELECT c AS "column", printf('%d distinct values in %d rows', k, n) AS reason FROM (
    SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS k, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), count(*) FROM orders) WHERE k >= 0.95 * n""",
)
def _(spark, sf):
    return target.id_like_flags(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]).select("column", "reason")


@query(
    "leakage_correlation",
    f"WITH {_LEAKY_SQL} SELECT 'copy' AS \"column\", round(corr(copy, l_extendedprice), 6) AS score FROM k HAVING abs(corr(copy, l_extendedprice)) > 0.98",
)
def _(spark, sf):
    return rounded(target.correlation_flags(leaky(spark, sf), LEAKY, "l_extendedprice").select("column", "score"))


def _mi_share_sql(column):
    return f"""SELECT '{column}' AS "column", round(sum(n / t * ln(n * t / (nv * ny))) / max(h), 6) AS share FROM (
        SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY v) AS DOUBLE) AS nv, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny
        FROM (SELECT {column} AS v, y, count(*) AS n FROM b GROUP BY 1, 2)), (SELECT -sum(p * ln(p)) AS h FROM (SELECT count(*) * 1.0 / (SELECT count(*) FROM b) AS p FROM b GROUP BY y))"""


@query(
    "leakage_information",
    f"""WITH {_LEAKY_SQL}, e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM k),
    b AS (SELECT *, greatest(0, least(ceil((l_extendedprice - lo) / w) - 1, 9)) AS y FROM k, e) {_mi_share_sql('cut')} UNION ALL {_mi_share_sql('l_returnflag')}""",
)
def _(spark, sf):
    return rounded(target.information_shares(leaky(spark, sf), LEAKY, "l_extendedprice", "regression"))


@query("leakage_scan")
def _(spark, sf):
    found = target.leakage_scan(leaky(spark, sf), LEAKY, "l_extendedprice", "regression", ROW_KEY)
    return rounded(found.select("column", "kind", "score"), 4)


@query(
    "leakage_merge",
    """SELECT * FROM (SELECT 'o_orderkey' AS "column", 'id_like' AS kind FROM orders UNION SELECT 'o_totalprice', CASE WHEN (SELECT count(DISTINCT o_totalprice) >= 0.95 * count(*) FROM orders) THEN 'id_like' ELSE 'correlation' END FROM orders)""",
)
def _(spark, sf):
    o = load(spark, sf, "orders").withColumn("goal", F.col("o_totalprice") * 2)
    cols = ["o_orderkey", "o_totalprice", "o_custkey"]
    flags = target.merge_flags(target.id_like_flags(o, cols), target.correlation_flags(o, cols, "goal"))
    return flags.select("column", "kind")


# predictions both engines can derive: a rule-based guess on five folds
_PRED_CLASS = """p AS (SELECT o_orderkey % 5 AS fold, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 7 < 3 THEN 0 ELSE CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END END AS prediction, o_totalprice, o_orderkey FROM orders)"""


def _class_predictions(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    label = F.when(s == "F", 0).when(s == "O", 1).otherwise(2)
    guess = F.when(k % 3 == 0, 1).when(k % 7 < 3, 0).otherwise(label)
    return load(spark, sf, "orders").select((k % 5).alias("fold"), label.alias("label"), guess.alias("prediction"), "o_totalprice", "o_orderkey")


@query(
    "classification_metrics",
    f"""WITH {_PRED_CLASS}, c AS (SELECT fold, label AS c, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hit FROM p GROUP BY 1, 2),
    s AS (SELECT fold, prediction AS c, count(*) AS said FROM p GROUP BY 1, 2),
    m AS (SELECT c.fold, support, hit, coalesce(hit * 1.0 / said, 0) AS pr, hit * 1.0 / support AS rc FROM c LEFT JOIN s USING (fold, c)),
    f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM m)
    SELECT fold, round(sum(hit) * 1.0 / sum(support), 6) AS accuracy, round(sum(support * pr) / sum(support), 6) AS precision, round(sum(support * rc) / sum(support), 6) AS recall,
           round(sum(support * f) / sum(support), 6) AS f1, round(avg(rc), 6) AS balanced_accuracy FROM f GROUP BY fold""",
)
def _(spark, sf):
    return rounded(metrics.classification_metrics(_class_predictions(spark, sf)))


@query(
    "roc_auc",
    """WITH p AS (SELECT o_orderkey % 5 AS fold, CAST(o_orderstatus = 'F' AS INT) AS label, floor(o_totalprice / 5000) + CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END AS s FROM orders),
    r AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS r FROM p)
    SELECT fold, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS roc_auc FROM r GROUP BY fold""",
)
def _(spark, sf):
    o = load(spark, sf, "orders")
    hit = F.col("o_orderstatus") == "F"
    p = o.select((F.col("o_orderkey") % 5).alias("fold"), hit.cast("double").alias("label"), (F.floor(F.col("o_totalprice") / 5000) + F.when(hit, 5).otherwise(0)).alias("score"))
    return rounded(metrics.roc_auc(p))


def _ovr_sql():
    per = " UNION ALL ".join(
        f"""SELECT fold, (sum(r) FILTER (WHERE label = {c}) - count(*) FILTER (WHERE label = {c}) * (count(*) FILTER (WHERE label = {c}) + 1) / 2.0)
        / (count(*) FILTER (WHERE label = {c}) * count(*) FILTER (WHERE label <> {c})) AS a, count(*) FILTER (WHERE label = {c}) AS w
        FROM (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY s{c}) + (count(*) OVER (PARTITION BY fold, s{c}) - 1) / 2.0 AS r FROM q) GROUP BY fold"""
        for c in range(3)
    )
    return f"""WITH {_PRED_CLASS}, q AS (SELECT fold, label, floor(o_totalprice / 9000) + CASE WHEN label = 0 THEN 7 ELSE 0 END AS s0, o_orderkey % 101 + CASE WHEN label = 1 THEN 9 ELSE 0 END AS s1, o_orderkey % 37 AS s2 FROM p)
    SELECT fold, round(sum(a * w) / sum(w), 6) AS roc_auc FROM ({per}) GROUP BY fold"""


@query("roc_auc_one_vs_rest", _ovr_sql())
def _(spark, sf):
    p = _class_predictions(spark, sf)
    bump = lambda c, by: F.when(F.col("label") == c, by).otherwise(0)
    scores = F.array(
        (F.floor(F.col("o_totalprice") / 9000) + bump(0, 7)).cast("double"), (F.col("o_orderkey") % 101 + bump(1, 9)).cast("double"), (F.col("o_orderkey") % 37).cast("double")
    )
    return rounded(metrics.roc_auc_one_vs_rest(p.withColumn("scores", scores), [0, 1, 2]))


_PRED_REG = "p AS (SELECT o_orderkey % 5 AS fold, o_totalprice AS label, o_totalprice * 0.9 + (o_orderkey % 11) * 1000 AS prediction FROM orders)"


def _reg_predictions(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select((k % 5).alias("fold"), F.col("o_totalprice").alias("label"), (F.col("o_totalprice") * 0.9 + (k % 11) * 1000).alias("prediction"))


_REG_SQL = """SELECT fold, avg(abs(label - prediction)) AS mae, sqrt(avg(pow(label - prediction, 2))) AS rmse,
    1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)) AS r2, avg(abs((label - prediction) / label)) AS mape FROM p GROUP BY fold"""


@query("regression_metrics", f"WITH {_PRED_REG}, m AS ({_REG_SQL}) SELECT fold, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2, round(mape, 4) AS mape FROM m")
def _(spark, sf):
    return rounded(metrics.regression_metrics(_reg_predictions(spark, sf)), 4)


@query(
    "metrics_across_folds",
    f"""WITH {_PRED_REG}, m AS ({_REG_SQL}), l AS (SELECT 'mae' AS metric, mae AS v FROM m UNION ALL SELECT 'rmse', rmse FROM m UNION ALL SELECT 'r2', r2 FROM m UNION ALL SELECT 'mape', mape FROM m)
    SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM l GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.across_folds(metrics.regression_metrics(_reg_predictions(spark, sf))), 4)


@query("confusion_matrix", f"WITH {_PRED_CLASS} SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, sf):
    return charts.confusion_matrix(_class_predictions(spark, sf))


@query("stratified_folds", "SELECT label, count(*) AS n, CAST(max(n) - min(n) <= 1 AS BOOLEAN) AS even FROM (SELECT o_orderstatus AS label, 1 AS n FROM orders) GROUP BY 1")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    folded = learners.with_folds(o, "classification", ["o_orderkey"], 5)
    sizes = folded.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("label").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 1).alias("even"))


@query(
    "nearest_neighbors",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id, b.label, list_distance(a.v, b.v) AS d, b.vec_id AS o FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS rk FROM d),
    c AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rk <= 5 GROUP BY 1, 2),
    p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM c)
    SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM p WHERE k = 1""",
)
def _(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("double").alias("label"))
    near = learners.nearest_labels(e, e.select("key", "vector"), 5, exclude_same_key=True)
    return learners.vote(near, "classification").select(F.col("key").alias("vec_id"), "prediction")


FEATURES = ["n_chars", "lang", "source"]
PRICE = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query("train_models_classification")
def _(spark, sf):
    r = learners.train_models(_docs(spark, sf), FEATURES, "quality", ["doc_id"], "classification", ["baseline", "svm", "knn"])
    return r.where("metric not in ('training_time', 'inference_time')").select("model", "metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("train_models_multiclass")
def _(spark, sf):
    c = load(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)], "label")
    r = learners.train_models(c, [f"e{i}" for i in range(64)], "label", ["vec_id"], "classification", ["baseline", "random_forest"], params={"iterations": 20, "trees": 20})
    return r.where("metric not in ('training_time', 'inference_time')").select("model", "metric", F.round("mean", 4).alias("mean"))


@query("train_models_regression")
def _(spark, sf):
    p = load(spark, sf, "part")
    r = learners.train_models(p, ["p_partkey", "p_size", "p_type"], "p_retailprice", ["p_partkey"], "regression", ["baseline", "random_forest", "boosting"], 2, LIGHT)
    return r.where("metric not in ('training_time', 'inference_time')").select("model", "metric", F.round("mean", 3).alias("mean"))


@query("run_modeling")
def _(spark, sf):
    out = learners.run_modeling(_docs(spark, sf), [*FEATURES, "doc_id"], "quality", ["doc_id"], ["baseline"], params={"iterations": 20})
    best = out["best"].select(F.lit("best").alias("part"), F.col("model").alias("name"), F.round("score", 4).alias("value"))
    leaks = out["leakage"].select(F.lit("leakage").alias("part"), F.col("column").alias("name"), F.round("score", 4).alias("value"))
    return best.unionByName(leaks)


def _price_model(spark, sf):
    return learners.fit_best(load(spark, sf, "lineitem"), PRICE, "l_extendedprice", ROW_KEY, "regression", "baseline")


@query("model_coefficients")
def _(spark, sf):
    fitted, rows = _price_model(spark, sf)
    out = explain.coefficients(fitted, rows, *split_columns(rows, PRICE))
    return out.withColumn("coefficient", F.round("coefficient", 3))


@query("permutation_importance")
def _(spark, sf):
    fitted, rows = _price_model(spark, sf)
    keys = [c for c in rows.columns if c.startswith("__key")]
    return rounded(explain.permutation_importance(fitted, rows, PRICE, keys, "regression"), 4)


@query("linear_attributions")
def _(spark, sf):
    fitted, rows = _price_model(spark, sf)
    names = explain.feature_names(fitted, rows, *split_columns(rows, PRICE))
    keys = [c for c in rows.columns if c.startswith("__key")]
    return rounded(explain.global_attributions(explain.linear_attributions(fitted, rows, names, keys)), 3)


@query("grid_search")
def _(spark, sf):
    return rounded(tuning.grid_search(_docs(spark, sf), FEATURES, "quality", ["doc_id"], "classification", "baseline", {"regParam": [0.01, 1.0]}, folds=2, params={"iterations": 20}), 4)


@query("grid_search_neighbors")
def _(spark, sf):
    return rounded(tuning.search(_docs(spark, sf), FEATURES, "quality", ["doc_id"], "classification", "knn"), 4)


@query("random_search")
def _(spark, sf):
    grid = {"maxDepth": [2, 3, 4], "numTrees": [5, 10]}
    p = load(spark, sf, "part")
    return rounded(tuning.random_search(p, ["p_partkey", "p_size"], "p_retailprice", ["p_partkey"], "regression", "random_forest", grid, 3, folds=2), 4)


# result tables both engines can derive
_RESULTS = """r AS (SELECT o_orderpriority AS model, 'r2' AS metric, avg(o_totalprice) / 1e6 AS mean FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'rmse', stddev_pop(o_totalprice) FROM orders GROUP BY 1)"""


def _results(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("a"), F.stddev_pop("o_totalprice").alias("s"))
    return g.select("model", F.inline(F.array(F.struct(F.lit("r2").alias("metric"), (F.col("a") / 1e6).alias("mean")), F.struct(F.lit("rmse").alias("metric"), F.col("s").alias("mean")))))


@query(
    "compare_models",
    f"""WITH {_RESULTS} SELECT model, round(mean, 4) AS value, round(mean / max(mean) OVER (), 6) AS share, row_number() OVER (ORDER BY mean, model) AS rank FROM r WHERE metric = 'rmse'""",
)
def _(spark, sf):
    out = metrics.compare_models(_results(spark, sf), "rmse")
    return rounded(out.withColumn("value", F.round("value", 4)))


@query("best_model", f"WITH {_RESULTS} SELECT model, 'r2' AS metric, round(mean, 6) AS score FROM r WHERE metric = 'r2' ORDER BY mean DESC LIMIT 1")
def _(spark, sf):
    return rounded(metrics.best_model(_results(spark, sf), "regression"))


@query(
    "top_candidates",
    "SELECT rank() OVER (ORDER BY m DESC) AS rank, p AS params, round(m, 6) AS mean, round(s, 6) AS std FROM (SELECT p_brand AS p, avg(p_size) AS m, stddev_pop(p_size) AS s FROM part GROUP BY 1) ORDER BY 1, 2 LIMIT 5",
)
def _(spark, sf):
    c = load(spark, sf, "part").groupBy(F.col("p_brand").alias("params")).agg(F.avg("p_size").alias("mean"), F.stddev_pop("p_size").alias("std"))
    return rounded(metrics.top_candidates(c))


@query(
    "tuned_against_baseline",
    """WITH t AS (SELECT p_type AS model, max(p_retailprice) AS score FROM part GROUP BY 1), b AS (SELECT p_type AS model, avg(p_retailprice) AS score FROM part WHERE p_size > 3 GROUP BY 1)
    SELECT model, t.score AS tuned, round(b.score, 6) AS baseline, round(t.score - b.score, 6) AS gain FROM t LEFT JOIN b USING (model)""",
)
def _(spark, sf):
    p = load(spark, sf, "part")
    t = p.groupBy(F.col("p_type").alias("model")).agg(F.max("p_retailprice").alias("score"))
    b = p.where("p_size > 3").groupBy(F.col("p_type").alias("model")).agg(F.avg("p_retailprice").alias("score"))
    return rounded(metrics.tuned_against_baseline(t, b))


def _bucket_sql(column, is_text, importance, tested=True):
    """Bucket of one column by the stated rules, computed from the data."""
    leaks = "false" if is_text or not tested else f"(stddev_pop({column}) > 0 AND abs(corr({column}, l_extendedprice)) > 0.98)"
    return f"""SELECT '{column}' AS "column", CASE WHEN {leaks} THEN 'leakage' WHEN count(DISTINCT {column}) <= 1 THEN 'harmful'
        WHEN {is_text} AND count(DISTINCT {column}) > 0.5 * count(*) THEN 'harmful' WHEN {importance} >= 0.01 THEN 'high_signal'
        WHEN {importance} < -0.005 THEN 'harmful' ELSE 'low_signal' END AS bucket FROM x"""


_BUCKETS = {"l_quantity": (False, 0.4), "l_discount": (False, 0.001), "copy": (False, 0.0), "cut": (True, 0.0), "l_returnflag": (True, -0.02), "fixed": (False, 0.0)}


@query("feature_buckets", f"WITH {_LEAKY_SQL}, x AS (SELECT *, 1 AS fixed FROM k) " + " UNION ALL ".join(_bucket_sql(c, t, w) for c, (t, w) in _BUCKETS.items()))
def _(spark, sf):
    df = leaky(spark, sf).withColumn("fixed", F.lit(1))
    cols = [*LEAKY, "fixed"]
    weights = spark.createDataFrame([("l_quantity", 0.4), ("l_discount", 0.001), ("l_returnflag", -0.02)], "column string, importance double")
    return target.feature_buckets(df, cols, target.correlation_flags(df, LEAKY, "l_extendedprice"), weights).select("column", "bucket")


_HARM = " UNION ALL ".join(_bucket_sql(c, False, 0.0, c == "copy") for c in ("copy", "fixed", "l_quantity"))


@query(
    "harmful_features",
    f"""WITH {_LEAKY_SQL}, x AS (SELECT *, 1 AS fixed FROM k), b AS ({_HARM}),
    r AS (SELECT "column" AS feature, CASE bucket WHEN 'leakage' THEN 'leaks' ELSE 'constant' END AS reason, 1 AS o FROM b WHERE bucket IN ('leakage', 'harmful')
          UNION ALL SELECT unnest(['fixed', 'l_tax']), 'warned', 2)
    SELECT feature, arg_min(reason, o) AS reason FROM r GROUP BY 1""",
)
def _(spark, sf):
    df = leaky(spark, sf).withColumn("fixed", F.lit(1))
    leak = target.correlation_flags(df, ["copy"], "l_extendedprice").withColumn("reason", F.lit("leaks"))
    none = df.limit(0).select(F.lit("").alias("column"), F.lit(0.0).alias("importance"))
    buckets = target.feature_buckets(df, ["copy", "fixed", "l_quantity"], leak, none)
    warned = spark.createDataFrame([("fixed", "warned"), ("l_tax", "warned")], "feature string, reason string")
    return target.harmful_features(buckets, warned)

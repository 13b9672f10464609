"""Edge cases on small hand-made tables, brute-force checks and plan checks."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsight.operators import anomaly, charts, cluster, constraints, dependency, explain, hypothesis, ingest, learners, profile as prof, sqlquery, target, timeseries, trust
from tabsight.operators.prep import split_columns
from tabsight.plans import rules
from tabsight.session import load
from tabsight.sources import files, versions

EMPLOYEE = "employee_id string, name string, age string, department string, rating string, salary string"


def employees(spark, change=lambda i, r: r, n=10):
    rows = []
    for i in range(n):
        row = [f"E{i:03d}", f"Name {i}", str(25 + i), ("Engineering", "Sales", "HR")[i % 3], str(3 + (i % 4) / 2), str(50000 + 3000 * i)]
        rows.append(tuple(change(i, row)))
    return spark.createDataFrame(rows, EMPLOYEE)


def kinds(df):
    return {r["name"]: r["type"] for r in prof.profile(df).select("name", "type").collect()}


# -- profile and trust -------------------------------------------------------


def test_types_of_text_columns(spark):
    def dated(i, r):
        r[4] = f"2024-01-{i % 28 + 1:02d}"
        r[3] = "yes" if i % 2 else "No"
        return r

    got = kinds(employees(spark, dated, 40))
    assert got == {"employee_id": "id", "name": "id", "age": "numeric", "department": "boolean", "rating": "datetime", "salary": "numeric"}


def test_text_placeholders_and_blanks(spark):
    df = employees(spark, lambda i, r: [*r[:5], "NA" if i == 3 else ("  " if i in (1, 4) else r[5])])
    row = prof.profile(df).where("name = 'salary'").first()
    assert (row["missing"], row["missing_pct"], row["type"], row["unique"]) == (2, 20.0, "numeric", 8)
    assert row["min"] == 50000.0 and row["max"] == 77000.0


def test_empty_and_constant(spark):
    empty = employees(spark, n=0)
    assert {r["type"] for r in prof.profile(empty).collect()} <= {"text"}
    same = spark.createDataFrame([(1.0, None)] * 20, "c double, d string")
    rows = {r["name"]: r for r in prof.profile(same).collect()}
    assert rows["c"]["constant"] and not rows["d"]["constant"] and rows["c"]["std"] == 0.0 and rows["c"]["skew"] == 0.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    row = prof.profile(df).first()
    assert (row["missing"], row["mean"], row["median"]) == (2, 2.0, 2.0)


def test_trust_of_clean_and_repeated_tables(spark):
    clean = ingest.ingest(employees(spark))
    assert trust.trust_score(clean).first()["score"] > 90
    repeated = ingest.ingest(employees(spark, lambda i, r: ["E1", "N", "30", "HR", "4", "10"], 20))
    row = trust.trust_score(repeated).first()
    assert row["uniqueness"] == pytest.approx(0.05) and row["structure"] == 0.0
    breakdown = trust.trust_breakdown(clean).collect()
    assert [r["label"] for r in breakdown] == ["Completeness", "Uniqueness", "Structure", "Consistency", "Stability"]


def test_trust_name_rules():
    assert trust.name_rule("page_id") == (0.0, 120.0)
    assert trust.name_rule("page_id", word_match=True) is None
    assert trust.name_rule("tax_rate") == (0.0, 100.0)
    assert trust.name_rule("Unit Price") == (0.0, None)


def test_long_text_is_grouped_by_digest(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "a",), (long + "b",)], "t string")
    top = prof.top_values(df).orderBy("rk").collect()
    assert [(r["value"], r["n"]) for r in top] == [(long + "a", 2), (long + "b", 1)]
    assert prof.duplicate_rows(df).first()["duplicates"] == 1


def test_clean_export_has_no_gaps(spark, tmp_path):
    df = employees(spark, lambda i, r: [*r[:4], None if i % 3 == 0 else r[4], r[5]])
    files.export_clean(ingest.ingest(df), str(tmp_path / "out"), "name, employee_id")
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["age", "department", "rating", "salary"]
    assert back.where("rating is null or trim(rating) = ''").count() == 0


def test_mode_and_missing_fill(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, t string")
    assert ingest.fill_values(df) == {"s": "a", "t": "MISSING"}


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_separator(spark, tmp_path, sep):
    path = tmp_path / "t.txt"
    path.write_text(sep.join(["a", "b", "c"]) + "\n\n" + "\n".join(sep.join([str(i), "x y", "z"]) for i in range(5)) + "\n")
    df = files.read_delimited(spark, str(path))
    assert df.columns == ["a", "b", "c"] and df.count() == 5 and all(t == "string" for _, t in df.dtypes)


def test_column_arrays(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"a": [1, 2, 3],\n "b": ["x", null, "z"]}')
    assert sorted((r["a"], r["b"]) for r in files.read_column_arrays(spark, str(path)).collect()) == [(1, "x"), (2, None), (3, "z")]


# -- dependency, charts, tests -------------------------------------------------


def test_pearson_of_constant_is_zero(spark):
    df = spark.createDataFrame([(float(i), 2.0, float(i * i)) for i in range(10)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["pearson"] for r in dependency.pearson(df).collect()}
    assert got[("a", "b")] == 0.0 and got[("a", "c")] == pytest.approx(np.corrcoef(range(10), [i * i for i in range(10)])[0, 1])
    assert {(r["col_a"], r["col_b"]): r["spearman"] for r in dependency.spearman(df).collect()}[("a", "c")] == pytest.approx(1.0)


def test_histogram_counts_every_row(spark, sf):
    h = charts.histogram(load(spark, sf, "orders"), "o_totalprice").collect()
    assert sum(r["n"] for r in h) == load(spark, sf, "orders").count() and sum(r["peak"] for r in h) == 1
    one = charts.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in one] == [(2.5, 3.5, 4)]


def test_line_keeps_about_two_thousand_points(spark, sf):
    n = load(spark, sf, "lineitem").count()
    pts = charts.line(load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice").collect()
    assert len(pts) == math.ceil(n / (n // 2000)) and len({p["position"] for p in pts}) == len(pts)


def test_pie_refuses_many_values(spark, sf):
    with pytest.raises(ValueError):
        charts.pie(load(spark, sf, "orders"), "o_orderkey")


@pytest.mark.parametrize("kind, args", [("nope", ("p_size",)), ("bar", ("p_brand",)), ("gauge", ("p_brand",)), ("bar", ("p_brand", "nowhere"))])
def test_chart_refusals(spark, sf, kind, args):
    with pytest.raises(ValueError):
        charts.chart(load(spark, sf, "part"), kind, *args)


def test_every_insight_is_one_sentence(spark, sf):
    p = load(spark, sf, "part")
    made = [("scatter", "p_size", "p_retailprice"), ("histogram", "p_size", None), ("boxplot", "p_size", None), ("kde", "p_size", None), ("bar", "p_type", "p_size"),
            ("heatmap", "p_type", "p_brand"), ("grouped_bar", "p_type", "p_brand"), ("line", "p_partkey", "p_size"), ("pie", "p_type", None), ("treemap", "p_type", "p_size"),
            ("funnel", "p_type", None), ("waterfall", "p_type", "p_size"), ("gauge", "p_size", None)]
    for kind, a, b in made:
        rows = charts.insight(charts.chart(p, kind, a, b), kind).collect()
        assert len(rows) == 1 and rows[0]["insight"], kind


def test_chart_filter_reaches_the_scan(spark, sf):
    df = charts.chart(load(spark, sf, "lineitem"), "bar", "l_returnflag", "l_tax", [{"column": "l_quantity", "type": "numeric", "value": [1, 5]}])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan.replace("l_quantity), ", "l_quantity), ") and "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_t_and_z_tests(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    t = hypothesis.t_test(df, "x", "g").first()
    assert t["statistic"] == pytest.approx(-1.8973665961) and t["dof"] == pytest.approx(5.882352941) and t["p_value"] == pytest.approx(0.10753, abs=1e-4)
    assert hypothesis.z_test(df, "x", "g").first()["p_value"] == pytest.approx(0.0577795711, abs=1e-6)
    f = hypothesis.anova(df, "x", "g").first()
    assert f["statistic"] == pytest.approx(3.6) and f["highest"] == "b" and f["p_value"] == pytest.approx(0.0943497728, abs=1e-6)
    with pytest.raises(ValueError):
        hypothesis.t_test(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, x double"), "x", "g")
    flat = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, x double")
    assert hypothesis.t_test(flat, "x", "g").first()["p_value"] == 1.0


def test_chi_square_with_and_without_correction(spark):
    def table(cells):
        return spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")

    two = hypothesis.chi_square(table([("x", "p", 10), ("x", "q", 20), ("y", "p", 30), ("y", "q", 5)]), "a", "b").first()
    assert two["statistic"] == pytest.approx((30 * 35 * 40 * 25) ** -1 * 65 * (abs(10 * 5 - 20 * 30) - 32.5) ** 2) and two["dof"] == 1
    gap = hypothesis.chi_square(table([("x", "p", 10), ("y", "q", 20), ("z", "q", 5), ("z", "p", 5)]), "a", "b").first()
    expected = 0.0
    counts = {("x", "p"): 10, ("x", "q"): 0, ("y", "p"): 0, ("y", "q"): 20, ("z", "p"): 5, ("z", "q"): 5}
    for (a, b), o in counts.items():
        e = sum(v for k, v in counts.items() if k[0] == a) * sum(v for k, v in counts.items() if k[1] == b) / 40
        expected += (o - e) ** 2 / e
    assert gap["statistic"] == pytest.approx(expected) and gap["dof"] == 2


def test_confidence_interval(spark):
    c = hypothesis.confidence_interval(spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double"), "x", 0.95).first()
    assert (c["lower"], c["upper"]) == (pytest.approx(3.3341494, abs=1e-6), pytest.approx(7.6658506, abs=1e-6))


# -- time series -----------------------------------------------------------------


def weekly(spark, n=35):
    rows = [(f"2026-01-{i:02d}", 50 + 2 * i + 4 * (i % 7)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "date string, value int")


def test_series_with_invalid_dates(spark):
    rows = timeseries.regular_series(weekly(spark), "date", "value").collect()
    assert len(rows) == 31 and {r["unit"] for r in rows} == {"micro"}
    d = timeseries.decompose(weekly(spark), "date", "value").collect()
    for r in d:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["observed"])
    assert max(abs(r["residual"]) for r in d) < 1e-6  # a straight line plus a weekly pattern


def test_rolling_does_not_depend_on_chunks(spark, monkeypatch):
    rows = timeseries.regular_series(weekly(spark), "date", "value")
    whole = sorted((r["idx"], r["rolling_mean"], r["rolling_std"]) for r in timeseries.rolling_stats(rows).collect())
    monkeypatch.setattr(timeseries, "CHUNK", 4)
    cut = sorted((r["idx"], r["rolling_mean"], r["rolling_std"]) for r in timeseries.rolling_stats(rows).collect())
    assert cut == whole and len(cut) == 31


def test_short_series_and_forecasts(spark):
    two = spark.createDataFrame([("2026-01-01", 10.0), ("2026-01-04", 16.0)], "date string, value double")
    filled = sorted((r["idx"], r["value"]) for r in timeseries.regular_series(two, "date", "value").collect())
    assert filled == [(0, 10.0), (1, 12.0), (2, 14.0), (3, 16.0)]
    three = spark.createDataFrame([("2026-01-01", 10.0), ("2026-01-02", 12.0), ("2026-01-03", 20.0)], "date string, value double")
    f = timeseries.forecast_ar(three, "date", "value", 2).orderBy("step_ahead").collect()
    assert [(r["forecast"], r["lower"], r["upper"]) for r in f] == [(20.0, 18.0, 22.0)] * 2
    line = timeseries.forecast_seasonal(weekly(spark, 28), "date", "value", 7).orderBy("step_ahead").collect()
    assert [str(r["ts"])[:10] for r in line][0] == "2026-01-29" and all(r["lower"] <= r["forecast"] <= r["upper"] for r in line)
    months = spark.createDataFrame([(f"2025-{m:02d}-01", float(m)) for m in range(1, 13)], "date string, value double")
    ahead = timeseries.forecast_ar(months, "date", "value", 2).orderBy("step_ahead").collect()
    assert [str(r["ts"])[:10] for r in ahead] == ["2026-01-01", "2026-02-01"]


# -- anomalies and clusters ---------------------------------------------------------


def test_planted_outlier_ranks_first(spark):
    rows = [(i, float(i % 50), float((i * 7) % 50), "ab"[i % 2]) for i in range(600)] + [(600, 5000.0, -4000.0, "z")]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string")
    found = anomaly.detect_anomalies(df, ["x", "y", "c"], ["id"], 0.02).collect()
    assert found[0]["id"] == 600 and 0 < found[-1]["score"] <= found[0]["score"] < 1
    assert {d["column"] for d in found[0]["drivers"]} == {"x", "y", "c"}
    again = anomaly.isolation_scores(df.repartition(5), ["x", "y", "c"], ["id"])
    first = anomaly.isolation_scores(df, ["x", "y", "c"], ["id"])
    assert {r["id"]: r["score"] for r in again.collect()} == {r["id"]: r["score"] for r in first.collect()}


def brute_dbscan(points, eps, least):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= least
    label = -np.ones(len(points), int)
    c = 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] >= 0:
                    continue
                label[j] = c
                if core[j]:
                    stack += [k for k in np.flatnonzero(near[j]) if label[k] < 0]
            c += 1
    return near, core, label


@pytest.mark.parametrize("dims, eps, least, seed", [(2, 0.3, 5, 1), (2, 0.15, 4, 2), (3, 0.6, 6, 3), (2, 1.0, 30, 4), (1, 0.05, 4, 5)])
def test_dbscan_equals_brute_force(spark, dims, eps, least, seed):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-3, 3, (4, dims))
    points = np.concatenate([c + rng.normal(0, 0.35, (60, dims)) for c in centres] + [rng.uniform(-4, 4, (40, dims)), np.repeat(centres[:1], 80, axis=0)])
    near, core, label = brute_dbscan(points, eps, least)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id int, v array<double>")
    got = cluster.dbscan(df.withColumn("features", array_to_vector("v")), "features", "id", eps, least)
    mine = np.array([r["cluster"] for r in got.orderBy("id").collect()])
    assert len(mine) == len(points)
    assert ((mine == -1) == (label == -1)).all()
    pairs = {(a, b) for a, b in zip(label[core], mine[core])}
    assert len(pairs) == len(set(label[core])) == len(set(mine[core]))
    for i in np.flatnonzero(~core & (mine >= 0)):
        assert mine[i] == min(mine[j] for j in np.flatnonzero(near[i] & core))


def test_kmeans_and_characterisation(spark):
    rows = [(i, float(i % 2 * 100 + i % 5), float(i % 2 * 50), "hot" if i % 2 else "cold") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, kind string")
    labelled = cluster.kmeans(cluster.prepare(df, ["a", "b"]), 2, restarts=2)
    assert cluster.silhouette(labelled) > 0.9
    told = cluster.characterize(labelled, ["a", "b", "kind"]).collect()
    assert len(told) == 6 and {r["size"] for r in told} == {30} and {r["rank"] for r in told} == {1, 2, 3}
    ks = cluster.best_k(cluster.prepare(df, ["a", "b"]), highest=4, restarts=1).collect()
    assert [r["k"] for r in ks if r["best"]] == [2]
    flat, shares = cluster.project(labelled)
    assert {"x", "y"} <= set(flat.columns)
    with pytest.raises(ValueError):
        cluster.prepare(df.limit(5), ["a", "b"])


# -- models ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def flats(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x, y = float(rng.normal()), float(rng.normal())
        kind = "ab"[i % 2]
        rows.append((i, x, None if i % 17 == 0 else y, kind, 3 * x + (2 if kind == "a" else 0) + 0.1 * float(rng.normal()), int(x + 0.3 * y > 0)))
    return spark.createDataFrame(rows, "id int, x double, y double, kind string, price double, sold int")


@pytest.mark.parametrize("model", ["baseline", "boosting", "random_forest", "svm", "knn"])
def test_classifiers(flats, model):
    light = {"iterations": 4, "trees": 5, "depth": 3}
    got = learners.train_models(flats, ["x", "y", "kind"], "sold", ["id"], "classification", [model], 2, light)
    rows = {r["metric"]: r["mean"] for r in got.collect()}
    assert {r["model"] for r in got.collect()} == {model}
    assert rows["roc_auc"] > 0.85 and rows["accuracy"] > 0.8 and {"precision", "recall", "f1", "balanced_accuracy"} <= set(rows)


@pytest.mark.parametrize("model", ["baseline", "boosting", "random_forest", "knn"])
def test_regressors(flats, model):
    light = {"iterations": 8, "trees": 30, "depth": 6}
    got = learners.train_models(flats, ["x", "kind"], "price", ["id"], "regression", [model], 2, light)
    rows = {r["metric"]: r["mean"] for r in got.collect()}
    assert rows["r2"] > 0.8 and {"mae", "rmse", "mape"} <= set(rows)


def test_unfit_model_is_skipped_with_warning(flats):
    with pytest.warns(UserWarning, match="svm skipped"):
        got = learners.train_models(flats, ["x"], "price", ["id"], "regression", ["svm", "baseline"], 2)
    assert {r["model"] for r in got.collect()} == {"baseline"}


def test_folds_are_even_disjoint_and_stable(flats):
    rows, _ = learners.base_table(flats, ["x"], "sold", "classification", ["id"])
    folded = learners.with_folds(rows, "classification", ["__key0"], 5)
    assert folded.count() == 240
    sizes = folded.groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        n = [r["count"] for r in sizes if r["label"] == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
    again = learners.with_folds(rows.repartition(7), "classification", ["__key0"], 5)
    assert {(r["__key0"], r["fold"]) for r in folded.collect()} == {(r["__key0"], r["fold"]) for r in again.collect()}


def test_linear_attributions_add_up(flats):
    fitted, rows = learners.fit_best(flats, ["x", "kind"], "price", ["id"], "regression", "baseline")
    names = explain.feature_names(fitted, rows, *split_columns(rows, ["x", "kind"]))
    local = explain.linear_attributions(fitted, rows, names, ["__key0"])
    total = local.groupBy("__key0").agg(F.sum("phi").alias("s"), F.first("base").alias("b"), F.first("margin").alias("m"))
    predicted = fitted.transform(rows).select("__key0", "prediction")
    worst = total.join(predicted, "__key0").select(F.max(F.abs(F.col("s") + F.col("b") - F.col("m"))), F.max(F.abs(F.col("m") - F.col("prediction")))).first()
    assert max(worst) < 1e-9
    imp = {r["column"]: r["importance"] for r in explain.permutation_importance(fitted, rows, ["x", "kind"], ["__key0"], "regression", 2).collect()}
    assert imp["x"] > imp["kind"] > 0.01


def test_leakage_scan_finds_planted_columns(spark):
    rows = [(i, float(i), float(i) * 2 + (i % 3) * 0.01, f"b{i // 60}", float((i * 31) % 17), f"u{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y double, twin double, cut string, noise double, tag string")
    got = {r["column"]: r["kind"] for r in target.leakage_scan(df, ["twin", "cut", "noise", "tag"], "y", "regression", ["k"]).collect()}
    assert got["twin"] == "single_feature" and got["tag"] == "id_like" and "noise" not in got


def test_boosted_single_feature_scores(flats):
    light = {"iterations": 5, "depth": 3}
    got = {r["column"]: r["score"] for r in learners.boosted_feature_scores(flats, ["x", "y"], "sold", "classification", ["id"], 2, light).collect()}
    assert got["x"] > 0.9 > got["y"]


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(str(i), [float(v) for v in p], float(i % 3)) for i, p in enumerate(pts)], "key string, vector array<double>, label double")
    whole = learners.nearest_labels(df, df.select("key", "vector"), 5, exclude_same_key=True).orderBy("key").collect()
    monkeypatch.setattr(learners, "BLOCK_ROWS", 25)
    cut = learners.nearest_labels(df, df.select("key", "vector"), 5, exclude_same_key=True).orderBy("key").collect()
    assert [[n["key"] for n in r["near"]] for r in whole] == [[n["key"] for n in r["near"]] for r in cut]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) + np.eye(120) * 1e9
    for r in whole:
        assert {int(n["key"]) for n in r["near"]} == set(np.argsort(d[int(r["key"])])[:5])


# -- SQL, joins, constraints, versions ------------------------------------------------


@pytest.mark.parametrize("text", ["", "  ", "DROP TABLE t", "select 1; delete from t", "SHOW TABLES", "with x as (select 1) insert into t select * from x"])
def test_sql_refused(spark, text):
    with pytest.raises(sqlquery.QueryRefused):
        sqlquery.read_only_sql(spark, {}, text)


@pytest.mark.parametrize(
    "text",
    [
        "select reflect('java.lang.System', 'getProperty', 'user.home')",
        "select * from t where java_method('java.util.UUID', 'randomUUID') <> ''",
        "select * from parquet.`/tmp`",
        "with x as (select 1 as a) select * from x join other using (a)",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT count(*) FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/labels.parquet`')",
        "select `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "select system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
        r"select r'\', reflect('java.lang.System', 'getProperty', 'user.home'), ''",
        r"select 'a\'', reflect('java.lang.System', 'getProperty', 'user.home')",
        "select '--', reflect/* x */('java.lang.System', 'getProperty', 'user.home')",
        "select /* /* */ ' */ reflect('java.lang.System', 'getProperty', 'user.home') /* ' */",
        "select 1 as `'`, reflect('java.lang.System', 'getProperty', 'user.home') as `b'`",
        "select --\r reflect('java.lang.System', 'getProperty', 'user.home')",
        "select --\\\n ' \n reflect('java.lang.System', 'getProperty', 'user.home') -- '",
        "select * from `global_temp`.other",
    ],
)
def test_sql_that_leaves_the_tables_is_refused(spark, text):
    with pytest.raises(sqlquery.QueryRefused):
        sqlquery.read_only_sql(spark, {"t": spark.range(3)}, text)


def test_sql_does_not_read_files_of_other_tables(spark, sf):
    tables = {"nation": load(spark, sf, "nation")}
    assert sqlquery.read_only_sql(spark, tables, "select count(*) from nation").first()[0] == 25
    spark.sql(f"create table elsewhere using parquet location '{sf}/region.parquet'")
    try:
        with pytest.raises(sqlquery.QueryRefused):
            sqlquery.read_only_sql(spark, tables, "select * from default.elsewhere")
    finally:
        spark.sql("drop table elsewhere")
    assert [t.name for t in spark.catalog.listTables()] == [] or "nation" not in {t.name for t in spark.catalog.listTables()}


def test_sql_with_names_of_its_own(spark):
    text = "with x as (select id from t), y as (select max(id) as m from x) select id, 'reflect (x)' as s from T join y on id = m"
    assert [tuple(r) for r in sqlquery.read_only_sql(spark, {"t": spark.range(3)}, text).collect()] == [(2, "reflect (x)")]


def test_delimited_text_is_split(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    with open(path, "w") as f:
        f.write("a;b\n" + "".join(f"{i};{'x' * 200}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        df = files.read_delimited(spark, path)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000
        assert files.read_delimited(spark, path, line_breaks=True).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_versions_survive_read_errors_and_unfinished_attempts(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "v"), spark.range(3)
    assert versions.append_version(df, root) == 1
    (tmp_path / "v" / "version=2").mkdir()
    assert versions.append_version(spark.range(4), root) == 3
    real = versions._manifest_path(root)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest").mkdir()
    (tmp_path / "broken" / "manifest" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        versions.append_version(df, str(tmp_path / "broken"))
    assert versions.read_version(spark, root, 1).count() == 3 and real


def test_upsert_and_update_with_nulls_and_ties(spark):
    table = spark.createDataFrame([(1, "x", None), (2, "old", 5)], "id long, v string, at long")
    new = spark.createDataFrame([(2, "new", 5), (3, "a", None), (3, "b", None), (1, "y", None)], "id long, v string, at long")
    got = {r.id: (r.v, r["at"]) for r in versions.upsert_latest(table, new, ["id"], "at").collect()}
    assert got == {1: ("y", None), 2: ("new", 5), 3: ("b", None)}
    changes = spark.createDataFrame([(1, "p", 1), (1, None, 3), (1, "q", 2), (9, "z", 1)], "id long, v string, t long")
    out = versions.update_rows(table, changes, "id", at="t").collect()
    assert sorted((r.id, r.v) for r in out) == [(1, "q"), (2, "old")]


def test_sql_presentation_caps_rows(spark, sf):
    rows, cut, ms = sqlquery.present_sql(spark, {"dataset": load(spark, sf, "orders")}, "select * from dataset order by o_orderkey", 100)
    assert len(rows) == 100 and cut and ms > 0 and isinstance(rows[0]["o_orderdate"], str)
    rows, cut, _ = sqlquery.present_sql(spark, {"dataset": load(spark, sf, "orders")}, "SELECT avg(o_totalprice) a, 0.0 / 1 b FROM dataset")
    assert len(rows) == 1 and not cut


def test_asof_slices_do_not_change_the_result(spark, sf):
    e = load(spark, sf, "events")
    left = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    runs = [{(r["event_id"], r["click"]) for r in sqlquery.asof_join(left, right, ["user_id"], "ts", "at", s).collect()} for s in (3600, 86400, 10**9)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == left.count()


def test_range_join_is_an_equi_join(spark, sf):
    o = load(spark, sf, "orders")
    bands = spark.createDataFrame([(1, 0.0, 900.0), (2, 100000.0, 250000.0), (3, 5.0, 5.0)], "b int, lo double, hi double")
    joined = sqlquery.range_join(o, "o_totalprice", bands, "lo", "hi", 50000.0)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == o.where("o_totalprice < 900").count() + o.where("o_totalprice >= 100000 and o_totalprice < 250000").count()


def test_functional_dependency_threshold(spark):
    rows = [(i % 50, i % 50 // 10, i) for i in range(500)] + [(7, 4, 999)]
    df = spark.createDataFrame(rows, "zip int, city int, key int")
    got = {(r["determinant"], r["dependent"]): r["violations"] for r in constraints.functional_dependencies(df).collect()}
    assert got == {("zip", "city"): 1}
    assert constraints.dependency_violations(df, "zip", "city").count() == 11


def test_versions_round_trip(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert versions.list_versions(spark, root).count() == 0
    assert versions.append_version(a, root, "first") == 1
    assert versions.append_version(a.where("k = 1"), root) == 2
    assert versions.read_version(spark, root).count() == 1
    assert versions.restore_version(spark, root, 1) == 3
    assert sorted(versions.read_version(spark, root).collect()) == sorted(a.collect())
    assert [r["note"] for r in versions.list_versions(spark, root).collect()] == ["Restored from version 1", "", "first"]
    with pytest.raises(ValueError):
        versions.restore_version(spark, root, 9)


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    results = spark.createDataFrame([("a", "r2", 0.5), ("a", "rmse", 3.0), ("b", "r2", 0.7), ("b", "rmse", 4.0)], "model string, metric string, mean double")
    versions.record_runs(results, path, {"folds": 5})
    versions.record_runs(results.withColumn("mean", F.col("mean") / 2), path)
    runs = spark.read.parquet(path)
    assert runs.count() == 4 and versions.list_runs(runs, 1).count() == 1 and versions.list_runs(runs, model="a").count() == 2
    assert {r["model"]: r["value"] for r in versions.best_runs(runs, "rmse").collect()} == {"a": 1.5, "b": 2.0}
    best = versions.compare_runs(runs).where("best").collect()
    assert {(r["metric"], r["value"]) for r in best} == {("r2", 0.7), ("rmse", 1.5)}


def test_rules_on_clean_table_say_little(spark, sf):
    p, s = prof.profile(load(spark, sf, "nation")), prof.dataset_shape(load(spark, sf, "nation"))
    assert rules.risk_level(s, rules.risks(p, s), rules.human_errors(p, 2026), rules.contradictions(p)).first()["level"] in ("low", "medium")
    assert rules.cleaning_suggestions(p).count() == 0

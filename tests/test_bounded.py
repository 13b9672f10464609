"""Charts, terms and range joins stay bounded where values spread out or tie."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tabsight.functions import ranks
from tabsight.operators import charts, explain, learners, sqlquery, target, text


def test_histogram_of_a_far_value(spark):
    df = spark.range(100_000).select((F.col("id") / 100_000).alias("x")).union(spark.createDataFrame([(1e12,)], "x double"))
    rows = charts.histogram(df, "x").orderBy("bin").collect()
    assert len(rows) < 100 and sum(r["n"] for r in rows) == 100_001
    assert [r["n"] for r in rows if r["hi"] >= 1e12 * 0.999] == [0, 1] or rows[-1]["n"] == 1
    for a, b in zip(rows, rows[1:]):
        assert a["hi"] == pytest.approx(b["lo"], rel=1e-9)


def test_empty_stretches_across_slices(spark):
    held = [0, 1, 5, 24_999, 25_000, 60_000, 99_999]
    counts = spark.createDataFrame([(b, 2) for b in held], "bin long, n long").repartition(3)
    got = sorted(tuple(r) for r in charts._with_empty_stretches(counts, 100_000).collect())
    want = []
    for b, after in zip(held, [*held[1:], 100_000]):
        want.append((b, b + 1, 2))
        if after > b + 1:
            want.append((b + 1, after, 0))
    assert got == want


def test_grouped_bar_of_many_values_is_long(spark):
    df = spark.range(1000).selectExpr("CAST(id % 3 AS string) AS a", "CAST(id AS string) AS b")
    got = charts.grouped_bar(df, "a", "b")
    assert got.columns == ["name", "value", "n"] and got.count() == 1000
    assert len(charts.grouped_bar(df.where("b < '105'"), "a", "b").columns) < charts.WIDE


def test_terms_with_many_ties(spark, monkeypatch):
    rows = [(k, " ".join(f"w{''.join(chr(97 + int(c)) for c in str(k * 40 + j))}" for j in range(40)) + " alpha beta gamma") for k in range(50)]
    df = spark.createDataFrame(rows, "k long, t string")
    listed = sorted(tuple(r) for r in text.top_terms(df, "t", "k").collect())
    monkeypatch.setattr(text, "MOST_AMONG", 5)
    assert sorted(tuple(r) for r in text.top_terms(df, "t", "k").collect()) == listed and ("alpha beta" in {t for t, _ in listed})


def test_dyadic_cover(spark):
    spans = [(0, 0), (3, 12), (-7, 5), (0, 1023), (1, 1022), (-(2**40), 2**40 + 17), (5, 4)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", sqlquery.dyadic_cover(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        parts = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["c"])
        assert len(parts) <= 2 * 42
        if r["b"] < r["a"]:
            assert not parts
        else:
            assert parts[0][0] == r["a"] and parts[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_range_join_equals_all_pairs(spark):
    points = spark.createDataFrame([(i, i % 3, (i * 37 % 201 - 100) / 4) for i in range(200)], "p long, k long, at double")
    ranges = spark.createDataFrame([(j, j % 3, lo, hi) for j, (lo, hi) in enumerate([(-30.0, 30.0), (0.0, 0.25), (-1e15, 1e15), (3.0, 3.0), (5.0, 2.0), (-0.1, 7.3), (24.9, 25.1)])], "r long, k long, lo double, hi double")
    want = sorted((p.p, r.r) for p in points.collect() for r in ranges.collect() if p.k == r.k and r.lo <= p["at"] < r.hi)
    for width in (0.01, 1.0, 1000.0):
        assert sorted((x.p, x.r) for x in sqlquery.range_join(points, "at", ranges, "lo", "hi", width, ["k"]).collect()) == want


def test_range_totals_equal_all_pairs_without_pairs(spark):
    points = spark.createDataFrame([(float(i * 37 % 201 - 100) / 4, i % 7 if i % 5 else None) for i in range(200)] + [(None, 3), (0.0, 4), (-0.0, 5)], "at double, v long")
    spans = [(-30.0, 30.0), (0.0, 0.25), (-0.0, 0.25), (-1e15, 1e15), (3.0, 3.0), (5.0, 2.0), (-0.1, 7.3), (24.9, 25.1), (None, 3.0), (90.0, 95.0), (-25.0, -24.75)]
    ranges = spark.createDataFrame([(j // 2, lo, hi) for j, (lo, hi) in enumerate(spans * 2)], "r long, lo double, hi double")
    pairs = [(r.r, p.v) for p in points.collect() for r in ranges.collect() if None not in (p["at"], r.lo) and r.lo <= p["at"] < r.hi]
    known = lambda k: [v for r, v in pairs if r == k and v is not None]
    want = sorted((k, sum(r == k for r, _ in pairs), sum(known(k)) if known(k) else None) for k in {r for r, _ in pairs})
    assert sorted(tuple(x) for x in sqlquery.range_totals(points, "at", "v", ranges, "lo", "hi", ["r"]).collect()) == want
    # 200,000 points in each of 50,000 whole ranges: ten thousand million pairs that are never made
    wide = spark.range(50_000).select(F.col("id").alias("r"), F.lit(-1.0).alias("lo"), F.lit(1e9).alias("hi"))
    many = spark.range(200_000).select(F.col("id").cast("double").alias("at"), F.col("id").alias("v"))
    found = sqlquery.range_totals(many, "at", "v", wide, "lo", "hi", ["r"]).groupBy("n", "total").count().collect()
    assert [tuple(x) for x in found] == [(200_000, sum(range(200_000)), 50_000)]


def test_clustering_rounds_use_all_cores(spark):
    from tabsight.operators import kmeans

    one = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("features")).coalesce(1)
    rows = kmeans.vectors(one)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == 1000


def test_many_brackets_are_counted_without_generated_comparisons(spark, monkeypatch):
    """Twenty quantiles of a continuous, a coarse and an empty column, with nulls, equal a plain reading."""
    rng = np.random.default_rng(8)
    rows = [(float(rng.normal()) if i % 9 else None, float(rng.integers(0, 4)), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    probs = [b / 20 for b in range(1, 20)]
    called = []
    real = ranks._bracket_counts
    monkeypatch.setattr(ranks, "_bracket_counts", lambda *a: called.append(1) or real(*a))
    got = {r["column"]: r["q"] for r in ranks.column_quantiles(df, ["x", "y", "z"], probs).collect()}
    assert set(got) == {"x", "y"} and called
    for k, name in enumerate("xy"):
        assert np.allclose(got[name], np.quantile([r[k] for r in rows if r[k] is not None], probs), atol=1e-12)


def test_target_sums_equal_a_plain_reading(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        y = float("inf") if i % 50 == 1 else None if i % 40 == 2 else float(rng.normal(100, 5))
        rows.append((i // 2, y, None if i % 7 == 0 else float(rng.integers(0, 30)), float("nan") if i % 11 == 0 else float(rng.normal()), None if i % 5 == 0 else " " if i % 13 == 0 else f"c{i % 3}"))
    df = spark.createDataFrame(rows, "k int, y double, a double, b double, c string").repartition(4)
    known = df.where("y is not null")
    cells = [F.struct(F.lit(n).alias("column"), v.alias("bin")) for n, v in zip("abc", target.binned_cells(known, ["a", "b", "c"], 6))]
    y = F.when(F.col("y") < 1e300, F.col("y"))
    centre = known.agg(F.avg(y)).first()[0]
    plain = known.select(target.fold_of(["k"], 5).alias("fold"), (y - centre).alias("y"), F.inline(F.array(*cells))).groupBy("column", "bin", "fold")
    plain = plain.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    want = {(r["column"], r["bin"], r["fold"]): (r["n"], r["s"], r["ss"]) for r in plain.collect()}
    got = {(r["column"], r["bin"], r["fold"]): (r["n"], r["s"], r["ss"]) for r in target._target_sums(known, ["a", "b", "c"], "y", ["k"], 5, 6).collect()}
    assert set(got) == set(want) and len({b for c, b, _ in got if c != "c"}) > 6
    for k, (n, s, ss) in want.items():
        assert got[k][0] == n and got[k][1:] == (pytest.approx(s, abs=1e-9), pytest.approx(ss, abs=1e-9)) if s is not None else got[k] == (n, None, None)


def test_id_like_numbers_are_told_apart_as_numbers(spark):
    rows = [(2**60 + i, float(i), -0.0 if i % 2 else 0.0, f"t{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, zero double, t string")
    flags = {r["column"]: r["reason"] for r in target.id_like_flags(df, ["id", "x", "zero", "t"]).collect()}
    assert flags == {"id": "40 distinct values in 40 rows", "x": "40 distinct values in 40 rows"}
    plan = target.id_like_flags(df, ["id", "x"])._jdf.queryExecution().executedPlan().toString()
    assert "cast(id" not in plan and "cast(x" not in plan


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_permutation_importance_keeps_only_sums(spark, monkeypatch, task):
    """Any number of passes gives what blocks exchanged one by one give, and no rows are written to the checkpoint folder."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), None if i % 9 == 0 else float(rng.normal()), "ab"[i % 2]) for i in range(300)]
    rows = [(*r, 3 * r[1] + (2 if r[3] == "a" else 0) if task == "regression" else float(r[1] > 0)) for r in rows]
    df = spark.createDataFrame(rows, "id int, x double, z double, kind string, goal double").repartition(3)
    names = ["x", "z", "kind"]
    fitted, seen = learners.fit_best(df, names, "goal", ["id"], task, "baseline")
    monkeypatch.setattr(explain, "BLOCK", 40)
    hashed = seen.select("*", *[F.xxhash64("__key0", F.lit(f"{c}:0")).alias(f"h_{c}") for c in names], F.pmod(F.xxhash64("__key0", F.lit(0)), F.lit(7)).alias("b")).collect()
    plain, base = {}, explain._quality(fitted.transform(seen), task)
    for c in names:
        moved = []
        for b in range(7):
            block = sorted((r for r in hashed if r["b"] == b), key=lambda r: r[f"h_{c}"])
            moved += [tuple(block[(i + 1) % len(block)][c] if k == c else r[k] for k in seen.columns) for i, r in enumerate(block)]
        plain[c] = base - explain._quality(fitted.transform(spark.createDataFrame(moved, seen.schema)), task)
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    for size in (1000, 70):
        monkeypatch.setattr(explain, "PASS_ROWS", size, raising=False)
        got = {r["column"]: r["importance"] for r in explain.permutation_importance(fitted, seen, names, ["__key0"], task, 1).collect()}
        assert got == {c: pytest.approx(v, abs=1e-9) for c, v in plain.items()} and plain["x"] > 0.1

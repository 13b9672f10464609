"""Work laid out in slices, digests and bins equals the plain computation where values repeat, tie or are missing."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import ranks
from tabsight.operators import charts, dependency, knnmi, profile, timelines
from tabsight.sources import sketches


@pytest.mark.parametrize("shape", ["hot", "spread", "constant"])
def test_row_ranks_equal_average_ranks(spark, shape):
    n = 6000
    made = {"hot": lambda i: 5.0 if i % 3 else i * 7919 % 997, "spread": lambda i: i * 7919 % 6007 / 3, "constant": lambda i: -0.0 if i % 2 else 0.0}[shape]
    cells = [(g, i, float(made(i + g))) for g in range(2) for i in range(n)]
    got = {(r["g"], r["id"]): r["rank"] for r in ranks.row_ranks(spark.createDataFrame(cells, "g int, id long, v double").repartition(5)).collect()}
    want = pd.DataFrame(cells, columns=["g", "id", "v"])
    want["rank"] = want.groupby("g")["v"].rank()
    assert got == {(a, b): r for a, b, r in zip(want["g"], want["id"], want["rank"])}


def test_row_ranks_of_nothing(spark):
    assert ranks.row_ranks(spark.createDataFrame([], "g int, id long, v double")).count() == 0


def test_spearman_with_half_a_column_missing_and_a_frequent_value(spark):
    rows = [(i, float(i * 37 % 101) if i % 2 else None, 7.0 if i % 3 else float(i % 17), float(i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    frame = pd.DataFrame(rows, columns=["id", "a", "b", "c"])
    for r in dependency.spearman(df, ["a", "b", "c"]).collect():
        pair = frame[[r["col_a"], r["col_b"]]].dropna().rank()
        assert r["spearman"] == pytest.approx(np.corrcoef(pair.T)[0, 1], abs=1e-9)


def test_duplicate_rows_with_nulls_swapped_cells_and_nested_values(spark):
    long = "x" * 500
    rows = [
        (1, None, "a", 0.0, [1], bytearray(b"p")), (1, None, "a", -0.0, [1], bytearray(b"p")), (1, "a", None, 0.0, [1], bytearray(b"p")),
        (None, "a", None, 0.0, [1], bytearray(b"p")), (2, long, "b", float("nan"), None, None), (2, long, "b", float("nan"), None, None),
        (2, long + "y", "b", float("nan"), None, None), (2, long, "b", float("nan"), [], None), (None,) * 6, (None,) * 6, (None,) * 6,
    ]
    df = spark.createDataFrame(rows, "i int, s string, t string, d double, l array<int>, `b.c` binary")
    assert tuple(profile.duplicate_rows(df).first()) == (11, 4)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_duplicate_rows_with_many_repeated_digests(spark, monkeypatch):
    monkeypatch.setattr(profile, "FEW_DIGESTS", 3)
    df = spark.range(900).selectExpr("CAST(id % 300 AS string) AS a", "id % 100 AS b")
    assert tuple(profile.duplicate_rows(df).first()) == (900, 600)


@pytest.mark.parametrize("shape", ["even", "far", "constant", "two"])
def test_kde_equals_the_sum_over_all_values(spark, shape):
    values = {"even": [i * 7919 % 1000 / 7 for i in range(3000)], "far": [i / 100 for i in range(500)] + [1e6], "constant": [4.0] * 20, "two": [1.0, 9.0]}[shape]
    got = charts.kde(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").orderBy("i").collect()
    x = np.array(values)
    h = 1.06 * (x.std() or 1.0) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 100)
    want = np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["i"] for r in got] == list(range(100))
    assert np.allclose([r["x"] for r in got], grid) and np.allclose([r["density"] for r in got], want, rtol=1e-9, atol=1e-11 / h)


def test_kde_needs_two_values(spark):
    assert charts.kde(spark.createDataFrame([(1.0,), (None,)], "x double"), "x").count() == 0


def _moment(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_sessions_in_slices_equal_the_plain_split(spark):
    rows = [(None if u == 3 else f"u{u}", _moment(i * 977 % 90_000 + (0 if u else i)), float(i % 5) if i % 4 else None) for i in range(4000) for u in [0 if i % 3 == 0 else i % 9]]
    rows += [("late", None, 1.0), ("alone", _moment(5), None), ("u0", _moment(17), 2.0), ("u0", _moment(17), 2.0)]
    df = spark.createDataFrame(rows, "user string, at timestamp_ntz, v double").repartition(7)
    for gap in (60, 600):
        want = []
        for user in {r[0] for r in rows}:
            mine = sorted(((t, v) for w, t, v in rows if w == user and t is not None), key=lambda e: e[0])
            for k, (t, v) in enumerate(mine):
                if k == 0 or (t - mine[k - 1][0]).total_seconds() >= gap:
                    want.append([user, t, None, 0, None])
                want[-1][2], want[-1][3] = t + (_moment(gap) - _moment(0)), want[-1][3] + 1
                want[-1][4] = want[-1][4] if v is None else (want[-1][4] or 0.0) + v
        got = timelines.sessions(df, "user", "at", "v", gap).collect()
        assert sorted(map(repr, (list(r) for r in got))) == sorted(map(repr, want))
    assert timelines.sessions(df.limit(0), "user", "at", "v").count() == 0


def test_asof_in_slices_with_ties_nulls_and_clashing_names(spark):
    left = [(i, None if i % 50 == 0 else (0 if i % 3 else i % 11), None if i % 71 == 1 else _moment(i * 613 % 5000)) for i in range(1500)]
    right = [(None if i % 40 == 0 else (0 if i % 2 else i % 11), _moment(i * 389 % 5000 // 7 * 7), i) for i in range(700)]
    got = timelines.asof_join(
        spark.createDataFrame(left, "__id long, k long, t timestamp_ntz").repartition(5), spark.createDataFrame(right, "k long, seen timestamp_ntz, v long"), ["k"], "t", "seen"
    ).collect()
    want = []
    for i, k, t in left:
        best = max(((s, v) for kk, s, v in right if k is not None and kk == k and t is not None and s <= t), default=(None, None))
        want.append((i, k, t, *best))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_stored_sketches_merge_and_a_repeated_part_replaces(spark, tmp_path):
    root = str(tmp_path / "sketches")
    df = spark.range(30_000).selectExpr("id", "CAST(id * 7919 % 10007 AS double) AS v", "CASE WHEN id % 5 > 0 THEN CAST(id % 300 AS string) || 'x' END AS s", "CAST(NULL AS double) AS none", "id % 3 AS part")
    cols = ["v", "s", "none"]
    sketches.append(sketches.sketch(df.where("part < 2"), cols, F.col("part")), root)
    sketches.append(sketches.sketch(df.where("part > 0"), cols, F.col("part")), root)  # part 1 again
    got = {r["column"]: r for r in sketches.merged(sketches.stored(spark, root)).collect()}
    assert {c: (got[c]["rows"], got[c]["missing"]) for c in cols} == {"v": (30_000, 0), "s": (30_000, 6_000), "none": (30_000, 30_000)}
    assert abs(got["v"]["unique"] - 10_007) <= 4 * sketches.DISTINCT_ERROR * 10_007 and abs(got["s"]["unique"] - 240) <= 10 and got["none"]["unique"] == 0
    assert got["s"]["q"] is None and (got["v"]["min"], got["v"]["max"]) == (0.0, 10_006.0)
    for p, q in zip((0.25, 0.5, 0.75), got["v"]["q"]):
        assert abs(q / 10_007 - p) <= 2 * sketches.RANK_ERROR
    some = sketches.merged(sketches.stored(spark, root, ["0"])).where("column = 'v'").first()
    assert some["rows"] == 10_000
    assert sketches.merged(sketches.sketch(df.limit(0), cols)).count() == 0


def _brute_information(x, y, k=3):
    def psi(n):
        return sum(1 / j for j in range(1, n)) - 0.5772156649015329

    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    e = np.maximum(np.sort(d, axis=1)[:, k - 1] - 1, 0)
    nx, ny = (dx <= e[:, None]).sum(axis=1), (dy <= e[:, None]).sum(axis=1)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)]))


@pytest.mark.parametrize("shape", ["curve", "ties", "crowd", "constant", "few"])
def test_neighbor_information_equals_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    a = rng.normal(size=400)
    rows = {
        "curve": np.c_[a, a**2 + 0.1 * rng.normal(size=400), rng.normal(size=400)],
        "ties": np.c_[rng.integers(0, 4, 400), rng.integers(0, 30, 400), np.where(rng.random(400) < 0.4, 7.0, a)],
        "crowd": np.r_[np.c_[a, a, a] * 1e-4, [[50.0, 60.0, -9.0], [50.0, 61.0, 3.0], [-70.0, 2.0, 1e9]]],
        "constant": np.c_[a, np.ones(400), np.round(a, 1)],
        "few": np.c_[a[:3], a[3:6], a[6:9]],
    }[shape]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double").repartition(3)
    grid = knnmi.grid_points(df, ["a", "b", "c"]).toPandas().to_numpy()
    got = {(r["i"], r["j"]): r["mi"] for r in knnmi.neighbor_information(df).collect()}
    assert len(got) == 3
    for (i, j), mi in got.items():
        want = 0.0 if shape == "few" else _brute_information(grid[:, i], grid[:, j])
        assert mi == pytest.approx(want, abs=1e-9)
    if shape == "curve":
        assert got[0, 1] > 0.8 and got[0, 2] < 0.2


def test_neighbour_candidates_are_not_sent_to_the_driver(spark):
    points = spark.range(300).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 997).alias("y"), F.lit(1).cast("long").alias("w"))
    plan = knnmi.kth_distances(points, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_cells_of_a_rank_slice_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_CELLS", 100)
    cells = spark.range(6000).select((F.col("id") % 2).cast("int").alias("g"), "id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1500).cast("double").alias("v"))
    sizes = ranks._cell_slices(cells).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 300
    want = cells.toPandas()
    want["rank"] = want.groupby("g")["v"].rank()
    got = ranks.row_ranks(cells).toPandas()
    assert sorted(zip(got["g"], got["id"], got["rank"])) == sorted(zip(want["g"], want["id"], want["rank"]))

import random

import pytest
from pyspark.sql import functions as F

from tabsight.llm import negatives

SCHEMA = "id long, vector array<double>, label int, anchor boolean, row string, q string, g string, b string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def mined(df, **more):
    part = df.select("id", "label", "anchor", negatives.whole_components(F.col("vector")).alias("q"))
    return sorted(tuple(r) for r in negatives.mine(part, **more).collect())


def brute(rows, k=5, least=80):
    import math

    ok = [(n, i, [math.floor(256 * x) for x in v], y, a) for n, (i, v, y, a) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = lambda some: sorted(some, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
    out = []
    for n, i, v, y, a in ok:
        if not a:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, z) for m, j, w, z, _ in ok if m != n]
        for score, j, _ in best([s for s in scored if s[2] == y]):
            fits = [s for s in scored if s[2] != y and least * score <= 100 * s[0] <= 100 * score]
            out += [(i, j, r, o, score, s) for r, (s, o, _) in enumerate(best(fits), 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,values", [(1, None), (2, (0.0, 0.25, 0.5)), (3, (-1.0, 1.0))])
def test_equals_scoring_all_rows(spark, monkeypatch, seed, values):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "START", 2)
    rng = random.Random(seed)
    draw = lambda: rng.choice(values) if values else rng.gauss(0.2, 1)
    rows = [(i, [draw() for _ in range(8)], 1 if rng.random() < 0.4 else rng.randrange(5), i % 6 == 0) for i in range(260)]
    rows += rows[:12]  # repeated rows
    expected = brute(rows)
    assert expected and mined(rows_of(spark, rows)) == expected


def test_sides_meet_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(4)], rng.randrange(3), i % 6 == 0) for i in range(150)]
    many = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        expected = brute(rows)
        assert expected and mined(rows_of(spark, rows)) == expected
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1, True), (0, [1.0, 0.5], 1, True), (1, [0.9, 0.5], 1, False), (2, [0.9, 0.5], 2, None), (3, [0.95, 0.5], 2, False),
        (4, [0.95, 0.5, 0.1], 3, True), (5, [], 3, True), (6, None, 1, True), (7, [1.0, None], 1, True), (8, [1.0, inf], 2, False), (9, [nan, 0.0], 2, False),
        (10, [1.0, 0.5], None, True), (None, [0.95, 0.5], 2, False), (12, [0.0, 0.0], 4, True), (13, [0.0, 0.0], 4, False), (14, [-1.0, 0.0], 5, True), (15, [1.0, 0.0], 5, False),
    ]
    expected = brute([(i, v, y, a) for i, v, y, a in rows])
    got = mined(rows_of(spark, rows))
    none_last = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=none_last) == sorted(expected, key=none_last)
    assert {r[0] for r in got} >= {0, 12}  # a zero vector finds zero scores


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**19 - i)], i % 2, i % 4 == 0) for i in range(40)]
    assert mined(rows_of(spark, rows)) == brute(rows)
    huge = [(i, [1e300, -1e300], i % 2, True) for i in range(6)]
    assert mined(rows_of(spark, huge))  # cut to 64 bits


def test_reading_stops_early():
    rng = random.Random(4)
    vectors = [[rng.randrange(-9, 10), rng.randrange(-9, 10)] for _ in range(4000)]
    lists = negatives.Lists(vectors, list(range(4000)), 2)
    touched = []
    lists.exact = lambda a, f=lists.exact: (touched.append(1), f(a))[1]
    import numpy as np

    best = negatives.best_of_windows(lists, [5, 3], np.ones(4000, bool), [(-float("inf"), float("inf"))], 5)[0]
    assert best == sorted(((5 * x + 3 * y, k) for k, (x, y) in enumerate(vectors)), key=lambda s: (-s[0], s[1]))[:5]


def test_empty_table(spark):
    assert mined(rows_of(spark, []).limit(0)) == []
    no_anchor = [(1, [1.0], 1, False), (2, [1.0], 1, False), (3, [1.0], 2, False)]
    assert mined(rows_of(spark, no_anchor)) == []

"""Helpers: ranks, quantiles, distributions, formulas, parsing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.functions import distributions as dist, ranks
from tabsight.functions.columns import parse_number, parse_timestamp
from tabsight.functions.formula import FormulaError, add_calculated_column
from tabsight.session import load


def skewed(spark):
    """One value fills a third of the rows; some are null."""
    rows = [(i % 3, 5.0 if i % 3 == 0 or i % 7 == 0 else float((i * 37) % 101) / 4, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    return df.withColumn("v", F.when(F.col("v") != 2.0, F.col("v")))


def test_quantiles_equal_numpy(spark):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    rows = df.collect()
    by_group = {r["g"]: r["q"] for r in ranks.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in (0, 1, 2):
        values = np.array([r["v"] for r in rows if r["v"] is not None and r["g"] == g])
        assert by_group[g] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    values = np.array([r["v"] for r in rows if r["v"] is not None])
    assert ranks.exact_quantiles(df, "v", probs).first()["q"] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    wide = {r["column"]: r["q"] for r in ranks.column_quantiles(df, ["g", "v", "w"], probs).collect()}
    assert set(wide) == {"g", "v"} and wide["v"] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    assert ranks.exact_quantiles(df, "w", probs).first()["q"] is None


def test_quantiles_when_the_sketch_misses(spark, monkeypatch):
    """A sketch too coarse for its bracket falls back to ranking everything."""
    df = skewed(spark).where("v is not null")
    values = np.array([r["v"] for r in df.collect()])
    for sketch in (10_000, 100, 20):
        monkeypatch.setattr(ranks, "SKETCH", sketch)
        got = ranks.exact_quantiles(df, "v", [0.05, 0.5, 0.9]).first()["q"]
        assert got == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.9])), abs=1e-12)
    monkeypatch.setattr(ranks, "SKETCH", 10_000)
    real = ranks._interpolated
    hole = F.array(F.lit(None).cast("double"))
    monkeypatch.setattr(ranks, "_interpolated", lambda placed, value, probs, by, *a: real(placed, value, probs, by, *a).withColumn("q", F.when(F.lit("total" not in placed.columns), hole).otherwise(F.col("q"))))
    assert ranks.exact_quantiles(df, "v", [0.5]).first()["q"] == pytest.approx([np.median(values)], abs=1e-12)


def test_average_ranks(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,), (3.0,), (None,)], "v double")
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, [], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    df = skewed(spark).repartition(parts)
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, [], "v").collect()}
    values = sorted(r["v"] for r in df.collect() if r["v"] is not None)
    for v, rank in got.items():
        first, n = values.index(v), values.count(v)
        assert rank == first + (n + 1) / 2


def test_distributions_known_values():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert dist.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert dist.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_upper(4.102821015303716, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, abs=1e-9)


def test_parse_number_and_dates(spark):
    df = spark.createDataFrame([("1,200",), (" 3.5 ",), ("1e3",), ("1d",), ("inf",), ("NA",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_number(F.col("s"))).collect()] == [1200.0, 3.5, 1000.0, None, None, None, None, None]
    df = spark.createDataFrame([("2026-01-05",), ("2026/1/5",), ("01/05/2026",), ("2026-01-32",), ("2026",), ("2026-01-05T10:20:30",)], "s string")
    got = [str(r[0]) if r[0] else None for r in df.select(parse_timestamp(F.col("s"))).collect()]
    day = "2026-01-05 00:00:00"
    assert got == [day, day, day, None, None, "2026-01-05 10:20:30"]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("a", 100000.0, 3), ("b", 150000.5, None), ("c", 50.25, -7)], "name string, salary double, `years worked` int")


def calc(df, text):
    return [r["new"] for r in add_calculated_column(df, "new", text).orderBy("name").collect()]


def test_formula_results(people):
    assert calc(people, "ROUND(salary * 0.1, 2)") == [10000.0, 15000.05, 5.03] or calc(people, "ROUND(salary * 0.1, 2)") == [10000.0, 15000.05, 5.02]
    assert calc(people, "IF(salary > 100000, True, False)") == [False, True, False]
    assert calc(people, "`years worked` // 2") == [1.0, None, -4.0]
    assert calc(people, "`years worked` % 4") == [3.0, None, 1.0]
    assert calc(people, "`years worked` != 3") == [False, True, True]
    assert calc(people, "`years worked` < 5 and not salary < 100") == [True, False, False]
    assert calc(people, "round(0.5) + round(1.5) + round(2.5)") == [4.0, 4.0, 4.0]
    assert calc(people, "COUNT(`years worked`) + SUM(salary) * 0") == [2.0, 2.0, 2.0]
    assert calc(people, "1 / 0") == [None, None, None]
    assert calc(people, "if(isnull(`years worked`), 0, 1)") == [1.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "bad",
    ["salary + (1).__class__", "missing * 2", "__import__('os')", "AVG(3)", "salary +", "[1, 2]", "salary & 1", "~salary", "AVG(SUM(salary))", "lambda: 1", "ROUND(salary, name)"],
)
def test_formula_refused(people, bad):
    with pytest.raises(FormulaError):
        add_calculated_column(people, "new", bad)


@pytest.mark.parametrize("name", ["", "  ", "salary"])
def test_formula_names(people, name):
    with pytest.raises(FormulaError):
        add_calculated_column(people, name, "salary * 2")


def test_no_cross_join_or_single_window_in_formula_plan(spark, sf):
    df = add_calculated_column(load(spark, sf, "lineitem"), "share", "l_quantity / SUM(l_quantity)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Window" not in plan
    assert math.isclose(df.agg(F.sum("share")).first()[0], 1.0, rel_tol=1e-9)

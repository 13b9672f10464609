"""Every registered query against its SQL, and the others for being runnable."""

import pytest

import __spark_entry__ as entry
from compare import SF, compare, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    if name == "leakage_scan":  # may rightly be empty
        QUERIES[name](spark, SF).collect()
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 11
    assert df.columns == entry.entry(spark).columns

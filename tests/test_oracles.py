import pytest
from compare import connect, oracle_rows, rows
from conftest import SMALL

from cadenza import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    cols, got = rows(catalogue.QUERIES[name](spark, SMALL))
    if name in catalogue.ORACLES:
        want_cols, want = oracle_rows(con, catalogue.ORACLES[name])
        assert cols == want_cols
        assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

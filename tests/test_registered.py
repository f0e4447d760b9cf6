"""Every registered query runs, and gives what its SQL gives."""

import pytest

from compare import compare, duck
from placesearch.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        ok, note = compare(con, df, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())

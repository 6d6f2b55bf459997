import pytest

from strataloom.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


#: Queries without SQL that find nothing in the smallest tables.
MAY_BE_EMPTY = {"behaviour_clones", "test_units", "dead_functions"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(map(str, rows))) == len(rows)  # nothing twice


def test_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and set(QUERIES) <= set(q)

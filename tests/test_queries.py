"""Every registered query of the engine gives the rows of its SQL."""

import pytest

from tests.oracle import DATA, connect, difference
from textquarry.plans import catalog_queries as q

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert difference(q.queries()[name](spark, SF), con, q.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

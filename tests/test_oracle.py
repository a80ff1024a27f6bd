"""Every query with SQL gives DuckDB's rows, and some rows."""

import pytest

from loamwork.plans import registry
from tests.oracle import connect, normal

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    ours, theirs = normal(QUERIES[name](spark, sf).toPandas()), normal(con.sql(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1], "an empty result proves nothing"
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

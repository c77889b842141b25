"""Every registered query with SQL must agree with it (small tables)."""

import pytest

from duelframe.plans import catalog

from oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert result.startswith("ok"), result
    assert "TYPES" not in result, result

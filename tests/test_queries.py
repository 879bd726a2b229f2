"""Every registered query against its SQL, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    with connect(FOLDER) as connection:
        yield connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    result = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(result, tables, SQL[name]) is None
    else:
        assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

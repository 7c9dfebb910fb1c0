"""Every registered query with a SQL form gives the same rows as the SQL."""

import oracle
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0

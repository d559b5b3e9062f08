"""Every core query against its SQL on the smallest data."""

import pytest

from corvane.plans import registry
from tests.compare import connect, rows_of_spark, rows_of_sql

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0

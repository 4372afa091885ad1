"""Every registered query against its SQL, on the smallest tables."""

import pytest

from lodestone import catalog
from tests.compare import database, difference, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLE:
        assert difference(got, sql_rows(con, ORACLE[name])) is None

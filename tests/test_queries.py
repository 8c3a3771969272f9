"""Every registered query gives what its SQL gives in DuckDB, on the smallest test tables."""

from pathlib import Path

import pytest

from checks.compare import database, difference, duckdb_rows, spark_rows
from checks.oracle import oracles
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.fixture(scope="module")
def sql():
    return oracles()


def test_every_query_has_its_sql(sql):
    assert set(sql) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sql, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    assert difference(got, duckdb_rows(duck, sql[name])) is None

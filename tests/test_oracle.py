"""Every query against its SQL, on whole tables."""

import pytest

from checks.catalog import QUERIES
from checks.compare import difference, oracle_connection
from checks.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) is None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql()) <= set(driver.queries())

"""The queries that SQL can express, against their SQL."""

import pytest

from checks.compare import difference, oracle_connection
from perioda.llm.oracles import ORACLE
from perioda.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), oracle_connection(FOLDER), ORACLE[name]) is None


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))

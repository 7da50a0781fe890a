"""Every query that SQL can express, against its SQL."""

import pytest
from compare import compare, oracle_connection

from quietmark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert ok, note

"""Tool calls, results, thinking, tokens and index rows of the sources, against their SQL."""

import pytest

from logweave.plans import source_queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(source_queries.QUERIES))
def test_queries_equal_sql(spark, name):
    query, sql = source_queries.QUERIES[name]
    same(spark, query, sql, "/root/testdata/sf0.001")

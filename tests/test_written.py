"""Lines and envelopes compared whole."""

import pytest

from logweave.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", ["s7_whole_lines", "s8_whole_envelopes", "s7_jsonl_lines", "s8_envelopes"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")

"""Rendering, outputs and short texts with values that reach each branch."""

import pytest

from logweave.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", ["p21_rendered_blocks", "p1_p10_p11_outputs", "p23_texts"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")

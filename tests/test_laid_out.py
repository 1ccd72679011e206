"""Tables laid out by session: what windows, sums and joins by session read without a shuffle."""

import pytest

from logweave.operators import slicing as S
from logweave.operators import stats as A
from logweave.plans import registry
from logweave.plans import views as V
from logweave.sources import writers
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_by_session(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = writers.lay_out(V.tool_messages(spark, SF), "laid_tools", str(tmp_path / "m"), 4)
        u = writers.lay_out(V.counters(spark, SF).selectExpr("source", "session_id", "line_no", "total.input as input", "total.output as output", "total.cached as cache_read", "total.cached as cache_creation"), "laid_usage", str(tmp_path / "u"), 4)
        assert len(list((tmp_path / "m").glob("*.parquet"))) <= 4
        for df in (S.slice_sessions(m, 400, "head"), A.tool_counts(m), A.tool_frequency(m), A.session_stats(m, u)):
            assert "Exchange" not in plan(df)
        plain = V.tool_messages(spark, SF)
        rows = lambda df: sorted(map(str, df.collect()))
        assert "Exchange" in plan(A.tool_counts(plain))
        assert rows(A.tool_counts(m)) == rows(A.tool_counts(plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists laid_tools")
        spark.sql("drop table if exists laid_usage")


@pytest.mark.parametrize("name", ["s6_w2_laid_out", "s6_a3_laid_out", "a3_j1_tool_counts", "a3_tool_frequency", "j2_as_of_errors", "j2_late_results", "e4_j2_goose_tools", "e4_mixed_sources", "e4_claude_session_stats", "a4_corpus_tools", "j6_diff", "t3_block_order"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)

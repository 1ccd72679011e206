"""The trigram index against a scan, for queries of any length."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import catalog as C
from logweave.operators import search_index as X
from logweave.operators.stats import match_counts
from logweave.plans import registry
from logweave.plans import views as V
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    m = V.conversation_messages(spark, SF)
    odd = m.limit(1)
    odd = odd.withColumns({"session_id": F.lit("odd"), "content": F.explode(F.array(*[F.lit(t).cast("string") for t in ("", "a", "Éa", "İ x", "needle in HAY", "日本語", None, "aaaa", "x" * 3000)]))})
    m = m.unionByName(odd.withColumn("idx", F.monotonically_increasing_id().cast("int") + 1))
    return m, X.build_index(m, str(tmp_path_factory.mktemp("index")) + "/i", block=8)


@pytest.mark.parametrize("query", ["", "a", "É", "éa", "the", "THE", "needle", "needle in hay", "日", "日本語", "aaa", "aaaaa", "no such words at all", "x" * 3000, "İ", "%", ". "])
def test_counts_equal_a_scan(indexed, query):
    messages, index = indexed
    assert rows(X.indexed_counts(index, query)) == rows(match_counts(messages, query))


def test_blocks_are_passed_over(indexed):
    messages, index = indexed
    told = X.skipped(index, "needle in hay").first()
    assert told["searched"] == 1 and told["skipped"] == told["blocks"] - 1 and told["blocks"] == -(-messages.count() // 8)
    assert X.skipped(index, "no such words at all").first()["searched"] == 0
    # beyond a bounded list of blocks they are joined
    kept, X.PUSHED = X.PUSHED, 0
    try:
        assert rows(X.indexed_counts(index, "the")) == rows(match_counts(messages, "the"))
    finally:
        X.PUSHED = kept


def test_blocks_reach_the_scan(indexed):
    _, index = indexed
    plan = X.candidates(index, "needle in hay")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "block" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_searches_through_the_index(spark, indexed):
    messages, index = indexed
    sessions = V.session_index(spark, SF)
    assert rows(C.search_sessions(sessions, index, "ing")) == rows(C.search_sessions(sessions, messages, "ing"))
    assert rows(C.list_sessions(sessions, index, "ing")) == rows(C.list_sessions(sessions, messages, "ing"))


def test_an_index_is_opened_again(spark, indexed, tmp_path):
    m = V.conversation_messages(spark, SF).where("idx < 3")
    X.build_index(m, f"{tmp_path}/i", block=4)
    again = X.open_index(spark, f"{tmp_path}/i")
    assert rows(X.indexed_counts(again, "the")) == rows(match_counts(m, "the"))
    empty = X.build_index(m.where("false"), f"{tmp_path}/e")
    assert rows(X.indexed_counts(empty, "the")) == rows(X.indexed_counts(empty, "")) == []


@pytest.mark.parametrize("name", ["f4_a11_indexed_counts", "t2_indexed_search"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_grams_of_odd_and_long_texts(spark):
    import time

    texts = ["", "a", "ab", "abc", "aaaa", "a\nb\r\nc", "é x\u0085y", "x😀y😀z", "😀😀😀😀", "é́ab", "a\x00bc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [list(dict.fromkeys(t[k : k + 3] for k in range(len(t) - 2))) if len(t) > 2 else [t] if t else [] for t in texts]
    assert [r["g"] for r in df.select(X.grams(F.col("t")).alias("g")).collect()] == want
    # work is in proportion to the text
    began = time.time()
    one = spark.range(1).select(F.repeat(F.lit("some text "), 60_000).alias("t"))
    assert one.select(F.size(X.grams(F.col("t"))).alias("n")).first()["n"] == 10
    assert time.time() - began < 20

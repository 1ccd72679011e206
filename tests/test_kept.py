"""Snapshots in versions, failing sources, tags in order, deep models, and diffs by source."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import scalars as P
from logweave.operators import catalog as C
from logweave.operators import compare as D
from logweave.operators import stats as A
from logweave.operators.snapshots import Snapshots
from logweave.plans import registry as Q
from logweave.plans import views as V
from logweave.sources import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i11_failing_source", "e8_j8_snapshots", "e8_j7_snapshots", "u3_insertion_order", "u3_j10_tags", "p14_deep_model", "p13_p17_line_scalars", "j6_diff", "i2_codex_messages"])
def test_queries_equal_sql(spark, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name], SF)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_stay_readable_and_share_buckets(spark, tmp_path):
    m = V.conversation_messages(spark, SF).cache()
    kept = Snapshots(spark, str(tmp_path / "s"), 16)
    assert kept.versions() == [] and rows(kept.at()) == []
    parts = [m.where("idx <= 2"), m.where("idx > 2 and session_id = '3'"), m.where("idx > 2 and session_id != '3'")]
    seen, want = None, {0: []}
    for n, part in enumerate(parts, 1):
        assert kept.advance(part) == n
        seen = part if seen is None else seen.unionByName(part)
        s = seen.groupBy("source", "session_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("total_messages"))
        want[n] = rows(D.etags(s, s))
    for n in (1, 2, 3):
        assert rows(kept.at(n).select("source", "session_id", "etag")) == want[n]
    for a, b in ((0, 1), (1, 2), (2, 3), (1, 3), (3, 3)):
        assert rows(kept.changed(a, b)) == sorted(set(want[b]) - set(want[a]), key=str)
    # the second version wrote one bucket
    assert len(list((tmp_path / "s" / "rows" / "version=2").glob("bucket=*"))) == 1
    # one that was interrupted before its manifest is not read, and its number is used again
    (tmp_path / "s" / "manifest" / "version=3" / "_SUCCESS").unlink()
    assert kept.versions() == [1, 2] and rows(kept.at().select("source", "session_id", "etag")) == want[2]
    assert kept.advance(parts[2]) == 3 and rows(kept.at().select("source", "session_id", "etag")) == want[3]


def test_a_failing_source_leaves_the_others(spark, tmp_path):
    line = lambda f: spark.createDataFrame([(f, 0, '{"role":"user","content":"hello"}')], "file_path string, line_no int, value string")
    got, failed = registry.store_all(spark, {"commandcode": {"lines": line("/p/a/1.jsonl")}, "copilot": {"lines": line("/s/1/events.jsonl").withColumn("value", F.raise_error(F.lit("unreadable")).cast("string"))}, "unknown": {}, "codex": {"wrong": 1}}, str(tmp_path))
    assert [r["source"] for r in got.messages.collect()] == ["commandcode"]
    told = {r["source"]: r["reason"] for r in failed.collect()}
    assert set(told) == {"copilot", "unknown", "codex"} and "unreadable" in told["copilot"]


def test_tags_in_order(spark):
    tags = lambda *x: spark.createDataFrame(list(x), "session_id string, tag string, seq long")
    first = C.apply_tags(tags(), tags(("a", "z", 1), ("a", "b", 2), ("a", "z", 3)))
    again = C.apply_tags(first, tags(("a", "b", 1), ("a", "a", 2)), tags(("a", "q", 0)))
    assert rows(again) == [("a", "a", 3), ("a", "b", 2), ("a", "z", 1)]
    gone = C.apply_tags(again, None, tags(("a", "z", 0)))
    assert rows(C.apply_tags(gone, tags(("a", "z", 9)))) == [("a", "a", 2), ("a", "b", 1), ("a", "z", 3)]


def test_models_at_any_depth(spark):
    deep = '{"metadata":' * 40 + '{"model_name":"x"}' + "}" * 40
    cases = {'{"model":" a "}': "a", '{"model":1,"info":{"model":"b"}}': "b", '{"info":{"metadata":{"model":"c"}},"metadata":{"model":"d"}}': "c", '{"info":[{"model":"e"}],"metadata":{"model":"f"}}': "f", deep: "x", "{}": None, '"info"': None, '{"info":{"info":null}}': None, "bad": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", P.model_of(F.try_parse_json("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == cases


def test_diffs_of_ids_that_sources_share(spark):
    m = V.tool_messages(spark, SF).where("session_id in ('1', '2')")
    stats = A.session_stats(m.unionByName(m.withColumn("source", F.lit("gemini"))))
    pairs = spark.createDataFrame([("1", "2", "claude", "gemini")], "a string, b string, a_source string, b_source string")
    assert [(r["a_source"], r["b_source"]) for r in D.diff_sessions(pairs, stats).collect()] == [("claude", "gemini")]
    assert D.diff_sessions(pairs.select("a", "b"), stats).count() == 4


def test_model_steps_look_at_a_value_once(spark):
    deep = lambda n, end: '{"info":{"x":[]},"metadata":' * n + end + "}" * n
    cases = [(deep(120, '{"model":"m"}'), "m"), (deep(120, '{"x":1}'), None), ('{"info":null,"metadata":{"info":[{"model":"a"}],"metadata":{"model":1,"model_name":" b "}}}', "b"), ('[{"model":"a"}]', None), ('"model"', None), ('{"model":{"model":"a"},"info":"info","metadata":{"model":"c"}}', "c")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(P.model_of(F.try_parse_json("t")).alias("m"))
    assert [r["m"] for r in df.collect()] == [m for _, m in cases]
    # no schema of a whole subtree is made in a step, only those of the two names
    assert df._jdf.queryExecution().analyzed().toString().count("schema_of_variant") == 2

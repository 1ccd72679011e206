"""Masked lines: any white space counts, and what is costly is done once a text or not at all."""

import re

from logweave.llm import line_dedup as L


def test_white_space_is_made_single(spark):
    texts = [f"a{c}b{d}é7 x{c}\n{d}y" for c in (" ", "  ", "\t", "\x0b", "\x0c", "\r", " \t") for d in (" ", "\x0c", "\r\r", "\xa0")] + ["", " ", "\t", "a\n\nb"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", L.template_lines("text").alias("lines")).collect()
    single = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    want = [[re.sub(r"[^ ]*[0-9][^ ]*", L.FIELD, single(x)) for x in t.split("\n")] for t in texts]
    assert [r["lines"] for r in sorted(got)] == want
    counts = spark.createDataFrame([("é ü x",), ("a",)], "line string").select(L.token_count("line").alias("n")).collect()
    assert [r["n"] for r in counts] == [3, 1]


def test_texts_are_hashed_once_and_spaces_sought_as_bytes(spark):
    docs = spark.createDataFrame([(1, "a b\nc 1")], "doc_id long, text string")
    plan = L.masked_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    above, generate = plan.split("Generate", 1)
    assert "xxhash64(text" not in above and "xxhash64(text" in generate
    assert plan.count("RLIKE") <= 1

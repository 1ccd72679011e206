from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.functions import presets
from logweave.functions import scalars as P


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("column, value, want", [
    (lambda: P.estimate_tokens("x"), "h😀a", 1), (lambda: P.estimate_tokens("x"), "", 0), (lambda: P.estimate_tokens("x"), "abcde", 2),
    (lambda: P.truncate("x", 5), "abcdef", "ab..."), (lambda: P.truncate("x", 2), "abc", "ab"), (lambda: P.truncate("x", None), "abc", "abc"),
    (lambda: P.truncate_single_line("x", 3), " a\n b  c", "a b…"), (lambda: P.clean_prompt("x"), "<system-reminder>a\nb</system-reminder> <b>hi</b>  you", "hi you"), (lambda: P.clean_prompt("x"), "<a>", None),
    (lambda: P.is_system_injected("x"), " \n<permissions x", True), (lambda: P.is_system_injected("x"), "plain", False), (lambda: P.is_bootstrap("x"), "# AGENTS.md", True),
    (lambda: P.user_request("x"), "a</user-rule> b <EnvironmentContext>c", "b"), (lambda: P.user_request("x"), "no rule", None), (lambda: P.clean_title("x"), "<t>x</t> Title ## Included Rules y", "Title"),
    (lambda: P.patch_files("x"), "*** Add File: a\n*** Update File: b\n*** Add File: a", ["a", "b"]), (lambda: P.tool_error("x"), "FAILED", True),
    (lambda: P.decode_base64("x"), "L3dvcms", "/work"), (lambda: P.decode_path("x"), "a-b", "a/b"), (lambda: P.file_id("x"), "/x/rollout-2026-01-15T10-00-00-abc.jsonl", "abc"), (lambda: P.file_id("x"), "/x/y.jsonl", "y"),
    (lambda: P.duration_text("x"), 5000, "5s"), (lambda: P.duration_text("x"), 182000, "3m 2s"), (lambda: P.duration_text("x"), 3840000, "1h 4m"),
    (lambda: P.bytes_text("x"), 512, "512 B"), (lambda: P.bytes_text("x"), 2048, "2.0 KB"), (lambda: P.bytes_text("x"), 3 << 20, "3.0 MB"), (lambda: P.shorten_home("x", "/home/u"), "/home/u/p", "~/p"),
    (lambda: P.trim("x"), "  a﻿", "a"),
    (lambda: P.attached_files("x"), '<attached_files><f path="a"/><f path="b"/></attached_files>', ["a", "b"]), (lambda: P.user_text("x"), "<user_query>q</user_query><image_files>z</image_files>", "q[image]"),
])
def test_text_scalars(spark, column, value, want):
    assert one(spark, column(), x=value) == want


@pytest.mark.parametrize("text, want", [('"plain"', "plain"), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]', "a\nb"), ("3", ""), ('"[1] x"', "[1] x")])
def test_tool_result_text(spark, text, want):
    assert one(spark, P.tool_result_text(F.try_parse_json("x")), x=text) == want


def test_etag_and_relative_time(spark):
    t = datetime(2026, 1, 15, 10, 0, 21)
    assert one(spark, P.etag("x", F.lit(15)), x=t) == "9f7c6f8b444bf4a7"
    now = F.lit(datetime(2026, 1, 15, 12, 0, 21))
    assert one(spark, P.relative_time("x", now), x=t) == "2h ago"


def test_durations_and_presets():
    assert presets.parse_duration("7d") == 7 * 86_400_000 and presets.parse_duration("10 s") == 10_000
    with pytest.raises(ValueError):
        presets.parse_duration("soon")
    with pytest.raises(ValueError):
        presets.preset("loud")
    assert presets.for_read(detail="skeleton").name == "minimal" and presets.read_budget(24000) == 8000


def test_render(spark):
    from logweave.operators import explode as X

    p = presets.PRESETS["standard"]
    use = X.block("tool_use", name=F.lit("Read"), input_json=F.lit('{"file_path":"a","n":1}'))
    assert one(spark, P.render_block(use, p)) == "Read { file_path: a, n: 1 }"
    bad = X.block("tool_result", content=F.lit("x"), is_error=F.lit(True))
    assert one(spark, P.render_block(bad, p)) == "[ERROR] x" and one(spark, P.render_block(bad, presets.PRESETS["minimal"])) == "[result hidden]"
    assert one(spark, P.message_tokens(F.array(use).cast("array<" + X.BLOCK + ">"))) == 4 + 1 + 6

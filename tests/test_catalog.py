"""Index rows of the sources, snapshot rules, sinks."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from logweave.operators import catalog as C
from logweave.sources import claude, codex, documents, events, registry, writers
from tests.test_ingest import docs, lines

T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def facts(spark, *paths, mtime=T1):
    return spark.createDataFrame([(p, 1, 1, mtime) for p in paths], "file_path string, raw_line_count long, file_bytes long, mtime timestamp")


def row(df):
    r = df.first()
    return r["id"], r["source"], r["cwd"], r["summary"]


def test_snapshots_and_archives(spark):
    rows = [("e", "kiro", "/k/2.chat", 3), ("e", "kiro", "/k/1.chat", 5), ("e", "kiro", "/k/3.chat", 5), (None, "kiro", "/k/4.chat", 1)]
    got = C.keep_snapshots(spark.createDataFrame(rows, "execution_id string, source string, file_path string, message_count int"))
    assert sorted(r["file_path"] for r in got.collect()) == ["/k/1.chat", "/k/4.chat"]
    files = spark.createDataFrame([("a", "codex", "/x/archived_sessions/a.jsonl"), ("a", "codex", "/x/sessions/a.jsonl")], "id string, source string, file_path string")
    assert C.first_file(files).first()["file_path"] == "/x/sessions/a.jsonl"


def test_claude_sidecar_wins(spark):
    data = lines(spark, "/p/-a-b/s.jsonl", [{"type": "user", "cwd": "/scan", "timestamp": "2026-01-03T00:00:00Z", "message": {"content": [{"type": "text", "text": "<system-reminder>x"}, {"type": "text", "text": "real  text"}]}}])
    f = facts(spark, "/p/-a-b/s.jsonl")
    assert row(claude.index_claude(data, f)) == ("s", "claude", "/scan", "real text")
    assert claude.index_claude(data, f).first()["updated_at"] == datetime(2026, 1, 3)
    side = spark.createDataFrame([("s", "/proj", "2026-02-01T00:00:00Z", "No prompt")], "session_id string, project_path string, modified string, first_prompt string")
    assert row(claude.index_claude(data, f, side)) == ("s", "claude", "/proj", None)


def test_other_index_rows(spark):
    cc = lines(spark, "/c/a-b/s.jsonl", [{"role": "user", "timestamp": "2026-01-01T00:00:00Z", "content": "hi"}])
    f = facts(spark, "/c/a-b/s.jsonl")
    assert row(claude.index_commandcode(cc, f)) == ("s", "commandcode", "/a/b", "hi")
    titles = spark.createDataFrame([("s", "Title")], "session_id string, title string")
    assert row(claude.index_commandcode(cc, f, titles))[3] == "Title"
    bad = lines(spark, "/x/rollout-2026-01-15T10-00-00-q.jsonl", [{"type": "turn_context"}])
    assert codex.index_codex(bad, facts(spark, "/x/rollout-2026-01-15T10-00-00-q.jsonl")).count() == 0
    cur = lines(spark, "/h/my-proj/agent-transcripts/i.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>ask</user_query>"}]}}])
    assert row(events.index_cursor(cur, facts(spark, "/h/my-proj/agent-transcripts/i.jsonl"))) == ("i", "cursor-agent", "/my/proj", "ask")
    g = lines(spark, "/g/z.jsonl", [{"role": "user", "working_dir": "/w", "created": 1000, "content": json.dumps([{"type": "text", "text": "go  on"}])}])
    assert row(events.index_goose(g, facts(spark, "/g/z.jsonl"))) == ("z", "goose", "/w", "go on")
    known = spark.createDataFrame([("z", "name", None, "/db", "2026-01-01T00:00:00Z")], "id string, name string, description string, working_dir string, updated_at string")
    both = events.index_goose(g, facts(spark, "/g/z.jsonl"), known).collect()
    assert [(r["cwd"], r["summary"]) for r in both] == [("/db", "name")]
    o = docs(spark, [("/o/ses_1.json", {"id": "1", "title": "New session - x", "directory": "/d", "time": {"updated": 0}})])
    assert row(documents.index_opencode(o)) == ("1", "opencode", "/d", None)
    m = docs(spark, [("/t/proj/chats/session-1.json", {"messages": [{"type": "user", "content": "a <b>c</b>"}]})])
    assert row(documents.index_gemini(m)) == ("session-1", "gemini", "/t/proj", "a c")
    z = spark.createDataFrame([("t", "s" * 130, None, None, "{}")], "id string, summary string, updated_at string, worktree_branch string, json string")
    assert len(documents.index_zed(z).first()["summary"]) == 120


def test_kiro_index_prefers_workspace_entries(spark):
    chat = lambda n: {"executionId": "e", "metadata": {"endTime": 5000}, "chat": [{"role": "human", "content": "<user-rule>r</user-rule> do it"}] + [{"role": "bot", "content": "x"}] * n}
    d = docs(spark, [("/k/h/1.chat", chat(1)), ("/k/h/2.chat", chat(3)), ("/k/h/3.chat", {"executionId": "w", "chat": []})])
    ws = spark.createDataFrame([("w", "<b>x</b> Fix", "1000", None, "/k/workspace-sessions/L3dvcms/w.json")], "session_id string, title string, date_created string, workspace_directory string, file_path string")
    got = {r["id"]: (r["cwd"], r["summary"], r["file_path"]) for r in documents.index_kiro(d, facts(spark, "/k/h/1.chat", "/k/h/2.chat"), ws).collect()}
    assert got == {"e": ("", "do it", "/k/h/2.chat"), "w": ("/work", "Fix", "/k/workspace-sessions/L3dvcms/w.json")}


def test_opencode_tokens_and_parts(spark):
    s = docs(spark, [("/o/ses_s.json", {"id": "s", "time": {"created": 1000, "updated": 2000}})])
    m = docs(spark, [("/o/msg_1.json", {"id": "m1", "sessionID": "s", "role": "assistant", "time": {"created": 9000}, "tokens": {"input": 3, "output": 4, "cache": {"read": 1, "write": 2}}}), ("/o/msg_2.json", {"id": "m2", "sessionID": "s", "time": {"created": 9500}})])
    p = docs(spark, [("/o/prt_1.json", {"id": "p1", "messageID": "m1", "type": "reasoning", "text": "r"}), ("/o/prt_2.json", {"id": "p2", "messageID": "m1", "type": "tool", "tool": "bash", "state": {"input": {"c": 1}}}), ("/o/prt_3.json", {"id": "p3", "messageID": "m1", "type": "tool-result", "output": "o" * 600}), ("/o/prt_4.json", {"id": "p4", "messageID": "m1", "type": "text", "text": " "})])
    got = documents.ingest_opencode(s, m, p)
    assert [(r["role"], len(r["content"])) for r in got.messages.orderBy("idx").collect()] == [("assistant", 0), ("tool_use", 10), ("tool_result", 500)]
    assert got.sessions.first()["updated_at"] == datetime(1970, 1, 1, 0, 0, 9) and got.usage.first()["cache_creation"] == 2


def test_written_tables_and_lines(spark, tmp_path):
    from logweave.operators import slicing as S

    got = registry.ingest_all({"commandcode": {"lines": lines(spark, "/c/a-b/s.jsonl", [{"role": "user", "content": "hi", "timestamp": "2026-01-01T00:00:00Z"}, {"role": "assistant", "content": "yo", "timestamp": "2026-01-01T00:00:01Z"}])}})
    writers.write_table(got.messages, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("source = 'commandcode'").count() == 2
    meta = S.slice_meta(S.costed(got.messages), S.slice_sessions(got.messages, 100), 100, "head")
    writers.write_jsonl(got.messages, meta, str(tmp_path / "j"))
    told = [json.loads(r["value"])["type"] for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(told) == ["message", "message", "meta"]


def test_commandcode_system_lines_are_skipped(spark):
    got = claude.ingest_commandcode(lines(spark, "/c/a-b/s.jsonl", [{"role": "system", "content": "x"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}]}]))
    r = got.messages.first()
    assert got.messages.count() == 1 and r["content"] == "" and r["raw_line_index"] == 1


def test_unknown_anchor_is_an_error(spark):
    import pytest

    from logweave.operators import slicing as S

    with pytest.raises(ValueError):
        S.ranked(spark.range(1).select(F.lit("a").alias("source"), F.lit("b").alias("session_id"), F.lit(1).alias("idx")), "middle")

"""Ingest jobs on small hand-made inputs; the two sessions with known totals hold their values."""

import json
import re

from pyspark.sql import functions as F

from logweave.operators import stats as A
from logweave.sources import claude, codex, documents, events
from logweave.sources import readers as R


def lines(spark, path, rows):
    data = [(path, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(rows)]
    return spark.createDataFrame(data, "file_path string, line_no int, value string")


def docs(spark, rows):
    return spark.createDataFrame([(p, json.dumps(d)) for p, d in rows], "file_path string, value string").select("file_path", F.try_parse_json("value").alias("v"))


def told(messages):
    return [(r["idx"], r["role"], r["content"]) for r in messages.orderBy("session_id", "idx").collect()]


def say(role, content, t, **more):
    return {"type": role, "timestamp": f"2026-01-15T10:00:{t:02d}Z", "sessionId": "s1", "message": {"content": content, **more.pop("message", {})}, **more}


def test_claude_order_rules_and_stats(spark):
    use = lambda i, n, p: {"type": "tool_use", "id": i, "name": n, "input": {"file_path": p}}
    rows = [
        say("user", "<system-reminder> meta", 0, isMeta=True),
        say("user", "Fix it", 1, uuid="u1", cwd="/w"),
        "{bad",
        say("assistant", [{"type": "text", "text": "par"}], 2, uuid="a1"),
        say("assistant", [{"type": "thinking", "thinking": "deep"}, {"type": "text", "text": "part done"}, use("t1", "Read", "a.ts"), {"type": "tool_result", "tool_use_id": "t1", "content": "early"}, {"type": "text", "text": "after"}], 3, uuid="a1", message={"model": "m", "usage": {"input_tokens": 5, "output_tokens": 7}}),
        say("user", [{"type": "text", "text": "<environment_context>x"}, {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "r1"}, {"type": "text", "text": "r2"}], "is_error": True}, {"type": "text", "text": "go on"}], 4),
        say("assistant", [{"type": "thinking", "thinking": "only"}, use("t2", "Edit", "b.ts"), use("t2", "Bash", "c")], 5),
        say("user", [{"type": "tool_result", "tool_use_id": "t2", "content": "bad", "is_error": True}], 6),
        say("system", "x", 9),
        {"type": "user", "isCompactSummary": True, "message": {"content": "sum"}},
        {"type": "assistant", "timestamp": "2026-01-15T10:00:07Z", "isCompactSummary": True, "message": {"content": "c", "usage": {"input_tokens": 1}}},
        "",
    ]
    got = claude.ingest_claude(lines(spark, "/p/-w/file1.jsonl", rows))
    assert told(got.messages) == [
        (1, "user", "Fix it"), (2, "assistant", "part done"), (3, "tool_use", "Tool: Read"), (4, "tool_result", "early"), (5, "assistant", "after"),
        (6, "tool_result", "r1\nr2"), (7, "user", "go on"), (8, "assistant", "[thinking] only"), (9, "tool_use", "Tool: Edit"), (10, "tool_use", "Tool: Bash"), (11, "tool_result", "bad"),
    ]
    s = A.session_stats(got.messages, got.usage).first()
    assert s["token_usage"]["input"] == 6 and s["token_usage"]["output"] == 7 and s["token_usage"]["cache_read"] is None
    assert [(t["name"], t["count"], t["errors"]) for t in s["tool_frequency"]] == [("Read", 1, 1), ("Edit", 1, 0), ("Bash", 1, 1)]
    assert s["files_modified"] == ["b.ts"] and s["duration_ms"] == 5000
    m = got.sessions.first()
    assert (m["session_id"], m["cwd"], m["model"]) == ("s1", "/w", "m") and m["updated_at"].second == 9


def test_codex_events(spark):
    at = lambda t: f"2026-01-15T10:00:{t:02d}Z"
    item = lambda t, **p: {"type": "response_item", "timestamp": at(t), "payload": p}
    usage = lambda i, c, o: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}
    count = lambda t, **info: {"type": "event_msg", "timestamp": at(t), "payload": {"type": "token_count", "info": info}}
    patch = "*** Begin\n*** Add File: n.ts\n*** Update File: src/a.ts\n*** Delete File: n.ts\n"
    rows = [
        {"type": "session_meta", "timestamp": at(0), "payload": {"id": "c1", "cwd": "/w", "git": {"branch": "b", "repository_url": "u"}}},
        {"type": "turn_context", "payload": {"info": {"model": "deep-model"}}},
        item(1, type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>"}]),
        item(2, type="message", role="user", content=[{"type": "input_text", "text": " do "}]),
        item(3, type="message", role="developer", content=[{"type": "input_text", "text": "no"}]),
        item(4, type="reasoning", summary=[{"text": "think"}]),
        item(5, type="function_call", name="exec", call_id="k", arguments='{"cmd": "ls"}'),
        item(6, type="function_call_output", call_id="k", output='{"output": "FAILED  here\\nnow"}'),
        item(7, type="function_call_output", call_id="k", output="Error: x"),
        item(8, type="custom_tool_call", name="apply_patch", call_id="k", input=patch),
        item(9, type="function_call_output", call_id="k", output="FAILED"),
        count(10, total_token_usage=usage(100, 40, 10)),
        count(11, total_token_usage=usage(150, 60, 5)),
        count(12, last_token_usage=usage(7, 9, 1), total_token_usage=usage(160, 60, 20)),
        count(13, total_token_usage=usage(160, 60, 20)),
        {"type": "event_msg", "payload": {"type": "user_message", "message": "ignored"}},
    ]
    got = codex.ingest_codex(lines(spark, "/c/rollout-2026-01-15T10-00-00-zz.jsonl", rows))
    assert told(got.messages) == [(1, "user", "do"), (2, "assistant", "think"), (3, "tool_use", "Tool: exec"), (4, "tool_result", "FAILED here now"), (5, "tool_result", "Error: x"), (6, "tool_use", "Tool: apply_patch"), (7, "tool_result", "FAILED")]
    s = A.session_stats(got.messages, got.usage, got.durations, got.files).first()
    assert [(t["name"], t["count"], t["errors"]) for t in s["tool_frequency"]] == [("exec", 1, 1), ("apply_patch", 1, 1)]
    # 100/40/10, then 50/20/0 (output clamped), then 7 cached at 7
    assert (s["token_usage"]["input"], s["token_usage"]["output"], s["token_usage"]["cache_read"]) == (60 + 30 + 0, 10 + 0 + 1, 40 + 20 + 7)
    assert s["files_modified"] == ["n.ts", "src/a.ts"] and s["duration_ms"] == 13000
    m = got.sessions.first()
    assert (m["session_id"], m["model"], m["git_branch"]) == ("c1", "deep-model", "b")


def test_codex_without_items_uses_events(spark):
    rows = [{"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "yo"}}]
    got = codex.ingest_codex(lines(spark, "/c/rollout-2026-01-15T10-00-00-zz.jsonl", rows))
    assert told(got.messages) == [(1, "user", "hi"), (2, "assistant", "yo")] and got.messages.first()["session_id"] == "zz"


def test_codex_lines_are_parsed_once(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    rows = ["{bad", {"type": "session_meta", "timestamp": "2026-01-01T00:00:05Z", "payload": {"id": "c"}}, item(type="function_call", name="a"), item(type="function_call_output", output="ok"), {"type": "event_msg", "payload": {"type": "user_message", "message": "no"}}, item(type="function_call", name="b", id="i"), item(type="function_call_output", call_id="k", output={"x": 1}), item(type="message", role="user", content=[{"type": "input_text", "text": "hi"}])]
    got = codex.ingest_codex(lines(spark, "/c/f.jsonl", rows))
    for table in (got.messages, got.sessions, got.usage, got.durations, got.files):
        assert not re.search("parse_?json", table._jdf.queryExecution().optimizedPlan().toString().lower())
    seen = [(r["raw_line_index"], r["ts"].second, b["id"], b["tool_use_id"]) for r in got.messages.orderBy("idx").collect() for b in r["blocks"]]
    assert seen == [(1, 5, "call_1", None), (2, 5, None, "call_2"), (4, 5, "i", None), (5, 5, None, "k"), (6, 5, None, None)]


def test_goose_numbers_calls_within_a_message(spark):
    part = lambda k, **v: {k: {"value": v}}
    rows = [{"role": "assistant", "created": 1000, "content": [{"type": "text", "text": "a"}, part("toolRequest", name="x", arguments={"p": 1}), {"toolResponse": {"status": "error", "value": [{"type": "text", "text": "bad"}]}}, part("toolCall", name="y"), {"type": "text", "text": "b"}]}, {"role": "user", "content": "plain"}]
    m = events.ingest_goose(lines(spark, "/g/s.jsonl", rows)).messages
    assert told(m) == [(1, "assistant", "a"), (2, "tool_use", "Tool: x"), (3, "tool_result", "bad"), (4, "tool_use", "Tool: y"), (5, "assistant", "b"), (6, "user", "plain")]
    ids = [(b["id"], b["tool_use_id"]) for r in m.orderBy("idx").collect() for b in r["blocks"] if b["type"].startswith("tool")]
    assert ids == [("goose_call_0", None), (None, "goose_call_0"), ("goose_call_1", None)]
    assert [(r["name"], r["errors"]) for r in A.attributed_errors_by_message(m).collect()] == [("x", 1)]


def test_gemini_calls_and_errors(spark):
    d = {"sessionId": "g", "startTime": "2026-01-01T00:00:00Z", "lastUpdated": "2026-01-01T00:01:00Z", "messages": [
        {"type": "user", "content": [{"text": "q"}]},
        {"type": "gemini", "content": "a", "model": "gm", "thoughts": [{"subject": "s"}], "tokens": {"input": 3, "output": 4, "cached": 1}, "toolCalls": [{"name": "ls", "args": {"d": "."}, "status": "error", "result": [{"functionResponse": {"response": {"output": "o"}}}]}]},
        {"type": "warning", "content": "w"}]}
    got = documents.ingest_gemini(docs(spark, [("/t/proj/chats/session-1.json", d)]), projects=spark.createDataFrame([("proj", "/home/p")], "name string, folder string"))
    assert told(got.messages) == [(1, "user", "q"), (2, "assistant", "a"), (3, "tool_use", "Tool: ls"), (4, "tool_result", "o"), (5, "system", "[warning] w")]
    s = A.session_stats(got.messages, got.usage, got.durations).first()
    assert s["duration_ms"] == 60000 and s["token_usage"]["input"] == 3 and s["tool_frequency"][0]["errors"] == 0
    assert got.sessions.first()["cwd"] == "/home/p" and got.sessions.first()["model"] == "gm"


def test_kiro_chat_and_zed(spark):
    chat = {"executionId": "e", "metadata": {"startTime": 1000, "endTime": 5000, "modelId": "k"}, "context": [{"type": "steering", "id": "file:///proj/.kiro/x"}], "chat": [{"role": "human", "content": "# system"}, {"role": "human", "content": "<user-rule>r</user-rule> ask<EnvironmentContext>z"}, {"role": "bot", "content": "ok"}, {"role": "tool", "content": "y" * 3000}]}
    got = documents.ingest_kiro(docs(spark, [("/k/h/1.chat", chat)]))
    rows = told(got.messages)
    assert [(r[1], r[2][:3], len(r[2])) for r in rows] == [("user", "ask", 3), ("assistant", "ok", 2), ("tool_result", "yyy", 2000)]
    assert got.sessions.first()["cwd"] == "/proj"
    z = {"messages": [{"User": {"content": [{"Text": "q"}]}}, {"Agent": {"content": [{"Thinking": {"text": "h"}}, {"ToolUse": {"name": "n", "input": "{\"a\": 1}"}}, {"ToolResult": {"output": "o"}}, {"Text": "end"}]}}]}
    threads = spark.createDataFrame([("t", "s", "2026-01-01T00:00:00Z", "main", json.dumps(z))], "id string, summary string, updated_at string, worktree_branch string, json string")
    assert told(documents.ingest_zed(threads).messages) == [(1, "user", "q"), (2, "assistant", ""), (3, "tool_use", "Tool: n"), (4, "tool_result", "o"), (5, "assistant", "end")]


def test_copilot_tokens_and_index(spark):
    rows = [{"type": "session.start", "data": {"currentModel": "cm"}}, {"type": "user.message", "timestamp": "2026-01-01T00:00:00Z", "data": {"content": "hey <b>you</b>"}}, {"type": "assistant.message", "timestamp": "2026-01-01T00:00:01Z", "data": {"content": "yo", "toolRequests": [{"name": "t", "args": "not json"}]}}, {"type": "session.shutdown", "data": {"modelMetrics": {"a": {"usage": {"inputTokens": 2, "outputTokens": 3}}, "b": {"usage": {"inputTokens": 5}}}}}]
    data = lines(spark, "/s/d1/events.jsonl", rows)
    ws = spark.createDataFrame([("/s/d1", None, "/w", None, "2026-01-01T00:00:00Z", None, "br")], "session_dir string, id string, cwd string, summary string, created_at string, updated_at string, branch string")
    got = events.ingest_copilot(data, ws)
    assert told(got.messages) == [(1, "user", "hey <b>you</b>"), (2, "assistant", "yo"), (3, "tool_use", "Tool: t")]
    u = A.token_usage(got.usage).first()["token_usage"]
    assert (u["input"], u["output"]) == (7, 3) and got.sessions.first()["model"] == "cm"
    assert events.index_copilot(data, ws).first()["summary"] == "hey you"


def test_files_are_read_by_pattern(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"a":1}\r\n\n{bad\n{"a":2}\n')
    (tmp_path / "a" / "y.txt").write_text("no")
    files = R.read_files(spark, str(tmp_path), "claude")
    physical = R.lines_of(files)
    assert physical.count() == 4 and R.parsed(physical).count() == 2
    facts = R.facts_of(physical, files).first()
    assert facts["raw_line_count"] == 4 and facts["file_bytes"] == 23 and facts["mtime"] is not None

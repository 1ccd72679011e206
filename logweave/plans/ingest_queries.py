"""Ingest queries: raw lines and documents of every source are built from conversations and read back by its ingest job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import catalog as C
from ..operators import compare as D
from ..operators import search_index, snapshots
from ..operators import slicing as S
from ..operators import stats as A
from ..scratch import new_path
from ..sources import claude, codex, documents, events, heads, readers, registry, writers
from ..sources.lines import read_lines
from ..sources.ingest import Ingested
from ..streaming import running
from . import views as V
from .message_queries import BUDGET, CONV
from .message_queries import QUERIES as MESSAGE_QUERIES

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    t = F.unix_timestamp(F.lit(V.BASE_TIME)) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return c.withColumns({"sid": F.col("conv_id").cast("string"), "ms": t * 1000, "at": F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _block(kind: str | Column, **fields: Column) -> Column:
    """A raw block; absent fields are null and are not written."""
    all_ = {k: F.lit(None).cast("string") for k in ("text", "thinking", "id", "name", "tool_use_id", "content")} | {"input": F.lit(None).cast("struct<file_path:string,n:bigint>"), "is_error": F.lit(None).cast("boolean")}
    all_ |= fields
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), *[v.alias(k) for k, v in all_.items()])


def _facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_path").agg(F.count("*").alias("raw_line_count")).withColumns({"file_bytes": F.lit(0).cast("bigint"), "mtime": F.timestamp_seconds(F.unix_timestamp(F.lit(V.BASE_TIME)))})


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is written twice, first shortened, under one uuid; assistants call a tool, users return its result; a bad line at the end."""
    c = _conv(spark, sf_dir)
    call = F.concat(F.lit("t"), F.col("turn").cast("string"))
    said = F.array(_block("thinking", thinking=F.lit("hm")), _block("text", text=F.col("text")), _block("tool_use", id=call, name=F.lit("Edit"), input=F.struct(F.concat(F.lit("/f/"), (F.col("turn") % 3).cast("string")).alias("file_path"), F.col("turn").alias("n"))))
    told = F.array(_block("text", text=F.col("text")), _block("text", text=F.lit("<system-reminder>x")), _block("tool_result", tool_use_id=F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")), content=F.lit("out"), is_error=F.col("turn") % 4 == 2))
    usage = F.when(F.col("role") == "assistant", F.struct((F.col("turn") + 10).alias("input_tokens"), F.col("turn").alias("output_tokens")))
    line = lambda content: _json(type=F.col("role"), uuid=F.concat(F.col("sid"), F.lit("-"), F.col("turn").cast("string")), timestamp=F.col("at"), sessionId=F.col("sid"), cwd=F.concat(F.lit("/p/"), F.col("sid")), message=F.struct(F.lit("m1").alias("model"), content.alias("content"), usage.alias("usage")))
    blocks = F.when(F.col("role") == "assistant", said).otherwise(told)
    copies = F.when(F.col("turn") % 3 == 0, F.array(line(F.slice(blocks, 1, 1)), line(blocks))).otherwise(F.array(line(blocks)))
    rows = c.select(F.concat(F.lit("/x/"), F.col("sid"), F.lit(".jsonl")).alias("file_path"), "turn", F.posexplode(copies).alias("k", "value"))
    good = rows.select("file_path", (F.col("turn") * 2 + F.col("k")).cast("int").alias("line_no"), "value")
    return good.unionByName(c.select(F.concat(F.lit("/x/"), F.col("sid"), F.lit(".jsonl")).alias("file_path")).distinct().select("file_path", F.lit(10_000).alias("line_no"), F.lit("{bad").alias("value")))


CLAUDE = """x AS (SELECT conv_id, turn, 0 AS sub, role, text AS content FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1, 'tool_use', 'Tool: Edit' FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 0, 'tool_result', 'out' FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1, 'user', text FROM conversations WHERE role = 'user')"""


@query("i1_x1_x2_claude_messages", f"WITH {CLAUDE} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS INTEGER) AS idx, role, content FROM x")
def claude_messages(spark, sf_dir):
    return claude.ingest_claude(claude_lines(spark, sf_dir)).messages.select("session_id", "idx", "role", "content")


@query("i1_claude_sessions", """SELECT CAST(conv_id AS VARCHAR) AS session_id, '/p/' || conv_id AS cwd, 'm1' AS model, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + min(turn) * 60) AS created_at, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + max(turn) * 60) AS updated_at,
  CAST(count(*) + count(*) FILTER (WHERE turn % 3 = 0) + 1 AS BIGINT) AS raw_line_count FROM conversations GROUP BY conv_id""")
def claude_sessions(spark, sf_dir):
    lines = claude_lines(spark, sf_dir)
    return claude.ingest_claude(lines, _facts(lines)).sessions.select("session_id", "cwd", "model", "created_at", "updated_at", "raw_line_count")


@query("e4_claude_session_stats", """WITH a AS (SELECT *, turn AS t FROM conversations WHERE role = 'assistant'), r AS (SELECT u.conv_id, count(*) AS errors FROM conversations u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user' AND u.turn % 4 = 2 GROUP BY u.conv_id),
g AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS s FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT '/f/' || CAST(turn % 3 AS VARCHAR))), ',') AS files, sum(turn + 10) AS i, sum(turn) AS o FROM a GROUP BY conv_id)
SELECT CAST(g.conv_id AS VARCHAR) AS session_id, 2 * (u + s) AS total_messages, u AS n_user, s AS n_assistant, s AS n_tool_use, u AS n_tool_result, CASE WHEN s > 0 THEN 'Edit=' || s || '/' || coalesce(errors, 0) ELSE '' END AS tools, coalesce(files, '') AS files, CAST(i AS BIGINT) AS input, CAST(o AS BIGINT) AS output, s AS thinking
FROM g LEFT JOIN r ON r.conv_id = g.conv_id LEFT JOIN f ON f.conv_id = g.conv_id WHERE u + s > 0""")
def claude_stats(spark, sf_dir):
    got = stored(claude.ingest_claude(claude_lines(spark, sf_dir)))
    s = A.session_stats(got.messages, got.usage)
    told = F.transform("tool_frequency", lambda t: F.concat(t["name"], F.lit("="), t["count"].cast("string"), F.lit("/"), t["errors"].cast("string")))
    return s.select("session_id", "total_messages", "n_user", "n_assistant", "n_tool_use", "n_tool_result", F.array_join(told, " ").alias("tools"), F.array_join("files_modified", ",").alias("files"), "token_usage.input", "token_usage.output", F.coalesce(F.col("by_block_type")["thinking"], F.lit(0).cast("bigint")).alias("thinking"))


FIRST_USER = "nullif(substr(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\\s+', ' ', 'g')), 1, 120), '')"


@query("i12_index_claude", f"SELECT CAST(conv_id AS VARCHAR) AS id, coalesce(CASE WHEN count(*) > 0 THEN '/p/' || conv_id END, '') AS cwd, {FIRST_USER} AS summary FROM conversations WHERE turn * 2 < 30 GROUP BY conv_id")
def claude_index(spark, sf_dir):
    lines = claude_lines(spark, sf_dir)
    return claude.index_claude(lines, _facts(lines)).select("id", "cwd", "summary")


def codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    item = lambda payload: _json(type=F.lit("response_item"), timestamp=F.col("at"), payload=payload)
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    spoken = item(F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(kind.alias("type"), "text")).alias("content")))
    call_id = F.lit("call_1")
    call = item(F.struct(F.lit("function_call").alias("type"), F.concat(F.lit("tool"), (F.col("turn") % 3).cast("string")).alias("name"), call_id.alias("call_id"), F.lit('{"a":1}').alias("arguments")))
    output = item(F.struct(F.lit("function_call_output").alias("type"), call_id.alias("call_id"), F.when(F.col("turn") % 2 == 0, "FAILED x").otherwise("ok").alias("output")))
    counts = _json(type=F.lit("event_msg"), timestamp=F.col("at"), payload=F.struct(F.lit("token_count").alias("type"), F.struct(F.struct((F.col("turn") * 100 + 100).alias("input_tokens"), (F.col("turn") * 10).alias("cached_input_tokens"), (F.col("turn") * 5 + 5).alias("output_tokens")).alias("total_token_usage")).alias("info")))
    path = F.concat(F.lit("/c/rollout-2026-01-01T00-00-00-"), F.col("sid"), F.lit(".jsonl")).alias("file_path")
    rows = c.select(path, "turn", F.posexplode(F.array(spoken, call, output, counts)).alias("k", "value")).select("file_path", (F.col("turn") * 4 + F.col("k") + 1).cast("int").alias("line_no"), "value")
    head = c.select(path, "sid").distinct().select("file_path", F.lit(0).alias("line_no"), _json(type=F.lit("session_meta"), timestamp=F.lit("2026-01-01T00:00:00Z"), payload=F.struct(F.col("sid").alias("id"), F.lit("/w").alias("cwd"))).alias("value"))
    return rows.unionByName(head)


@query("i2_codex_messages", """WITH x AS (SELECT conv_id, turn, 0 AS sub, role, text AS content FROM conversations UNION ALL SELECT conv_id, turn, 1, 'tool_use', 'Tool: tool' || CAST(turn % 3 AS VARCHAR) FROM conversations UNION ALL SELECT conv_id, turn, 2, 'tool_result', CASE WHEN turn % 2 = 0 THEN 'FAILED x' ELSE 'ok' END FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS INTEGER) AS idx, role, trim(content) AS content FROM x""")
def codex_messages(spark, sf_dir):
    return codex.ingest_codex(codex_lines(spark, sf_dir)).messages.select("session_id", "idx", "role", "content")


@query("i2_w6_codex_usage_and_errors", """WITH p AS (SELECT *, turn * 100 + 100 - coalesce(lag(turn * 100 + 100) OVER w, 0) AS i, turn * 10 - coalesce(lag(turn * 10) OVER w, 0) AS c, turn * 5 + 5 - coalesce(lag(turn * 5 + 5) OVER w, 0) AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(i - least(c, i)) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, nullif(CAST(sum(least(c, i)) AS BIGINT), 0) AS cache_read, count(*) FILTER (WHERE turn % 2 = 0) AS errors FROM p GROUP BY conv_id""")
def codex_usage(spark, sf_dir):
    got = stored(codex.ingest_codex(codex_lines(spark, sf_dir)))
    s = A.session_stats(got.messages, got.usage, got.durations)
    return s.select("session_id", "token_usage.input", "token_usage.output", "token_usage.cache_read", F.aggregate("tool_frequency", F.lit(0).cast("bigint"), lambda n, t: n + t["errors"]).alias("errors"))


@query("i12_index_codex", "SELECT CAST(conv_id AS VARCHAR) AS id, '/w' AS cwd, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 117) || '...' END AS summary FROM (SELECT conv_id, nullif(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user' AND turn * 4 + 1 < 50), '\\s+', ' ', 'g')), '') AS s FROM conversations GROUP BY conv_id)")
def codex_index(spark, sf_dir):
    lines = codex_lines(spark, sf_dir)
    return codex.index_codex(lines, _facts(lines)).select("id", "cwd", "summary")


def _plain(where: str, role: str = "role", content: str = "text") -> str:
    return f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS idx, {role} AS role, {content} AS content FROM conversations WHERE {where}"


SPOKEN = "role IN ('user', 'assistant')"


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "idx", "role", "content")


def commandcode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    value = _json(role=F.col("role"), timestamp=F.col("at"), content=F.array(_block("text", text=F.col("text"))))
    return c.select(F.concat(F.lit("/p/a-b/"), F.col("sid"), F.lit(".jsonl")).alias("file_path"), F.col("turn").cast("int").alias("line_no"), value.alias("value"))


@query("i6_commandcode_messages", _plain(SPOKEN))
def commandcode_messages(spark, sf_dir):
    return _told(claude.ingest_commandcode(commandcode_lines(spark, sf_dir)).messages)


def gemini_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise("user")
    m = F.struct(kind.alias("type"), F.col("text").alias("content"))
    packed = c.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"), F.min("at").alias("startTime"), F.max("at").alias("lastUpdated"))
    return packed.select(F.concat(F.lit("/g/tmp/proj/chats/session-"), F.col("sid"), F.lit(".json")).alias("file_path"), F.try_parse_json(_json(sessionId=F.col("sid"), startTime=F.col("startTime"), lastUpdated=F.col("lastUpdated"), messages=F.col("messages"))).alias("v"))


@query("i3_gemini_messages", _plain("true", content="CASE WHEN role = 'system' THEN '[info] ' || text ELSE text END"))
def gemini_messages(spark, sf_dir):
    return _told(documents.ingest_gemini(gemini_docs(spark, sf_dir)).messages)


def copilot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    value = _json(type=F.concat(F.col("role"), F.lit(".message")), timestamp=F.col("at"), data=F.struct(F.col("text").alias("content")))
    return c.select(F.concat(F.lit("/s/"), F.col("sid"), F.lit("/events.jsonl")).alias("file_path"), F.col("turn").cast("int").alias("line_no"), value.alias("value"))


@query("i4_copilot_messages", _plain(SPOKEN))
def copilot_messages(spark, sf_dir):
    return _told(events.ingest_copilot(copilot_lines(spark, sf_dir)).messages)


@query("i5_cursor_messages", _plain(SPOKEN, content="trim(text)"))
def cursor_messages(spark, sf_dir):
    c = _conv(spark, sf_dir)
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("<user_query>"), F.col("text"), F.lit("</user_query>"))).otherwise(F.col("text"))
    value = _json(role=F.col("role"), message=F.struct(F.array(_block("text", text=wrapped)).alias("content")))
    lines = c.select(F.concat(F.lit("/h/proj-x/agent-transcripts/"), F.col("sid"), F.lit(".jsonl")).alias("file_path"), F.col("turn").cast("int").alias("line_no"), value.alias("value"))
    return _told(events.ingest_cursor(lines, _facts(lines)).messages)


@query("i7_goose_messages", _plain("true"))
def goose_messages(spark, sf_dir):
    c = _conv(spark, sf_dir)
    parts = F.to_json(F.array(_block("text", text=F.col("text"))))
    content = F.when(F.col("turn") % 2 == 0, parts).otherwise(F.col("text"))  # JSON text, or plain text
    value = _json(role=F.col("role"), created=F.col("ms"), content=content)
    lines = c.where("turn % 2 = 0 or role != 'system'").select(F.concat(F.lit("/goose/"), F.col("sid"), F.lit(".jsonl")).alias("file_path"), F.col("turn").cast("int").alias("line_no"), value.alias("value"))
    return _told(events.ingest_goose(lines).messages)


QUERIES["i7_goose_messages"] = (goose_messages, _plain("turn % 2 = 0 OR role <> 'system'"))


@query("i7_goose_tables", _plain("true"))
def goose_tables(spark, sf_dir):
    c = _conv(spark, sf_dir)
    rows = c.select(F.col("sid").alias("session_id"), "role", F.to_json(F.array(_block("text", text=F.col("text")))).alias("content_json"), F.col("ms").alias("created_timestamp"))
    text = lambda v: F.lit(v).cast("string")
    sessions = c.select("sid").distinct().select(F.col("sid").alias("id"), text("n").alias("name"), text(None).alias("description"), text("/w").alias("working_dir"), text("2026-01-01T00:00:00Z").alias("created_at"), text("2026-01-02T00:00:00Z").alias("updated_at"), F.lit(5).alias("input_tokens"), F.lit(6).alias("output_tokens"), text('{"model":"g"}').alias("model_config_json"))
    return _told(events.ingest_goose_tables(rows, sessions).messages)


@query("i8_j4_opencode_messages", _plain("true"))
def opencode_messages(spark, sf_dir):
    c = _conv(spark, sf_dir)
    doc = lambda path, value: (path.alias("file_path"), F.try_parse_json(value).alias("v"))
    mid = F.concat(F.col("sid"), F.lit("-"), F.col("turn").cast("string"))
    sessions = c.groupBy("sid").agg(F.min("ms").alias("ms")).select(*doc(F.concat(F.lit("/o/p/ses_"), F.col("sid"), F.lit(".json")), _json(id=F.col("sid"), title=F.lit("T"), directory=F.lit("/w"), time=F.struct(F.col("ms").alias("created"), F.col("ms").alias("updated")))))
    said = c.select(*doc(F.concat(F.lit("/o/msg_"), mid), _json(id=mid, sessionID=F.col("sid"), role=F.col("role"), time=F.struct(F.col("ms").alias("created")))))
    parts = c.select(*doc(F.concat(F.lit("/o/prt_"), mid), _json(id=F.concat(F.lit("prt_"), mid), messageID=mid, type=F.lit("text"), text=F.col("text"))))
    return _told(documents.ingest_opencode(sessions, said, parts).messages)


@query("i9_kiro_messages", _plain(SPOKEN))
def kiro_messages(spark, sf_dir):
    c = _conv(spark, sf_dir)
    entry = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))
    packed = c.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", entry.alias("m")))), lambda x: x["m"]).alias("history"))
    docs = packed.select(F.concat(F.lit("/k/workspace-sessions/L3dvcms/"), F.col("sid"), F.lit(".json")).alias("file_path"), F.try_parse_json(_json(history=F.col("history"))).alias("v"))
    return _told(documents.ingest_kiro(docs).messages)


@query("i10_x3_zed_messages", f"WITH x AS (SELECT conv_id, turn, 0 AS sub, role, text AS content FROM conversations WHERE {SPOKEN} UNION ALL SELECT conv_id, turn, 1, 'tool_use', 'Tool: grep' FROM conversations WHERE role = 'assistant') SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS INTEGER) AS idx, role, content FROM x")
def zed_messages(spark, sf_dir):
    c = _conv(spark, sf_dir).where("role != 'system'")
    none = F.lit(None).cast("struct<name:string,id:string>")
    body = F.struct(F.array(F.struct(F.col("text").alias("Text"), none.alias("ToolUse"))).alias("content"))
    called = F.struct(F.array(F.struct(F.col("text").alias("Text"), none.alias("ToolUse")), F.struct(F.lit(None).cast("string").alias("Text"), F.struct(F.lit("grep").alias("name"), F.lit("z").alias("id")).alias("ToolUse"))).alias("content"))
    m = F.struct(F.when(F.col("role") == "user", body).alias("User"), F.when(F.col("role") == "assistant", called).alias("Agent"))
    packed = c.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"))
    threads = packed.select(F.col("sid").alias("id"), F.lit("s").alias("summary"), F.lit("2026-01-01T00:00:00Z").alias("updated_at"), F.lit("main").alias("worktree_branch"), _json(messages=F.col("messages")).alias("json"))
    return _told(documents.ingest_zed(threads).messages)


@query("i11_u1_all_sources", """SELECT s AS source, count(*) AS messages FROM conversations, (VALUES ('commandcode'), ('gemini'), ('copilot')) v(s) WHERE role IN ('user', 'assistant') OR s = 'gemini' GROUP BY s""")
def all_sources(spark, sf_dir):
    got = registry.ingest_all({"commandcode": {"lines": commandcode_lines(spark, sf_dir)}, "gemini": {"docs": gemini_docs(spark, sf_dir)}, "copilot": {"lines": copilot_lines(spark, sf_dir)}})
    return got.messages.groupBy("source").agg(F.count("*").alias("messages"))


@query("st1_stream_totals", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system, CAST(sum(4 + ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def stream_totals(spark, sf_dir):
    """The messages come in four appends, a part of them twice; each is passed on once, and totals are kept by session."""
    base = _scratch(spark)
    m = V.conversation_messages(spark, sf_dir)
    for k in (1, 0, 3, 2, 3):
        m.where(F.col("idx") % 4 == k).write.mode("append").parquet(f"{base}/messages")
    running.start_new(running.stream_messages(spark, f"{base}/messages", m.schema, max_files=8), f"{base}/new", f"{base}/checkpoint").awaitTermination()
    running.start_totals(running.stream_messages(spark, f"{base}/new", m.schema, max_files=8), f"{base}/totals", f"{base}/checkpoint-totals").awaitTermination()
    return running.latest_totals(spark, f"{base}/totals").select("session_id", "total_messages", "n_user", "n_assistant", "n_system", "tokens")


@query("st1_new_messages", f"WITH {CONV} SELECT source, session_id, idx, role, md5(text) AS content_md5 FROM c")
def stream_new_messages(spark, sf_dir):
    """The stream stops after a first part and goes on with the rest, of which a part was seen before: each message once."""
    base = _scratch(spark)
    m = V.conversation_messages(spark, sf_dir)
    go_on = lambda: running.start_new(running.stream_messages(spark, f"{base}/messages", m.schema, max_files=8), f"{base}/new", f"{base}/checkpoint").awaitTermination()
    m.where("idx <= 3").write.parquet(f"{base}/messages")
    go_on()
    m.where("idx > 2").write.mode("append").parquet(f"{base}/messages")
    go_on()
    return spark.read.parquet(f"{base}/new").select("source", "session_id", "idx", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def stored(got: Ingested) -> Ingested:
    """The ingested tables as Parquet (S6): raw lines are parsed once, and statistics read the normalised columns."""
    spark = got.messages.sparkSession
    base = _scratch(spark)
    kept = {}
    for name in ("messages", "sessions", "usage", "durations", "files"):
        table = getattr(got, name)
        if table is not None:
            writers.write_table(table, f"{base}/{name}")
            kept[name] = spark.read.schema(table.schema).parquet(f"{base}/{name}")
    return Ingested(**kept)


def _scratch(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def _files(lines: DataFrame) -> str:
    """The lines as files by their own names, below a new folder."""
    at = _scratch(lines.sparkSession)
    writers.write_files(lines, at).write.format("noop").mode("overwrite").save()
    return at


ONE_LINE = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"


@query("s1_s3_split_lines", f"""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, role || ' ' || {ONE_LINE} AS value, count(*) OVER (PARTITION BY conv_id) AS raw_line_count, sum(strlen(role || ' ' || {ONE_LINE}) + 1 + conv_id % 2) OVER (PARTITION BY conv_id) AS file_bytes FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, line_no, md5(value) AS value_md5, raw_line_count, CAST(file_bytes AS BIGINT) AS file_bytes FROM l""")
def split_lines(spark, sf_dir):
    """Text files of conversations, those of odd ones with CR LF, read in blocks."""
    c = _conv(spark, sf_dir)
    value = F.concat("role", F.lit(" "), F.regexp_replace("text", "[\r\n]+", " "), F.when(F.col("conv_id") % 2 == 1, "\r").otherwise(""))
    lines = c.select(F.concat(F.lit("logs/"), F.col("sid"), F.lit(".jsonl")).alias("file_path"), F.col("turn").alias("line_no"), value.alias("value"))
    got = read_lines(spark, _files(lines), "claude")
    return got.lines.join(got.facts, "file_path").select(readers.base_name().alias("session_id"), "line_no", F.md5(F.col("value").cast("binary")).alias("value_md5"), "raw_line_count", "file_bytes")


@query("s4_s5_i12_claude_heads", QUERIES["i12_index_claude"][1])
def claude_heads(spark, sf_dir):
    """Claude's lines as files among others, of which only the heads are read."""
    at = _files(claude_lines(spark, sf_dir))
    read = heads.read_heads(spark, {"claude": f"{at}/x", "codex": f"{at}/none"}).where("source = 'claude'")
    return claude.index_claude(read, heads.facts_of(read)).select("id", "cwd", "summary")


@query("s2_s3_s4_gemini_files", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, 1 AS raw_line_count FROM (SELECT conv_id, CASE WHEN role = 'system' THEN '[info] ' || text ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def gemini_files(spark, sf_dir):
    """Gemini's documents as files, with one beside them whose name is none of gemini's."""
    docs = gemini_docs(spark, sf_dir).select("file_path", F.lit(0).alias("line_no"), F.to_json("v").alias("value"))
    other = docs.limit(1).select(F.lit("/g/tmp/proj/chats/notes.json").alias("file_path"), "line_no", "value")
    files = readers.read_files(spark, _files(docs.unionByName(other)), "gemini")
    lines = readers.lines_of(files)
    got = documents.ingest_gemini(readers.documents(files), readers.facts_of(lines, files))
    told = got.messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.char_length("content")).alias("chars"))
    return told.join(got.sessions.where("file_bytes > 0 and mtime is not null").select("session_id", "raw_line_count"), "session_id")


def laid_out(df: DataFrame) -> DataFrame:
    """The rows as a table bucketed by session."""
    spark = df.sparkSession
    at = _scratch(spark)
    return writers.lay_out(df, f"laid_{at[-32:]}", at, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _of_laid_out(name: str, table, work, sql: str) -> None:
    def run(spark, sf_dir):
        return work(laid_out(table(spark, sf_dir)))

    QUERIES[name] = (run, sql)


_of_laid_out("s6_w2_laid_out", V.conversation_messages, lambda m: S.slice_sessions(m, BUDGET, "head").select("session_id", "idx", "role", "cost"), MESSAGE_QUERIES["w2_head_slice"][1])
_of_laid_out("s6_a3_laid_out", V.tool_messages, lambda m: A.tool_counts(m).select("session_id", "name", "count", "errors"), MESSAGE_QUERIES["a3_j1_tool_counts"][1])


@query("f4_a11_indexed_counts", MESSAGE_QUERIES["a11_match_counts"][1])
def indexed_counts(spark, sf_dir):
    index = search_index.build_index(V.conversation_messages(spark, sf_dir), _scratch(spark))
    return search_index.indexed_counts(index, "ING").drop("source")


@query("t2_indexed_search", MESSAGE_QUERIES["t2_search_top"][1])
def indexed_search(spark, sf_dir):
    index = search_index.build_index(V.conversation_messages(spark, sf_dir), _scratch(spark))
    return C.search_sessions(V.session_index(spark, sf_dir), index, "ing")


@query("i11_failing_source", """SELECT s AS source, count(*) FILTER (WHERE ok) AS messages, count(*) FILTER (WHERE NOT ok) > 0 AS failed FROM (SELECT s, true AS ok FROM conversations, (VALUES ('commandcode'), ('gemini')) v(s) WHERE role IN ('user', 'assistant') OR s = 'gemini' UNION ALL SELECT 'copilot', false FROM (SELECT count(*) FROM conversations)) GROUP BY s""")
def failing_source(spark, sf_dir):
    """Copilot's lines can't be read; the others' rows stay."""
    broken = copilot_lines(spark, sf_dir).withColumn("value", F.when(F.col("line_no") >= 0, F.raise_error(F.lit("unreadable")).cast("string")))
    got, failed = registry.store_all(spark, {"commandcode": {"lines": commandcode_lines(spark, sf_dir)}, "copilot": {"lines": broken}, "gemini": {"docs": gemini_docs(spark, sf_dir)}}, _scratch(spark))
    counts = got.messages.groupBy("source").agg(F.count("*").alias("messages"), F.lit(False).alias("failed"))
    return counts.unionByName(failed.where("reason is not null").select("source", F.lit(0).cast("bigint").alias("messages"), F.lit(True).alias("failed")))


@query("e8_j8_snapshots", MESSAGE_QUERIES["j8_changed_sessions"][1])
def snapshot_changes(spark, sf_dir):
    """Two appends; what the second changed."""
    m, kept = V.conversation_messages(spark, sf_dir), snapshots.Snapshots(spark, _scratch(spark), 16)
    first = kept.advance(m.where("idx <= 4"))
    kept.advance(m.where("idx > 4"))
    return kept.changed(first)


@query("e8_j7_snapshots", MESSAGE_QUERIES["j7_new_messages"][1])
def snapshot_news(spark, sf_dir):
    """Messages beyond the counts of a snapshot."""
    m, kept = V.conversation_messages(spark, sf_dir), snapshots.Snapshots(spark, _scratch(spark), 16)
    first = kept.advance(m.where((F.col("idx") <= 4) & (F.col("session_id").cast("bigint") % 5 != 0)))
    kept.advance(m.where("idx = 5"))
    return D.new_messages(m, kept.before(first)).select("session_id", "idx")


@query("u3_insertion_order", """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) SELECT CAST(conv_id AS VARCHAR) AS id, string_agg(role, ',' ORDER BY role = 'system', CASE WHEN role = 'system' THEN 0 ELSE t END) AS tags FROM f GROUP BY conv_id""")
def insertion_order(spark, sf_dir):
    """Roles as tags, in the order of their first turns, the system's added afterwards; all are added again."""
    said = V.conversation_messages(spark, sf_dir).select("session_id", F.col("role").alias("tag"), F.col("idx").alias("seq"))
    first = C.apply_tags(said.limit(0), said.where("tag != 'system'"))
    tags = C.apply_tags(first, said)
    return C.with_tags(tags.select(F.col("session_id").alias("id")).distinct(), tags).select("id", F.array_join("tags", ",").alias("tags"))


@query("p14_deep_model", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' || user_id WHEN event_id % 3 = 1 THEN 'n' || event_id END AS model FROM events")
def deep_model(spark, sf_dir):
    """Names of models as many levels deep as the event's number says, up to 20, under info or metadata, beside a deeper one that comes later."""
    e = V.table(spark, sf_dir, "events")
    depth = (F.pmod(F.col("event_id"), F.lit(20)) + 1).cast("int")
    own = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"model":" m'), F.col("user_id").cast("string"), F.lit('"'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"model":"","model_name":"n'), F.col("event_id").cast("string"), F.lit('"'))).otherwise(F.lit('"other":1'))
    under = F.when(F.col("event_id") % 2 == 0, F.lit('{"info":')).otherwise(F.lit('{"info":{"x":[]},"metadata":'))
    text = F.concat(F.repeat(under, depth), F.lit("{"), own, F.lit("}"), F.repeat(F.lit("}"), depth))
    return e.select("event_id", P.model_of(F.try_parse_json(text)).alias("model"))

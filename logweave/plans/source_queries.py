"""Ingest queries with tool calls, results, thinking and tokens, and index rows, of the sources whose plain queries tell texts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import claude, documents, events
from .ingest_queries import SPOKEN, _block, _conv, _facts, _json, gemini_docs

QUERIES: dict = {}

#: One line of clean text of at most 120 characters.
PROMPT = "nullif(substr(trim(regexp_replace({}, '\\s+', ' ', 'g')), 1, 120), '')"
#: Place of a turn in its conversation, from 0.
TURNS = "t AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS k FROM conversations)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


def _told(messages: DataFrame) -> DataFrame:
    """Each message with its blocks as text: type, text or content, id, name, arguments, error."""
    some = lambda *c: F.coalesce(*c, F.lit(""))
    one = lambda b: F.concat_ws("|", b["type"], some(b["text"], b["content"]), some(b["id"], b["tool_use_id"]), some(b["name"]), some(b["input_json"]), some(b["is_error"].cast("string")))
    return messages.select("session_id", "idx", "role", "content", F.array_join(F.transform("blocks", one), ";").alias("blocks"))


def _messages(parts: str) -> str:
    """SQL of messages from rows (conv_id, k, sub, role, content, blocks)."""
    return f"WITH {TURNS}, x AS ({parts}) SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, sub) AS INTEGER) AS idx, role, content, blocks FROM x"


TEXT = "'text|' || text || '||||'"
ASKS, SAYS = "FROM t WHERE role = 'user'", "FROM t WHERE role = 'assistant'"


def _place() -> Column:
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1


def _name(prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("sid"), F.lit(suffix)).alias("file_path")


def copilot_lines(spark, sf_dir: str) -> DataFrame:
    """A start, the turns (assistants request two tools, one with JSON text as arguments), and a shutdown with the metrics of two models."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    none = F.lit(None).cast("string")
    asked = F.array(F.struct(F.lit("grep").alias("name"), none.alias("toolName"), F.struct(F.col("k").alias("n")).alias("args"), none.alias("input")), F.struct(none.alias("name"), F.lit("view").alias("toolName"), F.lit(None).cast("struct<n:bigint>").alias("args"), F.lit('{"p":1}').alias("input")))
    data = F.struct(F.col("text").alias("content"), F.when(F.col("role") == "assistant", asked).alias("toolRequests"))
    rows = c.select(_name("/s/", "/events.jsonl"), (F.col("k") + 1).alias("line_no"), _json(type=F.concat("role", F.lit(".message")), timestamp=F.col("at"), data=data).alias("value"))
    ends = c.groupBy("sid").agg(F.count("*").alias("n"))
    start = ends.select(_name("/s/", "/events.jsonl"), F.lit(0).alias("line_no"), F.lit('{"type":"session.start","data":{"cwd":"/w","currentModel":"m0"}}').alias("value"))
    metrics = F.concat(F.lit('{"type":"session.shutdown","data":{"modelMetrics":{"a":{"usage":{"inputTokens":'), F.col("n").cast("string"), F.lit(',"outputTokens":2,"cacheReadTokens":3}},"b":{"usage":{"inputTokens":10}}}}}'))
    return rows.unionByName(start).unionByName(ends.select(_name("/s/", "/events.jsonl"), (F.col("n") + 1).alias("line_no"), metrics.alias("value")))


@query("i4_copilot_tools", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, {TEXT} AS blocks FROM t WHERE {SPOKEN}
  UNION ALL SELECT conv_id, k, 1, 'tool_use', 'Tool: grep', 'tool_use||copilot-tool-' || (k + 1) || '-grep|grep|{{"n":' || k || '}}|' {SAYS} UNION ALL SELECT conv_id, k, 2, 'tool_use', 'Tool: view', 'tool_use||copilot-tool-' || (k + 1) || '-view|view|{{"p":1}}|' {SAYS}"""))
def copilot_tools(spark, sf_dir):
    return _told(events.ingest_copilot(copilot_lines(spark, sf_dir)).messages)


@query("i4_a5_copilot_usage", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) + 10 AS input, CAST(2 AS BIGINT) AS output, CAST(3 AS BIGINT) AS cache_read FROM conversations GROUP BY conv_id")
def copilot_usage(spark, sf_dir):
    return events.ingest_copilot(copilot_lines(spark, sf_dir)).usage.select("session_id", "input", "output", "cache_read")


@query("i12_j3_copilot_index", f"SELECT CAST(conv_id AS VARCHAR) AS id, '/w' || conv_id % 3 AS cwd, CASE WHEN conv_id % 2 = 0 THEN 'S' || conv_id ELSE {PROMPT.format('p')} END AS summary, TIMESTAMP '2026-01-02 00:00:00' AS updated_at FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS p FROM conversations WHERE {SPOKEN} GROUP BY conv_id)")
def copilot_index(spark, sf_dir):
    """The workspace sidecar tells id, folder and time, and of even sessions the summary."""
    sessions = _conv(spark, sf_dir).select("sid", "conv_id").distinct()
    w = sessions.select(F.concat(F.lit("/s/"), "sid").alias("session_dir"), F.col("sid").alias("id"), F.concat(F.lit("/w"), (F.col("conv_id") % 3).cast("string")).alias("cwd"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("S"), "sid")).alias("summary"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.lit("2026-01-02T00:00:00Z").alias("updated_at"), F.lit("main").alias("branch"))
    return events.index_copilot(copilot_lines(spark, sf_dir), w.withColumn("session_dir", F.concat(F.lit("/s/"), "id"))).select("id", "cwd", "summary", "updated_at")


def cursor_lines(spark, sf_dir: str) -> DataFrame:
    """Users attach two files and an image."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    asked = F.concat(F.lit("<user_query>"), "text", F.lit('</user_query><attached_files><f path="/a/'), F.col("k").cast("string"), F.lit('"/>\n<f path="/b"/></attached_files><image_files>x</image_files>'))
    value = _json(role=F.col("role"), message=F.struct(F.array(_block("text", text=F.when(F.col("role") == "user", asked).otherwise(F.col("text")))).alias("content")))
    return c.select(_name("/h/proj-x/agent-transcripts/", ".jsonl"), F.col("k").alias("line_no"), value.alias("value"))


@query("i5_p8_cursor_attachments", _messages(f"""SELECT conv_id, k, 0 AS sub, role, trim(text || '[image]') || chr(10) || '[file: /a/' || k || ']' || chr(10) || '[file: /b]' AS content, 'text|' || trim(text || '[image]') || '||||' AS blocks {ASKS} UNION ALL SELECT conv_id, k, 0, role, trim(text), 'text|' || trim(text) || '||||' {SAYS}"""))
def cursor_attachments(spark, sf_dir):
    lines = cursor_lines(spark, sf_dir)
    return _told(events.ingest_cursor(lines, _facts(lines)).messages)


@query("i12_cursor_index", "SELECT CAST(conv_id AS VARCHAR) AS id, '/proj/x' AS cwd, substr(trim(arg_min(text, turn) FILTER (WHERE role = 'user') || '[image]'), 1, 120) AS summary FROM conversations GROUP BY conv_id")
def cursor_index(spark, sf_dir):
    lines = cursor_lines(spark, sf_dir)
    return events.index_cursor(lines, _facts(lines)).select("id", "cwd", "summary")


def commandcode_lines(spark, sf_dir: str) -> DataFrame:
    """Assistants think, speak and call a tool, with their usage; users answer with a result and a text."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    call = F.concat(F.lit("t"), F.col("k").cast("string"))
    said = F.array(_block("thinking", thinking=F.lit("hm")), _block("text", text=F.col("text")), _block("tool_use", id=call, name=F.lit("Edit"), input=F.struct(F.lit("/f").alias("file_path"), F.col("k").cast("bigint").alias("n"))))
    told = F.array(_block("text", text=F.col("text")), _block("tool_result", tool_use_id=F.concat(F.lit("t"), (F.col("k") - 1).cast("string")), content=F.lit("out"), is_error=F.col("k") % 2 == 1))
    usage = F.when(F.col("role") == "assistant", F.struct(F.struct((F.col("k") + 1).alias("input_tokens"), F.col("k").alias("output_tokens"), F.lit(7).alias("cache_read_input_tokens")).alias("usage")))
    value = _json(role=F.col("role"), timestamp=F.col("at"), content=F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", told), message=usage)
    return c.select(_name("/p/a-b/", ".jsonl"), F.col("k").alias("line_no"), value.alias("value"))


@query("i6_commandcode_tools", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, 'thinking|hm||||;' || {TEXT} AS blocks {SAYS} UNION ALL SELECT conv_id, k, 1, 'tool_use', 'Tool: Edit', 'tool_use||t' || k || '|Edit|{{"file_path":"/f","n":' || k || '}}|' {SAYS}
  UNION ALL SELECT conv_id, k, 0, 'tool_result', 'out', 'tool_result|out|t' || (k - 1) || '|||' || CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END {ASKS} UNION ALL SELECT conv_id, k, 1, role, text, {TEXT} {ASKS}"""))
def commandcode_tools(spark, sf_dir):
    return _told(claude.ingest_commandcode(commandcode_lines(spark, sf_dir)).messages)


@query("i6_a5_commandcode_usage", f"WITH {TURNS} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(k + 1) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output, CAST(7 * count(*) AS BIGINT) AS cache_read {SAYS} GROUP BY conv_id")
def commandcode_usage(spark, sf_dir):
    return claude.ingest_commandcode(commandcode_lines(spark, sf_dir)).usage.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read")])


@query("i12_j3_commandcode_index", f"WITH {TURNS} SELECT CAST(conv_id AS VARCHAR) AS id, '/a/b' AS cwd, CASE WHEN conv_id % 2 = 0 THEN 'T' || conv_id ELSE max(CASE WHEN k = 0 AND role = 'user' THEN {PROMPT.format('substr(text, 1, 200)')} END) END AS summary FROM t GROUP BY conv_id")
def commandcode_index(spark, sf_dir):
    """Titles of even sessions from the sidecar."""
    lines = commandcode_lines(spark, sf_dir)
    titles = _conv(spark, sf_dir).where("conv_id % 2 = 0").select(F.col("sid").alias("session_id"), F.concat(F.lit("T"), "sid").alias("title")).distinct()
    return claude.index_commandcode(lines, _facts(lines), titles).select("id", "cwd", "summary")


def goose_lines(spark, sf_dir: str) -> DataFrame:
    """A text, a call and its result in each message."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    parts = F.concat(F.lit('[{"type":"text","text":'), F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|\}$', ""), F.lit('},{"type":"toolRequest","toolCall":{"value":{"name":"sh","arguments":{"n":'), F.col("k").cast("string"), F.lit('}}}},{"type":"toolResponse","toolResult":{"status":"'), F.when(F.col("k") % 3 == 0, "error").otherwise("success"), F.lit('","value":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}]'))
    value = F.concat(F.lit('{"working_dir":"/w","role":"'), "role", F.lit('","created":'), F.col("ms").cast("string"), F.lit(',"content":'), parts, F.lit("}"))
    return c.select(_name("/goose/", ".jsonl"), F.col("k").alias("line_no"), value.alias("value"))


@query("i7_goose_tools", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, {TEXT} AS blocks FROM t UNION ALL SELECT conv_id, k, 1, 'tool_use', 'Tool: sh', 'tool_use||goose_call_0|sh|{{"n":' || k || '}}|' FROM t
  UNION ALL SELECT conv_id, k, 2, 'tool_result', 'a' || chr(10) || 'b', 'tool_result|a' || chr(10) || 'b|goose_call_0|||' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END FROM t"""))
def goose_tools(spark, sf_dir):
    return _told(events.ingest_goose(goose_lines(spark, sf_dir)).messages)


@query("i12_goose_index", "WITH f AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\\s+', ' ', 'g')) AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 30 GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS id, '/w' AS cwd, nullif(CASE WHEN length(p) <= 120 THEN p ELSE substr(p, 1, 117) || '...' END, '') AS summary FROM f")
def goose_index(spark, sf_dir):
    lines = goose_lines(spark, sf_dir)
    return events.index_goose(lines, _facts(lines)).select("id", "cwd", "summary")


def opencode_docs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts: reasoning, text, a tool with its state; assistants' messages have tokens."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    doc = lambda path, value: (path.alias("file_path"), F.try_parse_json(value).alias("v"))
    mid = F.concat("sid", F.lit("-"), F.col("k").cast("string"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" T"), "sid")).otherwise("New session - x")
    sessions = c.groupBy("sid", "conv_id").agg(F.min("ms").alias("ms")).select(*doc(F.concat(F.lit("/o/p/ses_"), "sid", F.lit(".json")), _json(id=F.col("sid"), title=title, directory=F.lit("/w"), time=F.struct(F.col("ms").alias("created"), F.col("ms").alias("updated")))))
    tokens = F.when(F.col("role") == "assistant", F.struct((F.col("k") + 5).alias("input"), F.col("k").alias("output"), F.struct(F.lit(2).alias("read"), F.lit(1).alias("write")).alias("cache")))
    said = c.select(*doc(F.concat(F.lit("/o/msg_"), mid), _json(id=mid, sessionID=F.col("sid"), role=F.col("role"), tokens=tokens, time=F.struct(F.col("ms").alias("created")))))
    none = F.lit(None).cast("string")
    state = F.struct(F.struct(F.col("k").alias("n")).alias("input"), F.lit("o").alias("output"))
    part = lambda n, kind, text, tool, state: F.struct(F.concat(F.lit(f"prt_{n}_"), mid).alias("id"), mid.alias("messageID"), F.lit(kind).alias("type"), text.alias("text"), tool.alias("tool"), state.alias("state"))
    no_state = F.lit(None).cast("struct<input:struct<n:int>,output:string>")
    parts = c.select(F.explode(F.array(part(1, "reasoning", F.lit("why"), none, no_state), part(2, "text", F.col("text"), none, no_state), part(3, "tool", none, F.lit("bash"), state))).alias("x")).select(*doc(F.concat(F.lit("/o/"), "x.id"), F.to_json("x")))
    return sessions, said, parts


@query("i8_opencode_tools", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, 'thinking|why||||;' || {TEXT} AS blocks FROM t UNION ALL SELECT conv_id, k, 1, 'tool_use', 'Tool: bash', 'tool_use||prt_3_' || conv_id || '-' || k || '|bash|{{"n":' || k || '}}|' FROM t"""))
def opencode_tools(spark, sf_dir):
    return _told(documents.ingest_opencode(*opencode_docs(spark, sf_dir)).messages)


@query("i8_a5_opencode_usage", f"WITH {TURNS} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(k + 5) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output, CAST(2 * count(*) AS BIGINT) AS cache_read, count(*) AS cache_creation {SAYS} GROUP BY conv_id")
def opencode_usage(spark, sf_dir):
    return documents.ingest_opencode(*opencode_docs(spark, sf_dir)).usage.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation")])


@query("i12_opencode_index", "SELECT CAST(conv_id AS VARCHAR) AS id, '/w' AS cwd, CASE WHEN conv_id % 2 = 0 THEN 'T' || conv_id END AS summary, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + min(turn) * 60) AS updated_at FROM conversations GROUP BY conv_id")
def opencode_index(spark, sf_dir):
    return documents.index_opencode(opencode_docs(spark, sf_dir)[0]).select("id", "cwd", "summary", "updated_at")


def kiro_docs(spark, sf_dir: str) -> DataFrame:
    """Chats: assistants are bots, users' turns come from tools; a second, shorter snapshot of each execution."""
    c = _conv(spark, sf_dir).withColumn("k", _place())
    m = F.struct(F.when(F.col("role") == "assistant", "bot").when(F.col("role") == "user", "tool").otherwise("other").alias("role"), F.col("text").alias("content"))
    packed = c.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", m.alias("m")))), lambda x: x["m"]).alias("chat"), F.min("ms").alias("a"), F.max("ms").alias("b"))
    facts = F.struct(F.col("a").alias("startTime"), F.col("b").alias("endTime"), F.lit("k1").alias("modelId"))
    context = F.array(F.struct(F.lit("steering").alias("type"), F.lit("file:///proj/.kiro/steering/x.md").alias("id")))
    doc = lambda folder, chat: packed.select(_name(folder, ".chat"), F.try_parse_json(_json(executionId=F.concat(F.lit("e"), "sid"), metadata=facts, context=context, chat=chat)).alias("v"))
    return doc("/k/h/", F.col("chat")).unionByName(doc("/k/i/", F.slice("chat", 1, 1)))


@query("i9_kiro_chats", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, {TEXT} AS blocks {SAYS} UNION ALL SELECT conv_id, k, 0, 'tool_result', substr(text, 1, 2000), 'tool_result|' || substr(text, 1, 2000) || '|kiro-tool-' || k || '|||false' {ASKS}""").replace("CAST(conv_id AS VARCHAR)", "'e' || conv_id"))
def kiro_chats(spark, sf_dir):
    return _told(documents.ingest_kiro(kiro_docs(spark, sf_dir).where("file_path like '/k/h/%'")).messages)


@query("i12_w11_kiro_index", "SELECT 'e' || conv_id AS id, '/proj' AS cwd, '/k/h/' || conv_id || '.chat' AS file_path, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + max(turn) * 60) AS updated_at FROM conversations GROUP BY conv_id")
def kiro_index(spark, sf_dir):
    docs = kiro_docs(spark, sf_dir)
    facts = docs.select("file_path", F.lit(None).cast("timestamp").alias("mtime"))
    return documents.index_kiro(docs, facts).select("id", "cwd", "file_path", "updated_at")


def zed_threads(spark, sf_dir: str) -> DataFrame:
    """Agents think, speak, call a tool and have its result."""
    c = _conv(spark, sf_dir).where("role != 'system'").withColumn("k", _place())
    quoted = F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|\}$', "")
    agent = F.concat(F.lit('{"Agent":{"content":[{"Thinking":{"text":"hm"}},{"Text":'), quoted, F.lit('},{"ToolUse":{"id":"z'), F.col("k").cast("string"), F.lit('","name":"grep","input":{"n":'), F.col("k").cast("string"), F.lit('}}},{"ToolResult":{"tool_use_id":"z'), F.col("k").cast("string"), F.lit('","content":"found"}}]}}'))
    user = F.concat(F.lit('{"User":{"content":[{"Text":'), quoted, F.lit("}]}}"))
    packed = c.select("sid", "k", F.when(F.col("role") == "user", user).otherwise(agent).alias("m")).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), ",").alias("m"))
    return packed.select(F.col("sid").alias("id"), F.concat(F.lit("thread "), "sid").alias("summary"), F.lit("2026-01-01T00:00:00Z").alias("updated_at"), F.lit("main").alias("worktree_branch"), F.concat(F.lit('{"model":{"model":"zm"},"messages":['), "m", F.lit("]}")).alias("json"))


ZED = TURNS.replace("FROM conversations", "FROM conversations WHERE role <> 'system'")


@query("i10_zed_tools", _messages(f"""SELECT conv_id, k, 0 AS sub, role, text AS content, 'thinking|hm||||;' || {TEXT} AS blocks {SAYS} UNION ALL SELECT conv_id, k, 1, 'tool_use', 'Tool: grep', 'tool_use||z' || k || '|grep|{{"n":' || k || '}}|' {SAYS} UNION ALL SELECT conv_id, k, 2, 'tool_result', 'found', 'tool_result|found|z' || k || '|||false' {SAYS} UNION ALL SELECT conv_id, k, 0, role, text, {TEXT} {ASKS}""").replace(TURNS, ZED))
def zed_tools(spark, sf_dir):
    return _told(documents.ingest_zed(zed_threads(spark, sf_dir)).messages)


@query("i12_zed_index", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, '' AS cwd, 'thread ' || conv_id AS summary, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM conversations WHERE role <> 'system'")
def zed_index(spark, sf_dir):
    return documents.index_zed(zed_threads(spark, sf_dir)).select("id", "cwd", "summary", "updated_at")


@query("i12_j3_kiro_sidecar", "WITH a AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) SELECT 'e' || conv_id AS id, '/proj' AS cwd, NULL AS summary, '/k/h/' || conv_id || '.chat' AS file_path FROM a WHERE conv_id % 2 = 1 UNION ALL SELECT 'e' || conv_id, '/ws/' || conv_id, 'Title ' || conv_id, '/k/w/' || conv_id || '.json' FROM a WHERE conv_id % 2 = 0")
def kiro_sidecar(spark, sf_dir):
    """Workspace entries of even executions win over their chats."""
    docs = kiro_docs(spark, sf_dir)
    c = _conv(spark, sf_dir).where("conv_id % 2 = 0").select("sid").distinct()
    known = c.select(F.concat(F.lit("e"), "sid").alias("session_id"), F.concat(F.lit("Title "), "sid").alias("title"), F.lit("1767225600000").alias("date_created"), F.concat(F.lit("/ws/"), "sid").alias("workspace_directory"), _name("/k/w/", ".json"))
    facts = docs.select("file_path", F.lit(None).cast("timestamp").alias("mtime"))
    return documents.index_kiro(docs, facts, known).select("id", "cwd", "summary", "file_path")


@query("i12_j3_gemini_index", f"SELECT CAST(conv_id AS VARCHAR) AS id, '/home/proj' AS cwd, {PROMPT.format('p')} AS summary, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + m * 60) AS updated_at FROM (SELECT conv_id, max(turn) AS m, arg_min(text, turn) FILTER (WHERE role = 'user') AS p FROM conversations GROUP BY conv_id)")
def gemini_index(spark, sf_dir):
    """The projects map names the folder."""
    projects = spark.createDataFrame([("proj", "/home/proj"), ("other", "/x")], "name string, folder string")
    return documents.index_gemini(gemini_docs(spark, sf_dir), projects).select("id", "cwd", "summary", "updated_at")

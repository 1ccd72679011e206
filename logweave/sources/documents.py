"""Sources with one JSON document a session or message: gemini, opencode, kiro, zed (I3, I8-I10) and their index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import explode as X
from . import readers as R
from .ingest import Ingested, index_table, session_table, usage_table

variant = "variant"
#: Cut of a kept tool output.
TOOL_TEXT = 2000


def _variants(v: Column | str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(P.col(v), path, "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(P.text_at(v, path), F.lit(""))


def _json(v: Column) -> Column:
    return F.when(v.isNull() | F.is_variant_null(v), "{}").otherwise(F.to_json(v))


def gemini_text(v: Column) -> Column:
    """A string, texts of an array joined by lines, or an object's text."""
    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda p: P.truthy(P.text_at(p, "$.text"))), lambda t: t.isNotNull())
    return F.coalesce(F.when(P.is_string(v), F.try_variant_get(v, "$", "string")).when(P.is_array(v), F.array_join(parts, "\n")).otherwise(P.text_at(v, "$.text")), F.lit(""))


def _gemini_messages(m: Column, i: Column) -> Column:
    content = F.try_variant_get(m, "$.content", variant)
    has = content.isNotNull() & ~F.is_variant_null(content) & ~F.coalesce(F.try_variant_get(content, "$", "string") == "", F.lit(False))
    text = F.when(has, gemini_text(content)).otherwise(gemini_text(F.try_variant_get(m, "$.displayContent", variant)))
    kind = P.text_at(m, "$.type")
    thoughts = F.filter(F.transform(_variants(m, "$.thoughts"), lambda t: F.coalesce(P.truthy(P.text_at(t, "$.description")), P.text_at(t, "$.subject"), F.lit(""))), lambda t: t != "")
    blocks = F.concat(F.transform(thoughts, lambda t: X.block("thinking", text=t)), F.when(text != "", F.array(X.block("text", text=text))).otherwise(F.array().cast("array<" + X.BLOCK + ">")))
    spoken = F.when(F.size(blocks) > 0, F.array(X.message("assistant", text, blocks))).otherwise(X.none())

    def call(tc: Column) -> Column:
        name = F.coalesce(P.truthy(P.text_at(tc, "$.name")), F.lit("unknown"))
        id_ = F.coalesce(P.truthy(P.text_at(tc, "$.id")), F.concat(F.lit("gemini-tool-"), i.cast("string"), F.lit("-"), name))
        def answer(r: Column) -> Column:
            error, output = P.truthy(P.text_at(r, "$.functionResponse.response.error")), P.text_at(r, "$.functionResponse.response.output")
            failed = F.coalesce(P.text_at(tc, "$.status") == "error", F.lit(False)) | error.isNotNull()
            b = X.block("tool_result", tool_use_id=id_, content=F.coalesce(error, output, F.lit("")), is_error=failed)
            return F.when(F.try_variant_get(r, "$.functionResponse", variant).isNotNull(), X.result_message(b))
        answers = F.filter(F.transform(_variants(tc, "$.result"), answer), lambda x: x.isNotNull())
        return F.concat(F.array(X.tool_message(X.block("tool_use", id=id_, name=name, input_json=_json(F.try_variant_get(tc, "$.args", variant))))), answers)

    calls = F.flatten(F.transform(_variants(m, "$.toolCalls"), call))
    note = F.concat(F.lit("["), kind, F.lit("] "), text)
    return F.when((kind == "user") & (text != ""), F.array(X.text_message("user", text))).when(kind == "gemini", F.concat(spoken, calls)).when(kind.isin("info", "error", "warning") & (text != ""), F.array(X.text_message("system", note))).otherwise(X.none())


def ingest_gemini(docs: DataFrame, facts: DataFrame | None = None, projects: DataFrame | None = None) -> Ingested:
    """I3. ``docs(file_path, v)``; ``projects(name, folder)`` names the folder of a project directory."""
    start, updated = P.timestamp_text(P.text_at("v", "$.startTime")), P.timestamp_text(P.text_at("v", "$.lastUpdated"))
    base = docs.where(P.is_array(F.try_variant_get("v", "$.messages", variant))).select("file_path", "v", F.coalesce(P.truthy(P.text_at("v", "$.sessionId")), R.base_name()).alias("session_id"), start.alias("created_at"), F.coalesce(updated, start).alias("updated_at"), F.lit("gemini").alias("source"))
    rows = base.select("source", "session_id", "file_path", "created_at", F.posexplode(_variants("v", "$.messages")).alias("i", "m"))
    ts = F.timestamp_millis(F.unix_millis("created_at") + F.col("i"))
    messages = X.explode_messages(rows.select("source", "session_id", "file_path", F.col("i").alias("raw_line_index"), ts.alias("ts"), _gemini_messages(F.col("m"), F.col("i")).alias("messages")))
    models = rows.groupBy("file_path").agg(R.last_of(P.truthy(P.text_at("m", "$.model")), "i").alias("model"))
    sessions = base.drop("v").join(models, "file_path", "left").withColumn("cwd", R.parent(levels=2))
    if projects is not None:
        sessions = sessions.withColumn("name", R.last_name(F.col("cwd"))).join(projects, "name", "left").withColumn("cwd", F.coalesce("folder", "cwd"))
    sessions = sessions.join(facts, "file_path", "left") if facts is not None else sessions
    at = lambda k: F.coalesce(P.long_at("m", f"$.tokens.{k}"), F.lit(0))
    usage = rows.where(F.try_variant_get("m", "$.tokens", variant).isNotNull()).select("source", "session_id", F.col("i").alias("line_no"), at("input").alias("input"), at("output").alias("output"), at("cached").alias("cache_read"))
    ms = F.unix_millis("updated_at") - F.unix_millis("created_at")
    return Ingested(messages, session_table(sessions), usage_table(usage), base.select("source", "session_id", F.when(ms > 0, ms).alias("duration_ms")), _no_files(base))


def _no_files(sessions: DataFrame) -> DataFrame:
    return sessions.select("source", "session_id", F.array().cast("array<string>").alias("files_modified"))


def index_gemini(docs: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """I12."""
    first = F.get(F.filter(_variants("v", "$.messages"), lambda m: P.text_at(m, "$.type") == "user"), 0)
    when = F.coalesce(P.timestamp_text(P.text_at("v", "$.lastUpdated")), P.timestamp_text(P.text_at("v", "$.startTime")), F.timestamp_millis(F.lit(0)))
    out = docs.where(P.is_array(F.try_variant_get("v", "$.messages", variant))).select(F.coalesce(P.truthy(P.text_at("v", "$.sessionId")), R.base_name()).alias("id"), F.lit("gemini").alias("source"), R.parent(levels=2).alias("cwd"), when.alias("updated_at"), P.clean_prompt(gemini_text(F.try_variant_get(first, "$.content", variant))).alias("summary"), "file_path")
    if projects is not None:
        out = out.withColumn("name", R.last_name(F.col("cwd"))).join(projects, "name", "left").withColumn("cwd", F.coalesce("folder", "cwd"))
    return index_table(out)


def opencode_block(v: Column) -> Column:
    """The block of an opencode part; null for parts without content."""
    kind = P.text_at(v, "$.type")
    first = lambda *paths: F.coalesce(*[P.truthy(P.text_at(v, p)) for p in paths])
    text = F.coalesce(first("$.text", "$.content"), F.lit(""))
    given = F.coalesce(*[F.when(~F.is_variant_null(F.try_variant_get(v, p, variant)), F.try_variant_get(v, p, variant)) for p in ("$.input", "$.args", "$.arguments", "$.state.input")])
    parsed = F.try_parse_json(F.try_variant_get(given, "$", "string"))
    args = F.when(given.isNull(), "{}").when(P.is_string(given), F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(F.to_json(F.struct(F.try_variant_get(given, "$", "string").alias("raw"))))).when(P.is_object(given), F.to_json(given)).otherwise("{}")
    used = X.block("tool_use", id=_text(v, "$.id"), name=F.coalesce(first("$.name", "$.toolName", "$.tool", "$.content"), F.lit("tool")), input_json=args)
    result = X.block("tool_result", tool_use_id=_text(v, "$.messageID"), content=F.substring(F.coalesce(first("$.text", "$.output", "$.content", "$.state.output"), F.lit("")), 1, 500), is_error=F.lit(False))
    return F.when((kind == "text") & ~P.is_blank(text), X.block("text", text=text)).when(kind.isin("thinking", "reasoning") & ~P.is_blank(text), X.block("thinking", text=text)).when(kind.isin("tool-call", "tool_use", "tool"), used).when(kind.isin("tool-result", "tool_result"), result)


def ingest_opencode(session_docs: DataFrame, message_docs: DataFrame, part_docs: DataFrame) -> Ingested:
    """I8 (J4): documents of sessions, messages and parts, each ``(file_path, v)``; parts are ordered by id (the original follows the folder's order)."""
    when = lambda path: F.timestamp_millis(P.long_at("v", path))
    sessions = session_docs.where(P.truthy(P.text_at("v", "$.id")).isNotNull()).select(P.text_at("v", "$.id").alias("session_id"), "file_path", _text(F.col("v"), "$.directory").alias("dir"), P.text_at("v", "$.modelID").alias("model"), when("$.time.created").alias("created_at"), F.coalesce(when("$.time.updated"), when("$.time.created")).alias("updated_at"))
    said = message_docs.where(P.truthy(P.text_at("v", "$.id")).isNotNull()).select(P.text_at("v", "$.id").alias("message_id"), P.text_at("v", "$.sessionID").alias("session_id"), F.coalesce(P.truthy(P.text_at("v", "$.role")), F.lit("assistant")).alias("role"), when("$.time.created").alias("own_ts"), F.try_variant_get("v", "$.tokens", variant).alias("tokens"))
    said = said.join(sessions.select("session_id", "file_path", "created_at"), "session_id")
    order = Window.partitionBy("session_id").orderBy(F.coalesce("own_ts", F.timestamp_millis(F.lit(0))), "message_id")
    said = said.withColumn("raw_line_index", F.row_number().over(order) - 1)
    parts = part_docs.select(P.text_at("v", "$.messageID").alias("message_id"), F.coalesce(P.text_at("v", "$.id"), F.col("file_path")).alias("part_id"), opencode_block(F.col("v")).alias("b")).where("b is not null")
    blocks = parts.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("part_id", "b"))).alias("t")).select("message_id", F.transform("t", lambda x: x["b"]).alias("blocks"))
    rows = said.join(blocks, "message_id").select(F.lit("opencode").alias("source"), "session_id", "file_path", "raw_line_index", F.coalesce("own_ts", "created_at").alias("ts"), X.flushed_messages(F.col("blocks").cast("array<" + X.BLOCK + ">"), F.col("role")).alias("messages"))
    messages = X.explode_messages(rows)
    last = messages.groupBy("session_id").agg(F.max_by("ts", "idx").alias("last_ts"))
    counts = said.groupBy("session_id").agg(F.count("*").alias("raw_line_count"))
    out = sessions.join(last, "session_id", "left").join(counts, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "last_ts")).withColumn("cwd", F.coalesce(P.truthy("dir"), R.parent())).withColumn("source", F.lit("opencode")).withColumn("raw_line_count", F.coalesce("raw_line_count", F.lit(0)))
    at = lambda p: F.coalesce(P.long_at("tokens", p), F.lit(0))
    usage = said.where("tokens is not null").select(F.lit("opencode").alias("source"), "session_id", F.col("raw_line_index").alias("line_no"), at("$.input").alias("input"), at("$.output").alias("output"), at("$.cache.read").alias("cache_read"), at("$.cache.write").alias("cache_creation"))
    return Ingested(messages, session_table(out), usage_table(usage), None, _no_files(out))


def index_opencode(session_docs: DataFrame) -> DataFrame:
    """I12."""
    title = F.when(~F.startswith(_text(F.col("v"), "$.title"), F.lit("New session - ")), P.truthy(P.truncate(P.trim(P.text_at("v", "$.title")), 120)))
    when = F.coalesce(F.timestamp_millis(P.long_at("v", "$.time.updated")), F.timestamp_millis(F.lit(0)))
    return index_table(session_docs.where(P.truthy(P.text_at("v", "$.id")).isNotNull()).select(P.text_at("v", "$.id").alias("id"), F.lit("opencode").alias("source"), _text(F.col("v"), "$.directory").alias("cwd"), when.alias("updated_at"), title.alias("summary"), "file_path"))


def _steering_folder(v: str = "v") -> Column:
    found = F.filter(F.transform(_variants(v, "$.context"), lambda c: F.when(P.text_at(c, "$.type") == "steering", P.truthy(F.regexp_extract(_text(c, "$.id"), r"file://(.*?)/.kiro/", 1)))), lambda f: f.isNotNull())
    return F.get(found, 0)


def ingest_kiro(docs: DataFrame, facts: DataFrame | None = None) -> Ingested:
    """Workspace sessions (``history``) and ``.chat`` files; a workspace session has no time of its own and gets null."""
    chat = F.endswith("file_path", F.lit(".chat"))
    folder = P.decode_base64(R.last_name(R.parent()))
    start, end = (F.timestamp_millis(P.long_at("v", f"$.metadata.{k}")) for k in ("startTime", "endTime"))
    logs = F.filter(F.transform(_variants("v", "$.history"), lambda h: F.when(P.text_at(h, "$.message.role") == "assistant", P.truthy(P.text_at(h, "$.promptLogs[0].modelTitle")))), lambda m: m.isNotNull())
    base = docs.select(
        "file_path", "v", chat.alias("chat"), F.lit("kiro").alias("source"), F.when(chat, F.coalesce(P.truthy(P.text_at("v", "$.executionId")), R.base_name())).otherwise(R.base_name()).alias("session_id"),
        F.when(chat, F.coalesce(_steering_folder(), R.parent())).otherwise(F.when(F.startswith(folder, F.lit("/")), folder).otherwise(R.parent())).alias("cwd"),
        F.when(chat, P.truthy(P.text_at("v", "$.metadata.modelId"))).otherwise(F.get(logs, 0)).alias("model"), F.when(chat, start).alias("created_at"), F.when(chat, end).alias("updated_at"),
    )
    rows = base.select("source", "session_id", "file_path", "chat", F.col("created_at").alias("ts"), F.posexplode(F.when(F.col("chat"), _variants("v", "$.chat")).otherwise(_variants("v", "$.history"))).alias("raw_line_index", "m"))
    m = F.col("m")
    parts = F.transform(F.filter(_variants("m", "$.message.content"), lambda c: P.text_at(c, "$.type").isin("text", "mention")), lambda c: _text(c, "$.text"))
    content = F.try_variant_get(m, "$.message.content", variant)
    history = F.when(P.is_string(content), P.text_at(m, "$.message.content")).otherwise(F.array_join(parts, "\n"))
    role = P.text_at(m, "$.message.role")
    workspace = F.when(role.isin("user", "assistant") & (history != ""), F.array(X.text_message(role, history))).otherwise(X.none())
    text, who = _text(m, "$.content"), P.text_at(m, "$.role")
    asked = F.coalesce(P.user_request(text), P.clean_title(text))
    cut = F.substring(text, 1, TOOL_TEXT)
    tool = X.block("tool_result", tool_use_id=F.concat(F.lit("kiro-tool-"), F.col("raw_line_index").cast("string")), content=cut, is_error=F.lit(False))
    chatted = F.when((who == "human") & ~P.is_system_prompt(text) & asked.isNotNull(), F.array(X.text_message("user", asked))).when((who == "bot") & (text != ""), F.array(X.text_message("assistant", text))).when((who == "tool") & (text != ""), F.array(X.result_message(tool))).otherwise(X.none())
    messages = X.explode_messages(rows.select("source", "session_id", "file_path", "raw_line_index", "ts", F.when(F.col("chat"), chatted).otherwise(workspace).alias("messages")))
    counts = messages.groupBy("file_path").agg(F.count("*").alias("n"))
    sessions = base.drop("v").join(counts, "file_path", "left").withColumn("raw_line_count", F.coalesce("n", F.lit(0)))
    sessions = sessions.join(facts.select("file_path", "file_bytes"), "file_path", "left") if facts is not None else sessions
    return Ingested(messages, session_table(sessions), None, None, _no_files(base))


def index_kiro(chat_docs: DataFrame, facts: DataFrame, workspace: DataFrame | None = None) -> DataFrame:
    """``workspace(session_id, title, date_created, workspace_directory, file_path)`` entries first; of the snapshots of an execution the longest chat."""
    from ..operators.catalog import keep_snapshots

    titles = F.filter(F.transform(_variants("v", "$.chat"), lambda c: F.when(P.text_at(c, "$.role") == "human", P.clean_title(P.user_request(_text(c, "$.content"))))), lambda t: t.isNotNull())
    n = F.size(F.filter(_variants("v", "$.chat"), lambda c: P.text_at(c, "$.role").isin("bot", "human")))
    chats = chat_docs.join(facts.select("file_path", "mtime"), "file_path", "left").select(
        P.truthy(P.text_at("v", "$.executionId")).alias("execution_id"), F.lit("kiro").alias("source"), F.coalesce(_steering_folder(), F.lit("")).alias("cwd"), F.coalesce(F.timestamp_millis(P.long_at("v", "$.metadata.endTime")), F.col("mtime")).alias("updated_at"), F.get(titles, 0).alias("summary"), "file_path", n.alias("message_count")
    )
    chats = keep_snapshots(chats).withColumn("id", F.coalesce("execution_id", F.concat(R.last_name(R.parent()), F.lit("/"), R.base_name())))
    if workspace is None:
        return index_table(chats)
    known = workspace.join(facts.select("file_path", "mtime"), "file_path", "left").select(
        F.col("session_id").alias("id"), F.lit("kiro").alias("source"), F.coalesce(P.truthy("workspace_directory"), P.decode_base64(R.last_name(R.parent())), R.parent()).alias("cwd"), F.coalesce("mtime", F.timestamp_millis(F.col("date_created").try_cast("bigint"))).alias("updated_at"), P.clean_title("title").alias("summary"), "file_path"
    )
    return index_table(known).unionByName(index_table(chats.join(known.select("id"), "id", "left_anti")))


def ingest_zed(threads: DataFrame) -> Ingested:
    """Rows ``(id, summary, updated_at, worktree_branch, json)``; every message has the thread's time."""
    base = threads.select(F.col("id").alias("session_id"), F.lit("zed").alias("source"), F.concat(F.lit("zed#"), F.col("id")).alias("file_path"), P.timestamp_text("updated_at").alias("updated_at"), P.truthy("worktree_branch").alias("git_branch"), F.try_parse_json("json").alias("v"), F.octet_length("json").cast("bigint").alias("file_bytes"))
    rows = base.select("source", "session_id", "file_path", F.col("updated_at").alias("ts"), F.posexplode(_variants("v", "$.messages")).alias("raw_line_index", "m"))
    user = F.try_variant_get("m", "$.User", variant).isNotNull()

    def one(b: Column, i: Column) -> Column:
        thought = F.coalesce(P.text_at(b, "$.Thinking"), P.text_at(b, "$.Thinking.text"), F.lit(""))
        text = _text(b, "$.Text")
        given = F.try_variant_get(b, "$.ToolUse.input", variant)
        parsed = F.try_parse_json(F.try_variant_get(given, "$", "string"))
        args = F.when(P.is_string(given), F.coalesce(F.to_json(parsed), F.lit("{}"))).otherwise(_json(given))
        used = X.block("tool_use", id=F.coalesce(P.truthy(P.text_at(b, "$.ToolUse.id")), F.concat(F.lit("zed-tool-"), i.cast("string"))), name=F.coalesce(P.truthy(P.text_at(b, "$.ToolUse.name")), F.lit("unknown")), input_json=args)
        result = X.block("tool_result", tool_use_id=_text(b, "$.ToolResult.tool_use_id"), content=F.substring(F.coalesce(P.truthy(P.text_at(b, "$.ToolResult.content")), P.text_at(b, "$.ToolResult.output"), F.lit("")), 1, TOOL_TEXT), is_error=F.lit(False))
        has = lambda k: F.try_variant_get(b, f"$.{k}", variant).isNotNull()
        return F.when(text != "", F.when(~P.is_blank(text), X.block("text", text=text))).when(has("ToolUse"), used).when(has("ToolResult"), result).when(~P.is_blank(thought), X.block("thinking", text=thought))

    content = F.when(user, _variants("m", "$.User.content")).otherwise(_variants("m", "$.Agent.content"))
    blocks = F.filter(F.transform(content, lambda b: one(b, F.col("raw_line_index"))), lambda b: b.isNotNull()).cast("array<" + X.BLOCK + ">")
    messages = X.explode_messages(rows.select("source", "session_id", "file_path", "raw_line_index", "ts", X.flushed_messages(blocks, F.when(user, "user").otherwise("assistant")).alias("messages")))
    sessions = base.withColumns({"cwd": F.lit(""), "created_at": F.col("updated_at"), "model": P.truthy(P.text_at("v", "$.model.model")), "raw_line_count": F.size(_variants("v", "$.messages"))})
    return Ingested(messages, session_table(sessions.drop("v")), None, None, _no_files(base))


def index_zed(threads: DataFrame) -> DataFrame:
    """I12."""
    when = F.coalesce(P.timestamp_text("updated_at"), F.timestamp_millis(F.lit(0)))
    return index_table(threads.select("id", F.lit("zed").alias("source"), F.lit("").alias("cwd"), when.alias("updated_at"), P.truthy(P.truncate("summary", 120)).alias("summary"), F.concat(F.lit("zed#"), F.col("id")).alias("file_path")))

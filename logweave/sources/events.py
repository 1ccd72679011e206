"""Copilot events, cursor-agent lines, goose lines and tables (I4, I5, I7) and their index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import explode as X
from . import readers as R
from .documents import _json, _no_files, _text, _variants, variant
from .ingest import Ingested, index_table, session_table, usage_table

#: Cut of a goose tool result.
GOOSE_RESULT = 500


def ingest_copilot(lines: DataFrame, workspaces: DataFrame | None = None, facts: DataFrame | None = None) -> Ingested:
    """I4: events of ``<session dir>/events.jsonl``; ``workspaces(session_dir, id, cwd, summary, created_at, updated_at, branch)``."""
    kept = R.numbered(R.parsed(lines)).withColumn("session_dir", R.parent())
    kind, content = P.text_at("v", "$.type"), _text(F.col("v"), "$.data.content")
    starts, ends = kind == "session.start", kind == "session.shutdown"
    first = lambda good, path: F.min_by(P.truthy(P.text_at("v", path)), F.when(good, F.col("line_no")))
    models = F.min_by(F.try_variant_get("v", "$.data.modelMetrics", "map<string,variant>"), F.when(ends, F.col("line_no")))
    head = kept.groupBy("file_path", "session_dir").agg(F.coalesce(first(starts, "$.data.currentModel"), first(ends, "$.data.currentModel")).alias("model"), first(starts, "$.data.cwd").alias("start_cwd"), F.transform(F.map_values(models), lambda m: F.struct(*[F.coalesce(P.long_at(m, f"$.usage.{k}"), F.lit(0)).alias(k) for k in ("inputTokens", "outputTokens", "cacheReadTokens")])).alias("models"))
    if workspaces is not None:
        head = head.join(workspaces, "session_dir", "left")
    else:
        head = head.withColumns({c: F.lit(None).cast("string") for c in ("id", "cwd", "summary", "created_at", "updated_at", "branch")})
    head = head.withColumn("session_id", F.coalesce(P.truthy("id"), R.last_name(F.col("session_dir")))).withColumn("cwd", F.coalesce(P.truthy("cwd"), "start_cwd", "session_dir")).withColumn("source", F.lit("copilot"))
    created = P.timestamp_text("created_at")
    head = head.withColumns({"git_branch": F.col("branch"), "updated_at": F.coalesce(P.timestamp_text("updated_at"), created), "created_at": created})
    rows = kept.join(head.select("file_path", "session_id"), "file_path")

    def call(t: Column) -> Column:
        name = F.coalesce(P.truthy(P.text_at(t, "$.name")), P.truthy(P.text_at(t, "$.toolName")), F.lit("unknown"))
        given = F.coalesce(*[F.when(~F.is_variant_null(F.try_variant_get(t, f"$.{k}", variant)), F.try_variant_get(t, f"$.{k}", variant)) for k in ("args", "arguments", "input")])
        args = F.when(P.is_string(given), P.object_or_empty(given)).otherwise(_json(given))
        return X.tool_message(X.block("tool_use", id=F.concat(F.lit("copilot-tool-"), F.col("raw_index").cast("string"), F.lit("-"), name), name=name, input_json=args))

    text = lambda role: F.when(content != "", F.array(X.text_message(role, content))).otherwise(X.none())
    said = F.when(kind == "user.message", text("user")).when(kind == "assistant.message", F.concat(text("assistant"), F.transform(_variants("v", "$.data.toolRequests"), call))).otherwise(X.none())
    messages = X.explode_messages(rows.select(F.lit("copilot").alias("source"), "session_id", F.col("session_dir").alias("file_path"), F.col("raw_index").alias("raw_line_index"), P.timestamp_text(P.text_at("v", "$.timestamp")).alias("ts"), said.alias("messages")))
    add = lambda k: F.aggregate("models", F.lit(0).cast("bigint"), lambda n, m: n + m[k])
    usage = head.where("models is not null").select("source", "session_id", F.lit(0).alias("line_no"), add("inputTokens").alias("input"), add("outputTokens").alias("output"), add("cacheReadTokens").alias("cache_read"))
    sessions = head.join(facts, "file_path", "left") if facts is not None else head
    return Ingested(messages, session_table(sessions.withColumn("file_path", F.col("session_dir"))), usage_table(usage), None, _no_files(head))


def index_copilot(lines: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Sessions with a workspace and any user or assistant message."""
    rows = R.parsed(lines).withColumn("session_dir", R.parent())
    kind = P.text_at("v", "$.type")
    seen = rows.groupBy("session_dir").agg(F.count_if(kind.isin("user.message", "assistant.message")).alias("n"), F.min_by(P.text_at("v", "$.data.content"), F.when(kind == "user.message", F.col("line_no"))).alias("prompt")).where("n > 0")
    when = F.coalesce(P.timestamp_text("updated_at"), P.timestamp_text("created_at"), F.timestamp_millis(F.lit(0)))
    out = seen.join(workspaces, "session_dir")
    return index_table(out.select(F.coalesce(P.truthy("id"), R.last_name(F.col("session_dir"))).alias("id"), F.lit("copilot").alias("source"), F.coalesce("cwd", F.lit("")).alias("cwd"), when.alias("updated_at"), F.coalesce(P.truthy("summary"), P.clean_prompt("prompt")).alias("summary"), F.col("session_dir").alias("file_path")))


def _cursor_folder() -> Column:
    up = F.when(F.endswith(R.parent(), F.lit("agent-transcripts")), R.parent(levels=2)).otherwise(R.parent(levels=3))
    return F.concat(F.lit("/"), P.decode_path(R.last_name(up)))


def ingest_cursor(lines: DataFrame, facts: DataFrame) -> Ingested:
    """Texts only, all at the file's time. The folder is the decoded name (the original probes the disk for it)."""
    rows = R.numbered(R.parsed(lines)).join(facts.select("file_path", "mtime"), "file_path").withColumn("session_id", R.base_name())
    role = P.text_at("v", "$.role")
    raw = F.filter(F.transform(_variants("v", "$.message.content"), lambda p: F.when(P.text_at(p, "$.type") == "text", P.truthy(P.text_at(p, "$.text")))), lambda t: t.isNotNull())
    clean = F.filter(F.transform(raw, P.user_text), lambda t: t != "")
    told = F.flatten(F.transform(raw, lambda t: F.concat(F.when(P.user_text(t) != "", F.array(P.user_text(t))).otherwise(F.array().cast("array<string>")), F.transform(P.attached_files(t), lambda f: F.concat(F.lit("[file: "), f, F.lit("]"))))))
    joined = F.array_join(told, "\n")
    user_blocks = F.when(F.size(clean) > 0, F.transform(clean, lambda t: X.block("text", text=t))).otherwise(F.array(X.block("text", text=joined)))
    user = F.when(F.size(told) > 0, F.array(X.message("user", joined, user_blocks))).otherwise(X.none())
    texts = F.filter(F.transform(raw, P.trim), lambda t: t != "")
    spoken = F.when(F.size(texts) > 0, F.array(X.message("assistant", F.array_join(texts, "\n"), F.transform(texts, lambda t: X.block("text", text=t))))).otherwise(X.none())
    messages = X.explode_messages(rows.select(F.lit("cursor-agent").alias("source"), "session_id", "file_path", F.col("raw_index").alias("raw_line_index"), F.col("mtime").alias("ts"), F.when(role == "user", user).when(role == "assistant", spoken).otherwise(X.none()).alias("messages")))
    base = facts.withColumns({"source": F.lit("cursor-agent"), "session_id": R.base_name(), "cwd": _cursor_folder(), "created_at": F.col("mtime"), "updated_at": F.col("mtime")})
    return Ingested(messages, session_table(base), None, base.select("source", "session_id", F.lit(None).cast("bigint").alias("duration_ms")), _no_files(base))


def index_cursor(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Files without any parsed line are left out."""
    rows = R.parsed(lines)
    texts = F.filter(F.transform(_variants("v", "$.message.content"), lambda p: F.when(P.text_at(p, "$.type") == "text", P.truthy(P.user_text(P.text_at(p, "$.text"))))), lambda t: t.isNotNull())
    seen = rows.groupBy("file_path").agg(R.first_of(F.when(P.text_at("v", "$.role") == "user", F.substring(F.get(texts, 0), 1, 120))).alias("summary"))
    return index_table(seen.join(facts.select("file_path", "mtime"), "file_path").select(R.base_name().alias("id"), F.lit("cursor-agent").alias("source"), _cursor_folder().alias("cwd"), F.col("mtime").alias("updated_at"), "summary", "file_path"))


def goose_blocks(parts: Column) -> Column:
    """Blocks of goose parts. Calls are numbered within their message; a result belongs to the call before it."""
    call = lambda p: F.coalesce(F.try_variant_get(p, "$.toolCall", variant), F.try_variant_get(p, "$.toolRequest", variant))
    answer = lambda p: F.coalesce(F.try_variant_get(p, "$.toolResult", variant), F.try_variant_get(p, "$.toolResponse", variant))
    kind = lambda p: F.coalesce(P.text_at(p, "$.type"), F.lit(""))
    is_text = lambda p: (kind(p) == "text") & (_text(p, "$.text") != "")
    is_call = lambda p: ~is_text(p) & (call(p).isNotNull() | (answer(p).isNull() & kind(p).isin("toolRequest", "toolCall")))
    is_answer = lambda p: ~is_text(p) & ~is_call(p) & (answer(p).isNotNull() | kind(p).isin("toolResponse", "toolResult"))

    def one(p: Column, i: Column) -> Column:
        calls = F.size(F.filter(F.slice(parts, 1, i), is_call))  # calls before this part
        id_ = lambda n: F.concat(F.lit("goose_call_"), n.cast("string"))
        value = F.filter(F.coalesce(F.try_variant_get(answer(p), "$.value", "array<variant>"), F.array().cast("array<variant>")), lambda x: P.text_at(x, "$.type") == "text")
        text = F.substring(F.array_join(F.transform(value, lambda x: _text(x, "$.text")), "\n"), 1, GOOSE_RESULT)
        used = X.block("tool_use", id=id_(calls), name=F.coalesce(P.truthy(P.text_at(call(p), "$.value.name")), F.lit("tool")), input_json=_json(F.try_variant_get(call(p), "$.value.arguments", variant)))
        result = X.block("tool_result", tool_use_id=id_(F.greatest(calls - 1, F.lit(0))), content=text, is_error=F.coalesce(P.text_at(answer(p), "$.status") == "error", F.lit(False)))
        return F.when(is_text(p), X.block("text", text=_text(p, "$.text"))).when(is_call(p), used).when(is_answer(p), result)

    return F.filter(F.transform(parts, one), lambda b: b.isNotNull()).cast("array<" + X.BLOCK + ">")


def ingest_goose(lines: DataFrame, facts: DataFrame | None = None, default_model: str | None = None) -> Ingested:
    """I7, JSON lines: content is an array, JSON text of one, or plain text."""
    kept = R.numbered(R.parsed(lines)).where(P.truthy(P.text_at("v", "$.role")).isNotNull()).withColumn("session_id", R.base_name())
    content, text = F.try_variant_get("v", "$.content", variant), P.text_at("v", "$.content")
    inner = F.try_parse_json(text)
    parts = F.when(P.is_array(content), F.try_variant_get(content, "$", "array<variant>")).when(P.is_string(content) & P.is_array(inner), F.try_variant_get(inner, "$", "array<variant>"))
    role = P.text_at("v", "$.role")
    plain = F.when(role == "user", "user").otherwise("assistant")
    said = F.when(parts.isNotNull(), X.flushed_messages(goose_blocks(F.col("parts")), role)).when(P.is_string(content) & inner.isNull() & (text != ""), F.array(X.text_message(plain, text))).otherwise(X.none())
    rows = kept.withColumn("parts", parts).withColumn("ts", P.flexible_timestamp(F.try_variant_get("v", "$.created", variant)))
    messages = X.explode_messages(rows.select(F.lit("goose").alias("source"), "session_id", "file_path", F.col("raw_index").alias("raw_line_index"), "ts", said.alias("messages")))
    head = rows.groupBy("file_path", "session_id").agg(R.first_of(P.truthy(P.text_at("v", "$.working_dir"))).alias("cwd"), R.first_of(F.col("ts")).alias("created_at"))
    last = messages.groupBy("file_path").agg(F.max("ts").alias("updated_at"))
    sessions = head.join(last, "file_path", "left").withColumns({"source": F.lit("goose"), "cwd": F.coalesce("cwd", R.parent()), "model": F.lit(default_model).cast("string")})
    sessions = sessions.join(facts, "file_path", "left") if facts is not None else sessions
    return Ingested(messages, session_table(sessions), None, None, _no_files(head.withColumn("source", F.lit("goose"))))


def ingest_goose_tables(messages: DataFrame, sessions: DataFrame, default_model: str | None = None) -> Ingested:
    """I7, tables: ``messages(session_id, role, content_json, created_timestamp)`` (epoch ms) in order of time."""
    order = Window.partitionBy("session_id").orderBy("created_timestamp", "role", "content_json")
    rows = messages.withColumn("raw_line_index", F.row_number().over(order) - 1).withColumn("v", F.try_parse_json("content_json")).where(P.is_array(F.col("v")))
    rows = rows.withColumn("parts", F.try_variant_get("v", "$", "array<variant>"))
    out = X.explode_messages(rows.select(F.lit("goose").alias("source"), "session_id", F.lit("goose#db").alias("file_path"), "raw_line_index", F.timestamp_millis("created_timestamp").alias("ts"), X.flushed_messages(goose_blocks(F.col("parts")), F.coalesce(P.truthy("role"), F.lit("assistant"))).alias("messages")))
    config = F.try_parse_json("model_config_json")
    base = sessions.select(F.col("id").alias("session_id"), F.lit("goose").alias("source"), F.lit("goose#db").alias("file_path"), F.coalesce("working_dir", F.lit("")).alias("cwd"), P.timestamp_text("created_at").alias("created_at"), P.timestamp_text("updated_at").alias("updated_at"), F.coalesce(P.text_at(config, "$.model"), P.text_at(config, "$.model_id"), F.lit(default_model).cast("string")).alias("model"), F.lit(0).alias("file_bytes"), F.lit(0).alias("raw_line_count"))
    usage = sessions.select(F.col("id").alias("session_id"), F.lit("goose").alias("source"), F.lit(0).alias("line_no"), F.coalesce("input_tokens", F.lit(0)).alias("input"), F.coalesce("output_tokens", F.lit(0)).alias("output"))
    return Ingested(out, session_table(base), usage_table(usage), None, _no_files(base))


def index_goose(lines: DataFrame, facts: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Rows of the sessions table first; files whose id it lacks follow."""
    rows = R.parsed(R.head(lines, "goose"))
    content, inner = F.try_variant_get("v", "$.content", variant), F.try_parse_json(P.text_at("v", "$.content"))
    parts = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.try_variant_get(inner, "$", "array<variant>"))
    text = F.array_join(F.transform(F.filter(parts, lambda p: P.text_at(p, "$.type") == "text"), lambda p: _text(p, "$.text")), " ")
    prompt = F.when(P.text_at("v", "$.role") == "user", P.truthy(P.truncate(P.collapse(text), 120)))
    cwd = P.truthy(P.text_at("v", "$.working_dir"))
    until = rows.groupBy("file_path").agg(F.min(F.when(cwd.isNotNull(), F.col("line_no"))).alias("c"), F.min(F.when(prompt.isNotNull(), F.col("line_no"))).alias("p"))
    until = until.select("file_path", F.greatest(F.coalesce("c", F.lit(1 << 30)), F.coalesce("p", F.lit(1 << 30))).alias("stop"))
    seen = rows.join(until, "file_path").where("line_no <= stop").groupBy("file_path").agg(R.first_of(cwd).alias("cwd"), R.first_of(prompt).alias("summary"), F.max(P.flexible_timestamp(F.try_variant_get("v", "$.created", variant))).alias("head_ts"))
    files = facts.select("file_path", "mtime").join(seen, "file_path", "left").select(R.base_name().alias("id"), F.lit("goose").alias("source"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.greatest("mtime", "head_ts").alias("updated_at"), "summary", "file_path")
    if sessions is None:
        return index_table(files)
    title = P.truthy(P.trim(F.substring(F.coalesce(P.truthy("name"), F.col("description")), 1, 120)))
    known = sessions.select("id", F.lit("goose").alias("source"), F.coalesce("working_dir", F.lit("")).alias("cwd"), P.timestamp_text("updated_at").alias("updated_at"), title.alias("summary"), F.lit("goose#db").alias("file_path"))
    return index_table(known).unionByName(index_table(files.join(known.select("id"), "id", "left_anti")))

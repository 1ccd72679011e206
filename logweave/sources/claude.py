"""Claude-shaped and commandcode JSON lines (I1, I6) and their index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.schemas import KEY
from ..operators import explode as X
from ..operators.ranks import running
from . import readers as R
from .ingest import Ingested, index_table, session_table, usage_table

# Line types that are no conversation.
SKIPPED = ("system", "queue-operation", "file-history-snapshot", "progress", "last-prompt")


def last_per_uuid(rows: DataFrame) -> DataFrame:
    """A message that was written again counts by its last line, at that line's place; lines without an id all stay.

    ``rows`` are narrow: the parsed lines themselves are joined to what stays.
    """
    key = F.coalesce(P.truthy("uuid"), F.concat(F.lit("#"), F.col("line_no").cast("string")))
    others = [c for c in rows.columns if c not in ("file_path", "uuid")]
    last = rows.withColumn("uuid", key).groupBy("file_path", "uuid").agg(F.max(F.struct("line_no", *[c for c in others if c != "line_no"])).alias("last"))
    return last.select("file_path", *[F.col(f"last.{c}").alias(c) for c in others])


def flag(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", path, "boolean"), F.lit(False))


def _counters(assistant: Column) -> Column:
    """The usage of an assistant's line; null without one."""
    at = lambda k: F.coalesce(P.long_at("v", f"$.message.usage.{k}"), F.lit(0)).cast("bigint")
    told = F.struct(at("input_tokens").alias("input"), at("output_tokens").alias("output"), at("cache_read_input_tokens").alias("cache_read"), at("cache_creation_input_tokens").alias("cache_creation"))
    return F.when(assistant & F.try_variant_get("v", "$.message.usage", "variant").isNotNull(), told)


def _usage(rows: DataFrame, source: str) -> DataFrame:
    return usage_table(rows.where("usage is not null").select(F.lit(source).alias("source"), "session_id", "line_no", "usage.*"))


def ingest_claude(lines: DataFrame, facts: DataFrame | None = None) -> Ingested:
    """I1.

    Which line of an id counts, its place and the place of its first message are found on narrow rows (numbers, ids and
    head fields); the parsed lines are joined to them by file and line, and no window or sort of a whole file carries them.
    """
    kind, content = P.text_at("v", "$.type"), F.try_variant_get("v", "$.message.content", "variant")
    text = P.text_at("v", "$.message.content")
    empty = content.isNull() | F.is_variant_null(content) | F.coalesce(text == "", F.lit(False))
    skip = F.coalesce(kind.isin(*SKIPPED), F.lit(False)) | (flag("$.isMeta") & (empty | (P.is_string(content) & P.is_system_injected(F.coalesce(text, F.lit("")))))) | flag("$.isCompactSummary")
    said = F.when(
        kind == "assistant",
        F.when(P.is_string(content), F.when(text != "", F.array(X.text_message("assistant", text))).otherwise(X.none())).otherwise(X.assistant_messages(F.col("blocks"), thinking_content=True)),
    ).when(
        kind == "user",
        F.when(P.is_string(content), F.when(~P.is_blank(text), F.array(X.text_message("user", text))).otherwise(X.none())).otherwise(X.user_messages(F.col("blocks"))),
    )
    blocks = F.when(skip, None).when(kind == "assistant", X.parse_blocks(content)).when(kind == "user", X.parse_blocks(content, keep_injected=False))
    whole = R.once(R.parsed(lines), blocks=blocks).withColumn("messages", F.when(skip, X.none()).otherwise(F.coalesce(said, X.none())))

    at = lambda path: P.truthy(P.text_at("v", path))
    model = F.coalesce(at("$.model"), at("$.message.model"))
    ts = P.timestamp_text(P.text_at("v", "$.timestamp"))
    fields = ["file_path", "line_no", P.text_at("v", "$.uuid").alias("uuid"), at("$.sessionId").alias("sid")]
    told = [at("$.cwd").alias("cwd"), at("$.gitBranch").alias("git_branch"), model.alias("model"), ts.alias("ts"), _counters(kind == "assistant").alias("usage")]
    first = lambda c: R.first_of(F.col(c)).alias(c)
    named = lambda df: df.withColumn("session_id", F.coalesce("sid", R.base_name()))
    # places need the number of messages of each line; sessions and usage are told by the lines' own fields alone
    kept = last_per_uuid(whole.select(*fields, F.size("messages").alias("n")))
    placed = running(kept.select("file_path", "line_no", "n"), ["file_path"], "line_no", {"raw_line_index": F.lit(1)})
    placed = placed.join(named(kept.groupBy("file_path").agg(first("sid"))).select("file_path", F.lit("claude").alias("source"), "session_id"), "file_path").where("n > 0")
    light = last_per_uuid(R.parsed(lines).select(*fields, *told))
    head = named(light.groupBy("file_path").agg(first("sid"), first("cwd"), first("git_branch"), first("model"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))).withColumn("cwd", F.coalesce("cwd", R.parent()))
    placed = running(placed, list(KEY), "raw_line_index", {"first": F.col("n")}, ["file_path"])
    shown = whole.select("file_path", "line_no", ts.alias("ts"), "messages").where(F.size("messages") > 0).join(placed, ["file_path", "line_no"])
    usage = light.where("usage is not null").join(head.select("file_path", "session_id"), "file_path")
    sessions = head.join(facts, "file_path", "left") if facts is not None else head
    return Ingested(X.posed_messages(shown), session_table(sessions.withColumn("source", F.lit("claude"))), _usage(usage, "claude"))


def ingest_commandcode(lines: DataFrame, facts: DataFrame | None = None) -> Ingested:
    """Role and content on the line itself, every line counts, thinking alone has empty content."""
    kept = R.numbered(R.parsed(lines)).withColumn("session_id", R.base_name())
    ts = P.timestamp_text(P.text_at("v", "$.timestamp"))
    role, content, text = P.text_at("v", "$.role"), F.try_variant_get("v", "$.content", "variant"), P.text_at("v", "$.content")
    plain = lambda r: F.when(~P.is_blank(text), F.array(X.text_message(r, text))).otherwise(X.none())
    said = F.when(role == "assistant", F.when(P.is_string(content), plain("assistant")).otherwise(X.assistant_messages(X.parse_blocks(content)))).when(role == "user", F.when(P.is_string(content), plain("user")).otherwise(X.user_messages(X.parse_blocks(content, keep_injected=False))))
    messages = X.explode_messages(kept.select(F.lit("commandcode").alias("source"), "session_id", "file_path", F.col("raw_index").alias("raw_line_index"), ts.alias("ts"), F.coalesce(said, X.none()).alias("messages")))
    at = lambda path: R.first_of(P.truthy(P.text_at("v", path)))
    model = F.coalesce(P.truthy(P.text_at("v", "$.model")), P.truthy(P.text_at("v", "$.message.model")))
    head = kept.groupBy("file_path", "session_id").agg(at("$.cwd").alias("cwd"), at("$.gitBranch").alias("git_branch"), R.first_of(model).alias("model"))
    times = messages.groupBy("file_path").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    folder = F.concat(F.lit("/"), P.decode_path(R.last_name(R.parent())))
    sessions = head.withColumn("cwd", F.coalesce("cwd", folder)).join(times, "file_path", "left").withColumn("source", F.lit("commandcode"))
    sessions = sessions.join(facts, "file_path", "left") if facts is not None else sessions
    return Ingested(messages, session_table(sessions), _usage(kept.withColumn("usage", _counters(role == "assistant")), "commandcode"))


def first_prompt(content: Column) -> Column:
    """The first text of a user content that is not injected."""
    texts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.when(P.text_at(b, "$.type") == "text", P.text_at(b, "$.text"))), lambda t: t.isNotNull() & (t != "") & ~P.is_system_injected(t))
    return F.when(P.is_string(content), F.try_variant_get(content, "$", "string")).otherwise(F.get(texts, 0))


def index_claude(lines: DataFrame, facts: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """From the first 30 lines; ``sidecar(session_id, project_path, modified, first_prompt)`` wins where it has the session."""
    rows = R.parsed(R.head(lines, "claude"))
    prompt = F.when(P.text_at("v", "$.type") == "user", P.clean_prompt(first_prompt(F.try_variant_get("v", "$.message.content", "variant")), no_prompt=True))
    ts = P.timestamp_text(P.text_at("v", "$.timestamp"))
    cwd = P.truthy(P.text_at("v", "$.cwd"))
    # the scan stops with the line at which folder and summary are both known
    until = rows.groupBy("file_path").agg(F.min(F.when(cwd.isNotNull(), F.col("line_no"))).alias("c"), F.min(F.when(prompt.isNotNull(), F.col("line_no"))).alias("p"))
    until = until.select("file_path", F.greatest(F.coalesce("c", F.lit(1 << 30)), F.coalesce("p", F.lit(1 << 30))).alias("stop"))
    seen = rows.join(until, "file_path").where("line_no <= stop").groupBy("file_path").agg(R.first_of(cwd).alias("scan_cwd"), R.first_of(prompt).alias("scan_summary"), F.max(ts).alias("head_ts"))
    out = facts.select("file_path", "mtime").join(seen, "file_path", "left").withColumn("id", R.base_name())
    folder = P.decode_path(R.last_name(R.parent()))
    cwd, when, summary = F.coalesce("scan_cwd", folder), F.greatest("mtime", "head_ts"), F.col("scan_summary")
    if sidecar is not None:
        out = out.join(sidecar.withColumnRenamed("session_id", "id").withColumn("_known", F.lit(True)), "id", "left")
        known = F.coalesce("_known", F.lit(False))
        cwd = F.when(known, F.coalesce(P.truthy("project_path"), folder)).otherwise(cwd)
        when = F.when(known, F.coalesce(P.timestamp_text("modified"), F.timestamp_millis(F.lit(0)))).otherwise(when)
        summary = F.when(known, P.clean_prompt("first_prompt", no_prompt=True)).otherwise(summary)
    return index_table(out.select("id", F.lit("claude").alias("source"), cwd.alias("cwd"), when.alias("updated_at"), summary.alias("summary"), "file_path"))


def index_commandcode(lines: DataFrame, facts: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """Last time of the first 30 lines; ``sidecar(session_id, title)`` wins over the prompt of line 0."""
    rows = R.parsed(R.head(lines, "commandcode"))
    ts = P.timestamp_text(P.text_at("v", "$.timestamp"))
    content = F.try_variant_get("v", "$.content", "variant")
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.when(P.text_at(b, "$.type") == "text", P.truthy(P.text_at(b, "$.text")))), lambda t: t.isNotNull())
    prompt = F.when(P.is_string(content), F.try_variant_get(content, "$", "string")).otherwise(F.substring(F.array_join(parts, " "), 1, 200))
    prompt = F.when((F.col("line_no") == 0) & (P.text_at("v", "$.role") == "user"), P.clean_prompt(prompt))
    seen = rows.groupBy("file_path").agg(R.first_of(prompt).alias("prompt"), R.last_of(ts).alias("head_ts"))
    out = facts.select("file_path", "mtime").join(seen, "file_path", "left").withColumn("id", R.base_name())
    out = out.join(sidecar.select(F.col("session_id").alias("id"), "title"), "id", "left") if sidecar is not None else out.withColumn("title", F.lit(None).cast("string"))
    return index_table(out.select("id", F.lit("commandcode").alias("source"), F.concat(F.lit("/"), P.decode_path(R.last_name(R.parent()))).alias("cwd"), F.coalesce("head_ts", "mtime").alias("updated_at"), F.coalesce(P.truthy("title"), F.col("prompt")).alias("summary"), "file_path"))

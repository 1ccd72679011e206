"""Codex event lines (I2) and their index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.schemas import KEY
from ..operators import explode as X
from ..operators.ranks import running
from ..operators.stats import usage_deltas
from ..scratch import written
from . import readers as R
from .ingest import Ingested, index_table, session_table, usage_table

CALLS = ("function_call", "custom_tool_call", "web_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")


def joined_texts(path: str, kind: str | None) -> Column:
    """Trimmed texts of an array's parts of one type, joined by lines."""
    def one(p: Column) -> Column:
        text = P.truthy(P.trim(P.text_at(p, "$.text")))
        return text if kind is None else F.when(P.text_at(p, "$.type") == kind, text)
    parts = F.try_variant_get("v", path, "array<variant>")
    return F.coalesce(F.array_join(F.filter(F.transform(parts, one), lambda t: t.isNotNull()), "\n"), F.lit(""))


def raw_usage(path: str) -> Column:
    """Counters of a usage object, absent ones 0; null without the object."""
    at = lambda k: F.coalesce(P.long_at("v", f"{path}.{k}"), F.lit(0).cast("bigint"))
    cached = F.when(F.try_variant_get("v", f"{path}.cached_input_tokens", "variant").isNotNull(), at("cached_input_tokens")).otherwise(at("cache_read_input_tokens"))
    return F.when(P.is_object(F.try_variant_get("v", path, "variant")), F.struct(at("input_tokens").alias("input"), cached.alias("cached"), at("output_tokens").alias("output")))


def _told(lines: DataFrame) -> DataFrame:
    """What each line tells by itself, parsed once: head fields, messages of an item or an event, counters and patched files.

    An item that lacks a call id has none in its blocks either and is marked ``unnamed``.
    """
    kind, ptype, prole = P.text_at("v", "$.type"), P.text_at("v", "$.payload.type"), P.text_at("v", "$.payload.role")
    rows = R.once(R.parsed(lines), kind=kind, ptype=ptype, prole=F.coalesce(prole, F.lit("")))
    rows = R.once(rows, text=joined_texts("$.payload.content", "output_text"), said=joined_texts("$.payload.content", "input_text"), summary=joined_texts("$.payload.summary", None))
    kind, ptype, prole, text, said, summary = (F.col(c) for c in ("kind", "ptype", "prole", "text", "said", "summary"))
    meta, counts, is_item = kind == "session_meta", (kind == "event_msg") & (ptype == "token_count"), F.coalesce(kind == "response_item", F.lit(False))
    field = lambda path: F.when(meta, P.truthy(P.text_at("v", path)))
    model = F.when(kind == "turn_context", P.model_of("v", "$.payload")).when(counts, F.coalesce(P.model_of("v", "$.payload.info"), P.model_of("v", "$.payload")))
    one = lambda good, m: F.when(good, F.array(m)).otherwise(X.none())
    spoken = F.when(prole == "user", one((said != "") & ~P.is_bootstrap(said), X.text_message("user", said))).when(prole == "system", one(text != "", X.text_message("system", text))).otherwise(one(text != "", X.text_message("assistant", text)))
    thought = one(summary != "", X.message("assistant", summary, F.array(X.block("thinking", text=summary))))
    at = lambda k: F.try_variant_get("v", f"$.payload.{k}", "variant")
    some = lambda k: F.when(~F.is_variant_null(at(k)), at(k))
    call_id = P.truthy(P.text_at("v", "$.payload.call_id"))
    name = F.coalesce(P.truthy(P.text_at("v", "$.payload.name")), F.when(ptype == "web_search_call", "web_search"), F.lit("unknown"))
    raw_input = F.coalesce(P.text_at("v", "$.payload.input"), F.lit(""))
    args = F.when(ptype == "function_call", P.object_or_empty(at("arguments"))).when(ptype == "custom_tool_call", F.to_json(F.struct(P.truncate_single_line(raw_input, 300).alias("input")))).otherwise(P.object_or_empty(F.coalesce(some("arguments"), some("input"), some("query"))))
    use_id = F.coalesce(call_id, P.truthy(P.text_at("v", "$.payload.id")))
    used = F.array(X.tool_message(X.block("tool_use", id=use_id, name=name, input_json=F.coalesce(args, F.lit("{}")))))
    output = at("output")
    whole = F.when(P.is_string(output), P.text_at("v", "$.payload.output")).when(output.isNull() | F.is_variant_null(output), "").otherwise(F.to_json(output))
    preview = F.when(output.isNull() | F.is_variant_null(output), "").otherwise(P.preview_output(output))
    result_block = X.block("tool_result", tool_use_id=call_id, content=whole, is_error=P.tool_error(whole))
    result = F.array(X.message("tool_result", F.coalesce(P.truthy(preview), whole), F.array(result_block)))
    item = F.when(is_item, F.when(prole == "developer", X.none()).when(ptype == "message", spoken).when(ptype == "reasoning", thought).when(ptype.isin(*CALLS), used).when(ptype.isin(*OUTPUTS), result))
    note = F.coalesce(P.text_at("v", "$.payload.message"), F.lit(""))
    event = F.when(kind == "event_msg", F.when(ptype == "user_message", one((note != "") & ~P.is_bootstrap(note), X.text_message("user", note))).when(ptype.isin("agent_message", "assistant_message"), one(note != "", X.text_message("assistant", note))))
    patch = F.when(ptype == "custom_tool_call", raw_input).otherwise(P.text_at(F.try_parse_json(args), "$.input"))
    patched = F.when(is_item & ptype.isin(*CALLS) & (name == "apply_patch") & (prole != "developer"), P.patch_files(patch))
    last, total = raw_usage("$.payload.info.last_token_usage"), raw_usage("$.payload.info.total_token_usage")
    return rows.select(
        "file_path", "line_no", P.timestamp_text(P.text_at("v", "$.timestamp")).alias("own_ts"), is_item.alias("is_item"),
        field("$.payload.id").alias("sid"), field("$.payload.cwd").alias("cwd"), field("$.payload.git.branch").alias("git_branch"), field("$.payload.git.repository_url").alias("git_repo"), model.alias("model"),
        F.coalesce(item, event, X.none()).alias("messages"), (is_item & F.when(ptype.isin(*CALLS), use_id.isNull()).otherwise(call_id.isNull())).alias("unnamed"),
        F.coalesce(counts, F.lit(False)).alias("counts"), F.when(counts, last).alias("last"), F.when(counts, total).alias("total"), patched.alias("patched"),
    ).withColumn("n", F.size("messages"))


def _with_call_ids(messages: Column, fallback: Column) -> Column:
    """Tool blocks without an id get ``fallback``."""
    def named(b: Column) -> Column:
        own = lambda field, kind: F.when(b["type"] == kind, F.coalesce(b[field], fallback)).otherwise(b[field])
        return b.withField("id", own("id", "tool_use")).withField("tool_use_id", own("tool_use_id", "tool_result"))
    return F.transform(messages, lambda m: m.withField("blocks", F.transform(m["blocks"], named)))


def ingest_codex(lines: DataFrame, facts: DataFrame | None = None) -> Ingested:
    """I2.

    The lines are read and parsed once, when this is called: what they tell is written to the shared folder, and every table
    reads the columns that it needs. Places are found on narrow rows; messages are joined to them by file and line.
    """
    told = written(_told(lines), "codex")
    last = lambda c: R.last_of(F.col(c)).alias(c)
    head = told.groupBy("file_path").agg(*[last(c) for c in ("sid", "cwd", "git_branch", "git_repo", "model")], F.min("own_ts").alias("created_at"), F.max("own_ts").alias("updated_at"), F.max("is_item").alias("has_items"))
    head = head.withColumn("session_id", F.coalesce("sid", P.file_id("file_path"))).withColumn("cwd", F.coalesce("cwd", F.lit(""))).withColumn("source", F.lit("codex"))

    placed = running(told.select("file_path", "line_no", "is_item", "n"), ["file_path"], "line_no", {"raw_line_index": F.lit(1)})
    placed = placed.where("n > 0").join(head.select("source", "session_id", "file_path", "has_items", "updated_at"), "file_path").where("is_item or not has_items")
    placed = running(placed.drop("is_item", "has_items"), list(KEY), "raw_line_index", {"first": F.col("n")}, ["file_path"]).drop("n")
    shown = told.where("n > 0").select("file_path", "line_no", "own_ts", "unnamed", "messages").join(placed, ["file_path", "line_no"])
    fallback = F.concat(F.lit("call_"), F.col("raw_line_index").cast("string"))
    shown = shown.withColumns({"ts": F.coalesce("own_ts", "updated_at"), "messages": F.when(F.col("unnamed"), _with_call_ids(F.col("messages"), fallback)).otherwise(F.col("messages"))})

    names = head.select("source", "session_id", "file_path")
    usage = usage_table(usage_deltas(told.where("counts").select("file_path", "line_no", "last", "total").join(names, "file_path")))
    patched = told.select("file_path", "line_no", F.posexplode("patched").alias("at", "f")).join(names, "file_path")
    firsts = patched.groupBy("session_id", "f").agg(F.min(F.struct("line_no", "at")).alias("first"))
    files = firsts.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("first", "f"))).alias("t")).select(F.lit("codex").alias("source"), "session_id", F.col("t.f").alias("files_modified"))
    ms = F.unix_millis("updated_at") - F.unix_millis("created_at")
    durations = head.select("source", "session_id", F.when(ms > 0, ms).alias("duration_ms"))
    sessions = head.join(facts, "file_path", "left") if facts is not None else head
    return Ingested(X.posed_messages(shown), session_table(sessions), usage, durations, files)


def index_codex(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """A file counts only if its physical line 0 is session metadata; first user text of 50 lines."""
    rows = R.parsed(R.head(lines, "codex"))
    kind, ptype = P.text_at("v", "$.type"), P.text_at("v", "$.payload.type")
    first = (F.col("line_no") == 0) & (kind == "session_meta")
    said = joined_texts("$.payload.content", "input_text")
    text = F.when((kind == "response_item") & (ptype == "message") & (P.text_at("v", "$.payload.role") == "user"), P.truthy(said)).when((kind == "event_msg") & (ptype == "user_message"), P.text_at("v", "$.payload.message"))
    summary = F.when((F.col("line_no") > 0) & ~P.is_bootstrap(text), P.truthy(P.truncate(P.collapse(text), 120)))
    time = F.when(F.col("line_no") > 0, P.timestamp_text(P.text_at("v", "$.timestamp")))
    at = lambda path: F.max(F.when(first, P.truthy(P.text_at("v", path))))
    seen = rows.groupBy("file_path").agg(F.max(first).alias("good"), at("$.payload.id").alias("sid"), at("$.payload.cwd").alias("cwd"), F.max(time).alias("head_ts"), R.first_of(summary).alias("summary"))
    out = seen.where("good").join(facts.select("file_path", "mtime"), "file_path")
    return index_table(out.select(F.coalesce("sid", P.file_id("file_path")).alias("id"), F.lit("codex").alias("source"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.greatest("mtime", "head_ts").alias("updated_at"), "summary", "file_path"))

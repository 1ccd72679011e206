"""Compact context for a hand-over (E6: F6, W3, A13, A14, P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.schemas import KEY
from .slicing import slice_sessions
from .stats import exploded

#: The most active files of a context, and characters of the current task.
ACTIVE_FILES, TASK_CHARS = 50, 500


def context_messages(messages: DataFrame, include_system: bool = False, include_tool_results: bool = False) -> DataFrame:
    """F6."""
    hidden = [r for r, shown in (("system", include_system), ("tool_result", include_tool_results)) if not shown]
    return messages.where(~F.col("role").isin(*hidden)) if hidden else messages


def active_files(messages: DataFrame, most: int = ACTIVE_FILES) -> DataFrame:
    """Distinct ``file_path``, else ``path`` arguments of all tool uses, in first-seen order."""
    args = F.try_parse_json("input_json")
    given = F.try_variant_get(args, "$.file_path", "variant")
    path = F.when(given.isNotNull() & ~F.is_variant_null(given), P.text_at(args, "$.file_path")).otherwise(P.text_at(args, "$.path"))
    files = exploded(messages).where("type = 'tool_use'").select(*KEY, "idx", "bpos", path.alias("f")).where("f is not null")
    first = files.groupBy(*KEY, "f").agg(F.min(F.struct("idx", "bpos")).alias("first"))
    return first.groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_list(F.struct("first", "f"))), 1, most).alias("t")).select(*KEY, F.col("t.f").alias("active_files"))


def current_task(messages: DataFrame, most: int = TASK_CHARS) -> DataFrame:
    """The last user message, cut."""
    return messages.where("role = 'user'").groupBy(*KEY).agg(F.substring(F.max_by("content", "idx"), 1, most).alias("current_task"))


def export_context(messages: DataFrame, budget: int = 8000, include_system: bool = False, include_tool_results: bool = False, format: str = "messages", sessions: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """One row a session: messages (or summaries) of its tail slice, active files, current task, token estimate."""
    listed = context_messages(messages, include_system, include_tool_results)
    chosen = slice_sessions(listed, budget, "tail").select(*KEY, "idx", "full_cost")
    kept = listed.select(*KEY, "idx", "role", "content").join(chosen, [*KEY, "idx"])
    text = P.summarize("content", 200) if format == "summary" else F.col("content")
    rows = kept.groupBy(*KEY).agg(F.sum("full_cost").alias("token_count_estimate"), F.sort_array(F.collect_list(F.struct("idx", "role", text.alias("content")))).alias("t"))
    packed = rows.select(*KEY, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("summary" if format == "summary" else "content"))).alias("messages"), "token_count_estimate")
    every = messages.select(*KEY).distinct()
    out = every.join(packed, list(KEY), "left").join(active_files(messages), list(KEY), "left").join(current_task(messages), list(KEY), "left")
    if sessions is not None:
        out = out.join(sessions.select(*KEY, "model", "cwd", "git_branch"), list(KEY), "left")
    return out.withColumn("active_files", F.coalesce("active_files", F.array().cast("array<string>"))).withColumn("token_count_estimate", F.coalesce("token_count_estimate", F.lit(0).cast("bigint")))

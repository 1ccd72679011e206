"""Comparisons: session diffs, new messages and changed sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import etag
from ..functions.schemas import KEY
from .slicing import costed, ranked, trim_to_assistant, within_budget


def diff_sessions(pairs: DataFrame, stats: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """J6 over ``pairs(a, b)`` of session ids: tools and files only in a, only in b, in both; facts of both.

    Where sources share an id, ``pairs`` may name the sources too (``a_source``, ``b_source``); then only those sessions are compared.
    """
    facts = stats.select("session_id", "source", "total_messages", "token_usage", F.col("tool_frequency.name").alias("tools"), F.col("files_modified").alias("files"))
    if sessions is not None:
        facts = facts.join(sessions.select("session_id", "source", "model", "created_at"), ["session_id", "source"], "left")
    side = lambda s: facts.select(*[F.col(c).alias(s if c == "session_id" else f"{s}_{c}") for c in facts.columns])
    on = lambda s: [s, f"{s}_source"] if f"{s}_source" in pairs.columns else s
    both = pairs.join(side("a"), on("a")).join(side("b"), on("b"))
    for what in ("tools", "files"):
        x, y = f"a_{what}", f"b_{what}"
        both = both.withColumns({f"{what}_only_a": F.array_except(x, y), f"{what}_only_b": F.array_except(y, x), f"{what}_both": F.array_intersect(x, y)})
    return both.drop("a_tools", "b_tools", "a_files", "b_files")


def new_messages(messages: DataFrame, snapshot: DataFrame, tail_budget: int | None = None) -> DataFrame:
    """Messages beyond the ``snapshot(source, session_id, n_before)`` counts; sessions it lacks return all. Optionally their tail slice."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("idx"))
    fresh = messages.withColumn("_p", place).join(snapshot, list(KEY), "left").where(F.col("_p") > F.coalesce("n_before", F.lit(0))).drop("_p", "n_before")
    if tail_budget is None:
        return fresh
    chosen = trim_to_assistant(within_budget(ranked(costed(fresh), "tail"), tail_budget))
    return fresh.join(chosen.select(*KEY, "idx"), [*KEY, "idx"], "left_semi")


def etags(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """P25 of each session, from ``updated_at`` and ``total_messages``."""
    return sessions.select(*KEY, "updated_at").join(counts.select(*KEY, "total_messages"), list(KEY)).select(*KEY, etag("updated_at", "total_messages").alias("etag"))


def changed_sessions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of (key, etag) that an earlier snapshot does not have."""
    return now.join(before.select(*KEY, "etag"), [*KEY, "etag"], "left_anti")

"""Rendered transcripts and JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.presets import Preset, preset
from ..functions.schemas import KEY


def render_transcripts(messages: DataFrame, p: str | Preset = "standard") -> DataFrame:
    """One text a session; slice first, as contents are collected."""
    rows = messages.select(*KEY, "idx", P.render_message(preset(p)).alias("t"))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n\n").alias("transcript"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def message_record(kind: bool = False, all_blocks: bool = False) -> Column:
    """One message as a struct; in an envelope blocks are left out for empty content or a single text block."""
    shown = F.lit(True) if all_blocks else (F.size("blocks") > 0) & (F.col("content") != "") & ~((F.size("blocks") == 1) & (F.col("blocks")[0]["type"] == "text"))
    first = [F.lit("message").alias("type")] if kind else []
    return F.struct(*first, F.col("idx").alias("index"), "role", _stamp("ts").alias("timestamp"), P.message_tokens("blocks").alias("tokens_estimate"), "content", F.when(shown, F.col("blocks")).alias("blocks"))


def envelopes(messages: DataFrame, meta: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """One JSON object a session: api_version, session, meta, messages."""
    packed = messages.select(*KEY, "idx", message_record().alias("m")).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("idx", F.to_json("m").alias("m")))).alias("t"))
    told = meta.select(*KEY, F.to_json(F.struct(*meta.columns)).alias("meta"))
    out = packed.join(told, list(KEY))
    if info is not None:
        out = out.join(info.select(*KEY, F.to_json(F.struct(*info.columns)).alias("session")), list(KEY), "left")
    session = F.concat(F.lit('"session":'), F.col("session"), F.lit(",")) if info is not None else F.lit("")
    texts = F.array_join(F.transform("t", lambda x: x["m"]), ",")
    return out.select(*KEY, F.concat(F.lit('{"api_version":1,'), F.coalesce(session, F.lit("")), F.lit('"meta":'), "meta", F.lit(',"messages":['), texts, F.lit("]}")).alias("json"))


def jsonl_lines(messages: DataFrame, meta: DataFrame) -> DataFrame:
    """(key, line_no, value): line 0 is the session's meta record, then one record a message."""
    head = meta.select(*KEY, F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit("meta").alias("type"), *meta.columns)).alias("value"))
    rest = messages.select(*KEY, F.col("idx").alias("line_no"), F.to_json(message_record(kind=True, all_blocks=True)).alias("value"))
    return head.unionByName(rest)

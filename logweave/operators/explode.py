"""Explosion of block arrays into messages (X1-X4), on array functions; rows are made by one ``posexplode``.

Input rows carry ``blocks`` in the normalised struct, already filtered by the source's rules. A group is a running
count of the blocks that flush pending text; inside a group the rules say what comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.schemas import BLOCK, BLOCKS, KEY
from .ranks import running

MESSAGE = f"struct<role:string,content:string,blocks:{BLOCKS}>"


def block(type: str, *, text=None, id=None, name=None, input_json=None, tool_use_id=None, content=None, is_error=None) -> Column:  # noqa: A002
    values = {"type": F.lit(type), "text": text, "id": id, "name": name, "input_json": input_json, "tool_use_id": tool_use_id, "content": content, "is_error": is_error}
    return F.struct(*[(v if v is not None else F.lit(None)).cast("boolean" if k == "is_error" else "string").alias(k) for k, v in values.items()])


def message(role: Column | str, content: Column, blocks: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), blocks.cast(BLOCKS).alias("blocks")).cast(MESSAGE)


def text_message(role: Column | str, text: Column) -> Column:
    return message(role, text, F.array(block("text", text=text)))


def none() -> Column:
    return F.array().cast(f"array<{MESSAGE}>")


def tool_message(b: Column, unknown: str = "unknown") -> Column:
    return message("tool_use", F.concat(F.lit("Tool: "), F.coalesce(P.truthy(b["name"]), F.lit(unknown))), F.array(b))


def result_message(b: Column) -> Column:
    return message("tool_result", b["content"], F.array(b))


def _prose(b: Column) -> Column:
    return b["type"].isin("text", "thinking")


def _flushed(role: Column | str, pending: Column, thinking_content: bool) -> Column:
    """The message of collected text and thinking blocks: contents are the texts; thinking alone may stand in."""
    texts = F.transform(F.filter(pending, lambda b: b["type"] == "text"), lambda b: b["text"])
    joined = F.array_join(texts, "\n")
    if thinking_content:
        thought = F.concat(F.lit("[thinking] "), F.substring(F.get(F.filter(pending, lambda b: b["type"] == "thinking"), 0)["text"], 1, 200))
        joined = F.coalesce(P.truthy(joined), thought, F.lit(""))
    return message(role, joined, pending)


def _groups(blocks: Column, flushes, role: Column | str, thinking_content: bool) -> Column:
    """Messages of a block array.

    Cuts are the places of flushing blocks. Group 0 is what stands before the first cut; group k begins at cut k.
    """
    n = F.size(blocks)
    cuts = F.filter(F.transform(blocks, lambda b, i: F.when(flushes(b), i)), lambda i: i.isNotNull())

    def part(piece: Column) -> Column:
        tools = F.transform(F.filter(piece, lambda b: b["type"] == "tool_use"), lambda b: tool_message(b))
        results = F.transform(F.filter(piece, lambda b: b["type"] == "tool_result"), result_message)
        text = P.let(F.filter(piece, _prose), lambda prose: F.when(F.size(prose) > 0, F.array(_flushed(role, prose, thinking_content))).otherwise(none()))
        return F.concat(tools, results, text)

    spans = P.let(cuts, lambda at: F.arrays_zip(F.concat(F.array(F.lit(0)), at).alias("a"), F.concat(at, F.array(n)).alias("b")))
    pieces = F.transform(spans, lambda s: F.slice(blocks, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.flatten(F.transform(pieces, part))).otherwise(none())


def assistant_messages(blocks: Column, thinking_content: bool = False) -> Column:
    """A tool_use flushes the text before it; a tool_result does not, so it comes before pending text."""
    return _groups(blocks, lambda b: b["type"] == "tool_use", "assistant", thinking_content)


def user_messages(blocks: Column) -> Column:
    """Each tool_result first, in order; then one user message of all texts."""
    results = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), result_message)
    texts = F.filter(blocks, lambda b: b["type"] == "text")
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), "\n")
    return F.concat(results, F.when(F.size(texts) > 0, F.array(message("user", joined, texts))).otherwise(none()))


def flushed_messages(blocks: Column, role: Column) -> Column:
    """tool_use and tool_result both flush; any role but user and assistant becomes system."""
    mapped = F.when(role.isin("user", "assistant"), role).otherwise("system")
    return _groups(blocks, lambda b: b["type"].isin("tool_use", "tool_result"), mapped, False)


def explode_messages(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Rows of (source, session_id, file_path, raw_line_index, ts) and an array of messages -> the messages table, indexed."""
    placed = running(rows.select("source", "session_id", "file_path", "raw_line_index", "ts", F.col(messages).alias("messages")), list(KEY), "raw_line_index", {"first": F.size("messages")}, ["file_path"])
    return posed_messages(placed)


def posed_messages(rows: DataFrame) -> DataFrame:
    """X4 of rows that know how many messages of the session stand before them (``first``)."""
    flat = rows.select("source", "session_id", "file_path", "raw_line_index", "ts", "first", F.posexplode("messages").alias("sub", "m"))
    return flat.select("source", "session_id", "file_path", (F.col("first") + F.col("sub") + 1).cast("int").alias("idx"), F.col("m.role").alias("role"), "ts", F.col("m.content").alias("content"), F.col("m.blocks").alias("blocks"), F.col("raw_line_index").cast("int").alias("raw_line_index"))


def parse_blocks(v: Column, keep_injected: bool = True) -> Column:
    """Normalised blocks of a variant array of claude-shaped blocks; blank texts and unknown types are left out.

    With ``keep_injected`` false, injected texts are left out too (user content).
    """
    at = lambda b, path: F.try_variant_get(b, path, "variant")

    def raw(b: Column) -> Column:
        texts = [P.text_at(b, f"$.{k}").alias(k) for k in ("type", "text", "thinking", "id", "name", "tool_use_id")]
        return F.struct(*texts, at(b, "$.input").alias("input"), at(b, "$.content").alias("content"), F.try_variant_get(b, "$.is_error", "boolean").alias("is_error"))

    def one(r: Column) -> Column:
        text = lambda k: F.coalesce(r[k], F.lit(""))
        kind, thought = r["type"], F.coalesce(P.truthy(r["thinking"]), r["text"], F.lit(""))
        good_text = ~P.is_blank(r["text"]) & (F.lit(True) if keep_injected else ~P.is_system_injected(text("text")))
        return (
            F.when((kind == "text") & good_text, block("text", text=text("text")))
            .when((kind == "thinking") & ~P.is_blank(thought), block("thinking", text=thought))
            .when(kind == "tool_use", block("tool_use", id=text("id"), name=text("name"), input_json=F.coalesce(F.to_json(r["input"]), F.lit("{}"))))
            .when(kind == "tool_result", block("tool_result", tool_use_id=text("tool_use_id"), content=F.coalesce(P.tool_result_text(r["content"]), F.lit("")), is_error=F.coalesce(r["is_error"], F.lit(False))))
        )

    return F.filter(F.transform(F.transform(F.try_variant_get(v, "$", "array<variant>"), raw), one), lambda b: b.isNotNull()).cast(f"array<{BLOCK}>")

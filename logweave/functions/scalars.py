"""Projections over text, blocks and timestamps (P1-P26), as Column functions.

Lengths count UTF-16 units (``u16len``); cuts count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presets import Preset

#: White space as the sources trim it: ASCII and Unicode.
WS_CHARS = " \t\n\u000b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Prefixes of injected and bootstrap texts.
INJECTED = ("<environment_context>", "<system-reminder>", "<permissions", "<context_window", "<user_instructions>")
BOOTSTRAP = ("<user_instructions>", "<environment_context>", "<permissions", "# AGENTS.md")
ERROR_PREFIXES = ("Error:", "FAILED")
#: Cut of a one-line tool output preview.
PREVIEW = 500


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column) -> Column:
    """A string unless it is empty."""
    return F.nullif(col(c), F.lit(""))


def trim(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def ltrim(c: str | Column) -> Column:
    return F.ltrim(col(c), F.lit(WS_CHARS))


def is_blank(c: str | Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(trim(c) == "", F.lit(True))


def collapse(c: str | Column) -> Column:
    """Runs of white space as one space; a pattern that looks at single spaces only is many times faster than the class."""
    return F.trim(F.regexp_replace(F.translate(col(c), WS_CHARS, " " * len(WS_CHARS)), "  +", " "))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def u16len(c: str | Column) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("bigint")


def starts_with_any(c: Column, prefixes) -> Column:
    found = F.startswith(c, F.lit(prefixes[0]))
    for p in prefixes[1:]:
        found |= F.startswith(c, F.lit(p))
    return F.coalesce(found, F.lit(False))


def is_system_injected(c: str | Column) -> Column:
    """P2."""
    return starts_with_any(ltrim(c), INJECTED)


def is_bootstrap(c: str | Column) -> Column:
    """P3."""
    return starts_with_any(trim(c), BOOTSTRAP)


def clean_prompt(c: str | Column, no_prompt: bool = False) -> Column:
    """Without reminder blocks and tags, on one line, cut at 120; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"(?s)<system-reminder>.*?</system-reminder>", ""), r"<[^>]+>", "")
    clean = truthy(F.substring(collapse(text), 1, 120))
    return F.when(col(c) == "No prompt", None).otherwise(clean) if no_prompt else clean


def truncate(c: str | Column, most: int | None) -> Column:
    """P5: whole if it fits; else cut, with three dots where there is room for them."""
    if most is None:
        return col(c)
    cut = F.substring(col(c), 1, most) if most <= 3 else F.concat(F.substring(col(c), 1, most - 3), F.lit("..."))
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(cut)


def truncate_single_line(c: str | Column, most: int) -> Column:
    """On one line, cut with an ellipsis."""
    return let(collapse(c), lambda one: F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one))


def summarize(c: str | Column, most: int = 200) -> Column:
    """200 characters in a context, 60 in a skeleton, and three dots if longer."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def user_text(c: str | Column) -> Column:
    """Without query tags and attachment blocks; images become a mark."""
    text = F.regexp_replace(col(c), r"</?user_query>", "")
    text = F.regexp_replace(text, r"(?s)<attached_files>.*?</attached_files>", "")
    text = F.regexp_replace(text, r"(?s)<image_files>.*?</image_files>", "[image]")
    return trim(text)


def attached_files(c: str | Column) -> Column:
    """Paths of the attachment blocks, in order."""
    inside = F.array_join(F.regexp_extract_all(col(c), F.lit(r"(?s)<attached_files>(.*?)</attached_files>"), F.lit(1)), "\n")
    return F.regexp_extract_all(inside, F.lit(r'path="([^"]+)"'), F.lit(1))


def user_request(c: str | Column) -> Column:
    """What follows the last rule block, up to environment and steering tags; null without such a block."""
    rest = trim(F.substring_index(col(c), "</user-rule>", -1))
    rest = trim(F.substring_index(rest, "<EnvironmentContext>", 1))
    rest = trim(F.substring_index(rest, "<steering-reminder>", 1))
    return F.when(F.contains(col(c), F.lit("</user-rule>")), truthy(rest))


def clean_title(c: str | Column) -> Column:
    """A title without tagged parts, tags and included rules, on one line, cut at 120."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"(?s)<[^>]+>.*?</[^>]+>", ""), r"<[^>]+>", "")
    text = F.regexp_replace(text, r"(?s)## Included Rules.*", "")
    return truthy(F.substring(collapse(text), 1, 120))


def is_system_prompt(c: str | Column) -> Column:
    """P9."""
    return starts_with_any(col(c), ("<identity>", "# "))


def patch_files(c: str | Column) -> Column:
    """Files of a patch, distinct in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"\*{3}[ \t]+(?:Add|Update|Delete)[ \t]+File:[ \t]+([^\n\r]+)"), F.lit(1)), trim), lambda x: x != ""))


def tool_error(c: str | Column) -> Column:
    """P12."""
    return starts_with_any(col(c), ERROR_PREFIXES)


def is_object(v: Column) -> Column:
    """Whether a variant is a JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def text_at(v: str | Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none or it is no string."""
    at = F.try_variant_get(col(v), path, "variant")
    return F.when(is_string(at), F.try_variant_get(col(v), path, "string"))


def long_at(v: str | Column, path: str) -> Column:
    """The number at a path; null if it is none (a numeric text is none)."""
    at = F.try_variant_get(col(v), path, "variant")
    return F.when(~is_string(at), F.try_variant_get(col(v), path, "bigint"))


def object_or_empty(v: Column) -> Column:
    """JSON text of a variant that is an object, or of a text that holds one; else ``{}``."""
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(is_object(v), F.to_json(v)).when(is_string(v) & is_object(inner), F.to_json(inner)).otherwise("{}")


def model_of(v: str | Column, path: str = "$") -> Column:
    """Model or model_name of an object, else of its ``info``, else of its ``metadata``, and so on to any depth.

    A stack of values is worked off, the next one first, in as many steps as the JSON text names the two fields, plus one. A
    step takes a value's fields apart at once; one that is no object has none.
    """
    kind = "struct<found:string,stack:array<variant>>"
    fields = "struct<model:variant,model_name:variant,info:variant,metadata:variant>"

    def further(top: Column, rest: Column) -> Column:
        told = F.coalesce(truthy(trim(text_at(top["model"], "$"))), truthy(trim(text_at(top["model_name"], "$"))))
        inner = F.filter(F.array(top["info"], top["metadata"]), lambda x: x.isNotNull())
        return F.struct(told.alias("found"), F.concat(inner, rest).alias("stack")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        top = F.try_variant_get(F.get(s["stack"], F.lit(0)), "$", fields)
        return F.when(s["found"].isNotNull() | (F.size(s["stack"]) == 0), s).otherwise(let(top, lambda t: further(t, F.slice(s["stack"], 2, F.size(s["stack"])))))

    def search(root: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("found"), F.array(root).alias("stack")).cast(kind)
        steps = F.size(F.split(F.to_json(root), '"(?:info|metadata)"'))
        return F.when(root.isNotNull(), F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["found"]))

    return let(F.try_variant_get(col(v), path, "variant"), search)


def tool_result_text(v: Column) -> Column:
    """A string as it is, the texts of an array's text parts joined by lines, else ''."""
    parts = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda p: (F.try_variant_get(p, "$.type", "string") == "text") & (F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")) != ""))
    joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    return F.when(is_string(v), F.try_variant_get(v, "$", "string")).when(is_array(v), joined).otherwise("")


def preview_output(v: Column) -> Column:
    """P10: a string ``output`` inside JSON text, JSON of other values, else the text; on one line of 500."""
    text = F.try_variant_get(v, "$", "string")
    inner = F.try_parse_json(text)
    value = F.when(is_string(v), F.when(is_object(inner), F.coalesce(text_at(inner, "$.output"), text)).otherwise(text)).otherwise(F.to_json(v))
    return F.coalesce(truncate_single_line(trim(value), PREVIEW), F.lit(""))


def decode_path(c: str | Column) -> Column:
    """A folder name with dashes for slashes."""
    return F.translate(col(c), "-", "/")


def decode_base64(c: str | Column) -> Column:
    """Url-safe or plain base64 without padding, as text; null if it can't be decoded."""
    plain = F.translate(col(c), "-_", "+/")
    padded = F.concat(F.regexp_replace(plain, "=+$", ""), F.expr("repeat('=', 0)"))
    missing = F.pmod(-F.length(padded), F.lit(4))
    return F.try_to_binary(F.concat(padded, F.repeat(F.lit("="), missing)), F.lit("base64")).cast("string")


def file_id(path: str | Column) -> Column:
    """The id of a rollout file's name, else the name without its ending."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    rollout = F.regexp_extract(name, r"rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-(.+)\.jsonl$", 1)
    return F.coalesce(truthy(rollout), F.regexp_replace(name, r"\.[A-Za-z]+$", ""))


def timestamp_text(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c))


def flexible_timestamp(v: Column) -> Column:
    """ISO text or epoch milliseconds in a variant."""
    return F.coalesce(F.when(is_string(v), F.try_to_timestamp(F.try_variant_get(v, "$", "string"))), F.when(~is_string(v), F.timestamp_millis(F.try_variant_get(v, "$", "bigint"))))


def estimate_tokens(c: str | Column) -> Column:
    """A quarter of the length, rounded up; 0 for null."""
    return F.coalesce(F.ceil(u16len(c) / 4), F.lit(0)).cast("bigint")


def _quarter(length: Column) -> Column:
    return F.coalesce(F.ceil(length / 4), F.lit(0)).cast("bigint")


def _capped(c: Column, most: int | None) -> Column:
    return u16len(c) if most is None else F.least(u16len(c), F.lit(most))


def block_tokens(b: Column, p: Preset | None) -> Column:
    """Cost of one block; with a preset, of what it shows of the block."""
    kind = b["type"]
    if p is None:
        return (
            F.when(kind.isin("text", "thinking"), estimate_tokens(b["text"]))
            .when(kind == "tool_use", estimate_tokens(b["name"]) + estimate_tokens(b["input_json"]))
            .when(kind == "tool_result", estimate_tokens(b["content"]))
            .otherwise(0)
            .cast("bigint")
        )
    zero = F.lit(0).cast("bigint")
    return (
        F.when(kind == "text", _quarter(_capped(b["text"], p.content)))
        .when(kind == "thinking", _quarter(_capped(b["text"], p.thinking)) if p.show_thinking else zero)
        .when(kind == "tool_use", estimate_tokens(b["name"]) + (_quarter(_capped(b["input_json"], p.tool_input)) if p.show_args else zero))
        .when(kind == "tool_result", _quarter(_capped(b["content"], p.tool_result)) if p.show_results else zero)
        .otherwise(zero)
        .cast("bigint")
    )


def message_tokens(blocks: str | Column = "blocks", p: Preset | None = None) -> Column:
    """P19, and P20 with a preset: 4 and the cost of each block."""
    return F.aggregate(F.coalesce(col(blocks), F.array().cast("array<struct<type:string,text:string,id:string,name:string,input_json:string,tool_use_id:string,content:string,is_error:boolean>>")), F.lit(4).cast("bigint"), lambda total, b: total + block_tokens(b, p))


def render_block(b: Column, p: Preset) -> Column:
    """P21. Arguments without a cap are compact JSON (the original indents it)."""
    entries = F.map_entries(F.from_json(b["input_json"], "map<string,string>"))
    pairs = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), ", ")
    args = b["input_json"] if p.tool_input is None else truncate(F.concat(F.lit("{ "), pairs, F.lit(" }")), p.tool_input)
    called = F.concat(b["name"], F.lit(" "), args) if p.show_args else b["name"]
    result = F.concat(F.when(F.coalesce(b["is_error"], F.lit(False)), "[ERROR] ").otherwise(""), truncate(b["content"], p.tool_result)) if p.show_results else F.lit("[result hidden]")
    thought = F.concat(F.lit("<thinking>\n"), truncate(b["text"], p.thinking), F.lit("\n</thinking>")) if p.show_thinking else F.lit("")
    return F.when(b["type"] == "text", truncate(b["text"], p.content)).when(b["type"] == "thinking", thought).when(b["type"] == "tool_use", called).when(b["type"] == "tool_result", result).otherwise("")


def render_message(p: Preset, idx: str = "idx", role: str = "role", blocks: str = "blocks") -> Column:
    """P22, one message: a heading, then its non-blank rendered blocks."""
    parts = F.filter(F.transform(col(blocks), lambda b: render_block(b, p)), lambda t: ~is_blank(t))
    body = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("[empty]")
    return F.concat(F.lit("## #"), col(idx).cast("string"), F.lit(" "), col(role), F.lit("\n"), body)


def duration_text(ms: str | Column) -> Column:
    """``5s``, ``3m 2s``, ``1h 4m``."""
    s = F.floor(col(ms) / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, two(m, "m", s % 60, "s")).otherwise(two(h, "h", m % 60, "m"))


def bytes_text(n: str | Column) -> Column:
    """P23."""
    n = col(n)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))


def relative_time(ts: str | Column, now: Column) -> Column:
    """Minutes, hours or days before ``now``; a date after 30 days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(col(ts))
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(s / 60, "m")).when(s < 86400, ago(s / 3600, "h")).when(s < 172800, "yesterday").when(s < 30 * 86400, ago(s / 86400, "d")).otherwise(F.date_format(col(ts), "yyyy-MM-dd"))


def shorten_home(path: str | Column, home: str) -> Column:
    """P23."""
    return F.when(F.startswith(col(path), F.lit(home)), F.concat(F.lit("~"), col(path).substr(F.lit(len(home) + 1), F.length(col(path))))).otherwise(col(path))


def etag(updated_at: str | Column, total: str | Column) -> Column:
    """P25: 16 hex digits over the last update and the number of messages."""
    return F.substring(F.md5(F.concat(F.date_format(col(updated_at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(":"), col(total).cast("string"))), 1, 16)


def share_percent(n: str | Column, total: str | Column) -> Column:
    """One decimal; 0 for an empty total."""
    return F.when(col(total) > 0, F.round(col(n) * 100.0 / col(total), 1)).otherwise(0.0)

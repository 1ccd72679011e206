"""Session statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.presets import Preset
from ..functions.schemas import KEY, ROLES
from .slicing import page_count

# Tools that modify the file they name.
FILE_TOOLS = ("Edit", "Write", "Create", "NotebookEdit")
# Sources whose tools never count errors.
NO_ERRORS = ("gemini", "copilot", "opencode", "kiro")
# Sources whose tools tell the files they modify; the others report none.
TELL_FILES = ("claude", "commandcode")
#: Sources that attribute an error to the latest earlier call (J2); the others to the last name of an id.
AS_OF = ("codex",)
#: Sources whose call ids restart in every message (line): an error belongs to the last tool called earlier in its message.
BY_MESSAGE = ("goose",)


def role_counts(messages: DataFrame) -> DataFrame:
    """A1."""
    return messages.groupBy(*KEY).agg(F.count("*").alias("total_messages"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES])


def exploded(messages: DataFrame) -> DataFrame:
    """One row a block: key, idx, bpos, role, and the block's fields."""
    return messages.select(*KEY, "idx", "role", F.posexplode("blocks").alias("bpos", "b")).select(*KEY, "idx", "bpos", "role", "b.*")


def block_types(messages: DataFrame) -> DataFrame:
    """A2, one row a (session, type)."""
    return exploded(messages).groupBy(*KEY, "type").agg(F.count("*").alias("n"))


def block_type_map(messages: DataFrame) -> DataFrame:
    """A2."""
    return block_types(messages).groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_block_type"))


def block_frequency(messages: DataFrame) -> DataFrame:
    """Block types by count, then first appearance."""
    counts = exploded(messages).groupBy(*KEY, "type").agg(F.count("*").alias("n"), F.min(F.struct("idx", "bpos")).alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "type", "n")))
    return counts.groupBy(*KEY).agg(ordered.alias("t")).select(*KEY, F.transform("t", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("block_frequency"))


def _calls(messages: DataFrame) -> DataFrame:
    """Tool blocks without their contents, with the line they stand in."""
    blocks = messages.select(*KEY, "idx", "role", "raw_line_index", F.posexplode(F.filter("blocks", lambda b: b["type"].isin("tool_use", "tool_result"))).alias("bpos", "b"))
    return blocks.select(*KEY, "idx", "role", "raw_line_index", "bpos", (F.col("b.type") == "tool_use").alias("use"), "b.name", "b.is_error", F.coalesce("b.id", "b.tool_use_id").alias("call"))


def _named(calls: DataFrame, rule: Column) -> DataFrame:
    """``calls`` with ``tool``: a call's own name; of an error result the tool it is attributed to, if any.

    ``rule`` is how errors are attributed: ``last``: to the last tool of the session that used their id (J1; empty ids name none);
    ``as_of``: to the latest earlier call with their id (J2); ``line``: to the last tool called earlier in their line. One window serves all.
    """
    own = F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit("-"), F.col("bpos").cast("string"))
    group = F.when(rule == "last", F.coalesce(F.concat(F.lit("c"), P.truthy("call")), own)).when(rule == "as_of", F.concat(F.lit("c"), "call")).when(rule == "line", F.concat(F.lit("l"), F.col("raw_line_index").cast("string"))).otherwise(own)
    whole = Window.partitionBy(*KEY, "_group")
    earlier = whole.orderBy("idx", "bpos").rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumns({"_rule": rule, "_group": group})
    last = F.max_by("name", F.when(F.col("use"), F.struct("idx", "bpos"))).over(whole)
    before = F.last(F.when(F.col("use"), F.col("name")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"_last": last, "_before": before})
    tool = F.when(F.col("use"), F.col("name")).when(F.col("is_error"), F.when((F.col("_rule") == "last") & (F.col("role") == "tool_result"), F.col("_last")).when(F.col("_rule").isin("as_of", "line"), F.col("_before")))
    return rows.withColumn("tool", tool).drop("_rule", "_group", "_last", "_before")


def _errors(messages: DataFrame, rule: str) -> DataFrame:
    named = _named(_calls(messages), F.lit(rule)).where(~F.col("use") & F.col("tool").isNotNull())
    return named.groupBy(*KEY, F.col("tool").alias("name")).agg(F.count("*").alias("errors"))


def attributed_errors(messages: DataFrame) -> DataFrame:
    """(key, name, errors)."""
    return _errors(messages, "last")


def attributed_errors_as_of(messages: DataFrame) -> DataFrame:
    """Error results by the latest earlier call with their id."""
    return _errors(messages, "as_of")


def attributed_errors_by_message(messages: DataFrame) -> DataFrame:
    """J2 for ids that restart in every message."""
    return _errors(messages, "line")


def tool_counts(messages: DataFrame) -> DataFrame:
    """A3, one row a (session, tool): count, errors, first place. How errors are attributed depends on the source."""
    rule = F.when(F.col("source").isin(*AS_OF), "as_of").when(F.col("source").isin(*BY_MESSAGE), "line").when(~F.col("source").isin(*NO_ERRORS), "last")
    named = _named(_calls(messages), rule).where(F.col("use") | F.col("tool").isNotNull())
    counts = named.groupBy(*KEY, F.col("tool").alias("name")).agg(F.count_if("use").alias("count"), F.count_if(~F.col("use")).alias("errors"), F.min(F.when(F.col("use"), F.struct("idx", "bpos"))).alias("first"))
    return counts.where(F.col("count") > 0)


def tool_frequency(messages: DataFrame) -> DataFrame:
    """A3: array ordered by count, then first appearance."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "first", "name", "count", "errors")))
    return tool_counts(messages).groupBy(*KEY).agg(ordered.alias("t")).select(*KEY, F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"), x["errors"].alias("errors"))).alias("tool_frequency"))


def corpus_tool_frequency(messages: DataFrame) -> DataFrame:
    """A4: over all sessions; hot names are summed before they are shuffled."""
    return tool_counts(messages).groupBy("name").agg(F.sum("count").alias("count"), F.sum("errors").alias("errors"), F.count("*").alias("sessions"))


def token_usage(usage: DataFrame) -> DataFrame:
    """A5: sums per session; null if neither input nor output is ever above 0; cache sums of 0 are null."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    sums = usage.groupBy(*KEY).agg(add("input"), add("output"), add("cache_read"), add("cache_creation"))
    has = (F.col("input") != 0) | (F.col("output") != 0)
    return sums.select(*KEY, F.when(has, F.struct("input", "output", F.nullif("cache_read", F.lit(0)).alias("cache_read"), F.nullif("cache_creation", F.lit(0)).alias("cache_creation"))).alias("token_usage"))


def usage_deltas(counters: DataFrame, order: str = "line_no") -> DataFrame:
    """``counters`` has nullable structs ``last`` and ``total`` of (input, cached, output); returns usage rows.

    Usage is ``last``, else the total less the previous non-null total, no field below 0. Cached tokens are at most
    the input and are taken off it; rows of zeros are skipped.
    """
    before = F.last("total", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = counters.withColumn("_before", before)
    def field(f: str) -> Column:
        return F.when(F.col("last").isNotNull(), F.col("last")[f]).otherwise(F.greatest(F.col("total")[f] - F.coalesce(F.col("_before")[f], F.lit(0)), F.lit(0)))
    rows = rows.where("last is not null or total is not null").select(*KEY, order, field("input").alias("i"), field("cached").alias("c"), field("output").alias("output"))
    cache = F.least("c", "i")
    out = rows.select(*KEY, order, F.greatest(F.col("i") - cache, F.lit(0)).alias("input"), "output", cache.alias("cache_read"))
    return out.where("input != 0 or output != 0 or cache_read != 0")


def files_modified(messages: DataFrame) -> DataFrame:
    """A7 for file tools: distinct ``file_path`` arguments, sorted."""
    uses = exploded(messages).where((F.col("type") == "tool_use") & F.col("name").isin(*FILE_TOOLS))
    path = P.text_at(F.try_parse_json("input_json"), "$.file_path")
    return uses.select(*KEY, path.alias("f")).where("f is not null").groupBy(*KEY).agg(F.array_sort(F.collect_set("f")).alias("files_modified"))


def patched_files(messages: DataFrame) -> DataFrame:
    """A7 for patches: files in the order in which they are first seen."""
    uses = exploded(messages).where((F.col("type") == "tool_use") & (F.col("name") == "apply_patch"))
    patch = P.text_at(F.try_parse_json("input_json"), "$.input")
    files = uses.select(*KEY, "idx", F.posexplode(P.patch_files(patch)).alias("at", "f")).groupBy(*KEY, "f").agg(F.min(F.struct("idx", "at")).alias("first"))
    return files.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "f"))).alias("t")).select(*KEY, F.col("t.f").alias("files_modified"))


def durations(messages: DataFrame) -> DataFrame:
    """Last less first message in order, if there are two and it is above 0."""
    sums = messages.groupBy(*KEY).agg(F.count("*").alias("n"), (F.unix_millis(F.max_by("ts", "idx")) - F.unix_millis(F.min_by("ts", "idx"))).alias("ms"))
    return sums.select(*KEY, F.when((F.col("n") >= 2) & (F.col("ms") > 0), F.col("ms")).alias("duration_ms"))


def session_tokens(messages: DataFrame, p: Preset | None = None) -> DataFrame:
    """A9."""
    return messages.select(*KEY, P.message_tokens("blocks", p).alias("t")).groupBy(*KEY).agg(F.sum("t").alias("tokens"))


def match_counts(messages: DataFrame, query: str) -> DataFrame:
    """Messages per session that hold the query in any case; sessions without are absent."""
    return messages.where(F.contains(F.lower("content"), F.lower(F.lit(query)))).groupBy(*KEY).agg(F.count("*").alias("matches"))


#: Kinds of blocks of the normalised schema.
BLOCK_TYPES = ("text", "thinking", "tool_result", "tool_use")


def _totals(messages: DataFrame) -> DataFrame:
    """A1, A2 and A8 in one aggregation."""
    types = F.transform("blocks", lambda b: b["type"])
    kinds = [F.size(F.filter("_types", lambda t: t == F.lit(k))) for k in BLOCK_TYPES]  # noqa: B023
    rows = messages.select(*KEY, "idx", "role", "ts", types.alias("_types")).select(*KEY, "idx", "role", "ts", *[F.greatest(n, F.lit(0)).cast("bigint").alias(f"_{k}") for n, k in zip(kinds, BLOCK_TYPES)])
    sums = rows.groupBy(*KEY).agg(
        F.count("*").alias("total_messages"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES], *[F.sum(f"_{k}").alias(f"_{k}") for k in BLOCK_TYPES],
        (F.unix_millis(F.max_by("ts", "idx")) - F.unix_millis(F.min_by("ts", "idx"))).alias("_ms"),
    )
    told = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"_{k}").alias("n")) for k in BLOCK_TYPES]), lambda t: t["n"] > 0)
    types = F.when(F.size(told) > 0, F.map_from_entries(told))
    return sums.select(*KEY, "total_messages", *[f"n_{r}" for r in ROLES], types.alias("by_block_type"), F.when((F.col("total_messages") >= 2) & (F.col("_ms") > 0), F.col("_ms")).alias("duration_ms"))


def _told_files(messages: DataFrame) -> DataFrame:
    """A7 of all sources that tell files: sorted where file tools tell them, in order of appearance where patches do."""
    uses = messages.where(F.col("source").isin(*TELL_FILES, *AS_OF)).select(*KEY, "idx", F.posexplode(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*FILE_TOOLS, "apply_patch"))).alias("bpos", "b"))
    args = F.try_parse_json("b.input_json")
    named = F.when(F.col("source").isin(*TELL_FILES) & F.col("b.name").isin(*FILE_TOOLS), F.array(P.text_at(args, "$.file_path"))).when(F.col("source").isin(*AS_OF) & (F.col("b.name") == "apply_patch"), P.patch_files(P.text_at(args, "$.input")))
    files = uses.select(*KEY, "idx", F.posexplode(named).alias("at", "f")).where("f is not null").groupBy(*KEY, "f").agg(F.min(F.struct("idx", "at")).alias("first"))
    order = F.struct(F.when(F.col("source").isin(*AS_OF), F.col("first")), "f")
    return files.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["f"]).alias("files_modified"))


def session_stats(messages: DataFrame, usage: DataFrame | None = None, durations_ms: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row a session. ``durations_ms`` and ``files`` replace what the messages tell for the sessions they hold.

    Without them, files are told by file tools (claude, commandcode) and patches (codex); other sources have none.
    """
    key = list(KEY)
    out = _totals(messages).join(tool_frequency(messages), key, "left").join(_told_files(messages), key, "left")
    for given, column in ((durations_ms, "duration_ms"), (files, "files_modified")):
        if given is not None:
            out = out.join(given.select(*key, F.struct(column).alias("_given")), key, "left")
            out = out.withColumn(column, F.when(F.col("_given").isNotNull(), F.col("_given")[column]).otherwise(F.col(column))).drop("_given")
    if usage is not None:
        out = out.join(token_usage(usage), key, "left")
    else:
        out = out.withColumn("token_usage", F.lit(None).cast("struct<input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint>"))
    return out.withColumn("tool_frequency", F.coalesce("tool_frequency", F.array().cast("array<struct<name:string,count:bigint,errors:bigint>>"))).withColumn("files_modified", F.coalesce("files_modified", F.array().cast("array<string>")))


def session_info(stats: DataFrame, tokens: DataFrame, budget: int = 4000) -> DataFrame:
    """Counts, tokens, pages, duration text and role shares."""
    rows = stats.join(tokens, list(KEY))
    return rows.select(*KEY, "total_messages", *[f"n_{r}" for r in ROLES], F.col("tokens").alias("total_tokens"), page_count("tokens", "total_messages", budget).alias("pages"), P.duration_text("duration_ms").alias("duration"), *[P.share_percent(f"n_{r}", "total_messages").alias(f"pct_{r}") for r in ROLES])

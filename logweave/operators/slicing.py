"""Reading under a token budget: filters, slices, pages and their meta rows.

All windows are keyed by (source, session_id) and carry costs, positions and flags only; contents are joined back
where a caller asks for them. A message's cost is at least 4, so "stop at the first that does not fit" is a
filter on a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.presets import Preset, preset
from ..functions.schemas import KEY
from ..scratch import new_path
from .ranks import CELL, running


def _session():
    return Window.partitionBy(*KEY)


def by_role(messages: DataFrame, roles: str | list[str] | None = None) -> DataFrame:
    """a comma list or list of roles; none keeps all."""
    names = [r.strip() for r in roles.split(",") if r.strip()] if isinstance(roles, str) else list(roles or [])
    return messages.where(F.col("role").isin(names)) if names else messages


def with_position(messages: DataFrame) -> DataFrame:
    """``pos``: 1-based place in the (filtered) list of the session."""
    return messages.withColumn("pos", F.row_number().over(_session().orderBy("idx")))


def in_range(positioned: DataFrame, totals: DataFrame, first: int | None = None, last: int | None = None, before: int | None = None, after: int | None = None) -> DataFrame:
    """positions first..last; ``before`` is 1..before and ``after`` is after..end, both inclusive.

    A session is left out if the range is invalid for it (start below 1, end beyond the ``total`` messages of the
    whole session, start after end); ``invalid_ranges`` lists those.
    """
    start, stop = _bounds(first, last, before, after)
    ends = positioned.groupBy(*KEY).agg(F.max("pos").alias("_n")).join(totals.select(*KEY, "total"), list(KEY))
    to = F.coalesce(F.lit(stop), F.col("_n"))
    good = ends.where(~_bad(start, to)).select(*KEY, to.alias("_to"))
    return positioned.join(good, list(KEY)).where((F.col("pos") >= start) & (F.col("pos") <= F.col("_to"))).drop("_to")


def invalid_ranges(positioned: DataFrame, totals: DataFrame, first: int | None = None, last: int | None = None, before: int | None = None, after: int | None = None) -> DataFrame:
    start, stop = _bounds(first, last, before, after)
    ends = positioned.groupBy(*KEY).agg(F.max("pos").alias("_n")).join(totals.select(*KEY, "total"), list(KEY))
    to = F.coalesce(F.lit(stop), F.col("_n"))
    return ends.where(_bad(start, to)).select(*KEY, F.lit(start).alias("first"), to.alias("last"), "total")


def _bounds(first, last, before, after) -> tuple[int, int | None]:
    return (1, before) if before is not None else (after, None) if after is not None else (first or 1, last)


def _bad(start: int, to: Column) -> Column:
    return F.lit(start < 1) | (to > F.col("total")) | (F.lit(start) > to)


def costed(messages: DataFrame, p: str | Preset | None = None, query: str | None = None) -> DataFrame:
    """Narrow rows for the windows: key, idx, role, cost under the preset, full cost, whether the query occurs."""
    hit = F.contains(F.lower("content"), F.lower(F.lit(query))) if query else F.lit(False)
    full = P.message_tokens("blocks")
    cost = P.message_tokens("blocks", preset(p)) if p is not None else full
    return messages.select(*KEY, "idx", "role", cost.alias("cost"), full.alias("full_cost"), F.coalesce(hit, F.lit(False)).alias("hit"))


def ranked(rows: DataFrame, anchor: str = "head") -> DataFrame:
    """``pos`` and ``rank``: the order in which a slice visits the messages.

    Around a search hit (the first; without one the last message) the visit goes back 1, forward 1, back 2 and
    so on, and on one side when the other is used up: back d is the (d + min(d - 1, after))-th step, forward d the
    (d + min(d, before))-th.
    """
    rows = rows.withColumn("pos", F.row_number().over(_session().orderBy("idx"))).withColumn("n", F.count("*").over(_session()))
    if anchor == "head":
        return rows.withColumn("rank", F.col("pos") - 1)
    if anchor == "tail":
        return rows.withColumn("rank", F.col("n") - F.col("pos"))
    if anchor != "search":
        raise ValueError(f"unknown anchor {anchor!r}")
    center = F.coalesce(F.min(F.when(F.col("hit"), F.col("pos"))).over(_session()), F.col("n"))
    back, forward = F.col("center") - F.col("pos"), F.col("pos") - F.col("center")
    before, after = F.col("center") - 1, F.col("n") - F.col("center")
    rank = F.when(back > 0, back + F.least(back - 1, after)).when(forward > 0, forward + F.least(forward, before)).otherwise(0)
    return rows.withColumn("center", center).withColumn("rank", rank.cast("int"))


def within_budget(rows: DataFrame, budget: int | Column) -> DataFrame:
    """The first visited message, and further ones while the running cost fits."""
    running = F.sum("cost").over(_session().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", running).where((F.col("rank") == 0) | (F.col("_run") <= budget)).drop("_run")


def trim_to_assistant(rows: DataFrame) -> DataFrame:
    """Cut after the slice's last assistant message, if at least half of the slice remains."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(_session())
    first, n = F.min("pos").over(_session()), F.count("*").over(_session())
    marked = rows.withColumn("_last", last).withColumn("_keep", F.col("_last") - first + 1).withColumn("_n", n)
    return marked.where(F.col("_last").isNull() | (2 * F.col("_keep") < F.col("_n")) | (F.col("pos") <= F.col("_last"))).drop("_last", "_keep", "_n")


def slice_sessions(messages: DataFrame, budget: int, anchor: str = "head", query: str | None = None, p: str | Preset | None = None) -> DataFrame:
    """Chosen rows (key, idx, role, cost, full_cost, hit, pos, n, rank) of each session."""
    return trim_to_assistant(within_budget(ranked(costed(messages, p, query), anchor), budget))


def slice_meta(listed: DataFrame, chosen: DataFrame, budget: int, anchor: str) -> DataFrame:
    """One row a session of ``listed`` (``costed`` rows of the whole list) about its slice ``chosen``.

    ``has_more_after`` compares the last original index with the length of the given list, as the original does.
    """
    totals = listed.groupBy(*KEY).agg(F.count("*").alias("total_messages"), F.sum("full_cost").alias("total_tokens"))
    got = chosen.groupBy(*KEY).agg(F.sum("cost").alias("returned_tokens"), F.count("*").alias("returned_messages"), F.min("idx").alias("range_from"), F.max("idx").alias("range_to"))
    more_before, more_after = F.col("range_from") > 1, F.col("range_to") < F.col("total_messages")
    return totals.join(got, list(KEY)).select(
        *KEY, "total_messages", "total_tokens", "returned_messages", "returned_tokens", F.lit(budget).cast("bigint").alias("token_budget"), F.lit(anchor).alias("anchor"), "range_from", "range_to",
        more_before.alias("has_more_before"), more_after.alias("has_more_after"), F.when(more_before, F.col("range_from") - 1).alias("cursor_before"), F.when(more_after, F.col("range_to") + 1).alias("cursor_after"),
    )


def empty_meta(sessions: DataFrame, messages: DataFrame, budget: int, anchor: str) -> DataFrame:
    """W9 of sessions without messages: zeros and nulls."""
    zero = F.lit(0).cast("bigint")
    return sessions.select(*KEY).join(messages.select(*KEY).distinct(), list(KEY), "left_anti").select(
        *KEY, *[zero.alias(c) for c in ("total_messages", "total_tokens", "returned_messages", "returned_tokens")], F.lit(budget).cast("bigint").alias("token_budget"), F.lit(anchor).alias("anchor"), F.lit(0).alias("range_from"), F.lit(0).alias("range_to"),
        F.lit(False).alias("has_more_before"), F.lit(False).alias("has_more_after"), F.lit(None).cast("int").alias("cursor_before"), F.lit(None).cast("int").alias("cursor_after"),
    )


#: Messages of a session whose pages are filled in one row; larger sessions are paged by jumps.
ONE_ROW = 10_000


def _filled(rows: DataFrame, budget: int) -> DataFrame:
    """Pages of sessions of bounded size: costs in order are folded to the places where pages start, in the JVM."""
    plain = [c for c in rows.columns if c not in KEY and c != "idx"]
    listed = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", *plain))).alias("l"))
    fold = f"""aggregate(l, named_struct('at', 0, 'run', 0L, 'starts', array_repeat(0, 0)),
      (s, x) -> IF(s.at > 0 AND s.run + x.cost <= {int(budget)}L, named_struct('at', s.at + 1, 'run', s.run + x.cost, 'starts', s.starts),
                   named_struct('at', s.at + 1, 'run', CAST(x.cost AS BIGINT), 'starts', concat(s.starts, array(s.at + 1)))), s -> s.starts)"""
    cut = listed.withColumn("starts", F.expr(fold))
    pages = F.expr("flatten(transform(starts, (a, k) -> transform(slice(l, a, coalesce(get(starts, k + 1), size(l) + 1) - a), x -> struct(x, CAST(k + 1 AS BIGINT) AS page))))")
    each = cut.select(*KEY, F.explode(pages).alias("m")).select(*KEY, "m.x.*", "m.page")
    return each.select(*rows.columns, "page")


def _jumped(rows: DataFrame, budget: int) -> DataFrame:
    """Pages of sessions of any size, by doubled jumps.

    From every message one jump leads to the message that would start the next page. The first message starts a page; a
    jump from the starts that are known gives as many again, and jumps are then composed with themselves. So the rounds are the logarithm of
    the largest number of pages, and each is a join by (session, place) of narrow rows.
    """
    spark = rows.sparkSession
    keys = list(KEY)
    placed = _kept(running(rows.select(*keys, "idx", F.col("cost").cast("bigint").alias("cost")), keys, "idx", {"place": F.lit(1), "before": F.col("cost")}))
    ends = placed.select(*keys, (F.col("before") + F.col("cost")).alias("value"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("place"))
    asked = placed.select(*keys, (F.col("before") + budget).alias("value"), F.lit(1).alias("kind"), "place")
    # how many messages end within the page that starts here; a cost is 4 at least, so a cell has bounded rows
    fits = running(ends.unionByName(asked), keys, "value", {"n": 1 - F.col("kind")}, ["kind", "place"], 4 * CELL)
    jumps = _kept(fits.where("kind = 1").select(*keys, "place", F.greatest("n", F.col("place") + 1).alias("next")))
    first = placed.where("place = 0").select(*keys, "place")
    starts = fresh = _kept(first)
    while True:
        fresh = _kept(starts.join(jumps, [*keys, "place"]).select(*keys, F.col("next").alias("place")).join(placed.select(*keys, "place"), [*keys, "place"]))
        if fresh.isEmpty():
            break
        starts = _kept(starts.unionByName(fresh))
        onward = jumps.select(*keys, F.col("place").alias("next"), F.col("next").alias("_to"))
        jumps = _kept(jumps.join(onward, [*keys, "next"]).select(*keys, "place", F.col("_to").alias("next")))
    flagged = placed.select(*keys, "idx", "place").join(starts.withColumn("_start", F.lit(1)), [*keys, "place"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    paged = running(flagged, keys, "place", {"page": F.col("_start")}).select(*keys, "idx", (F.col("page") + F.col("_start")).alias("page"))
    return rows.join(paged, [*keys, "idx"])


def _kept(df: DataFrame) -> DataFrame:
    """Written, as later rounds read it again."""
    at = new_path(df.sparkSession, "pages")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def assign_pages(rows: DataFrame, budget: int, one_row: int = ONE_ROW) -> DataFrame:
    """``page`` of each costed row: a page ends before the message that would overfill it; one message at least.

    Sessions of at most ``one_row`` messages are filled in a row each, larger ones by jumps over narrow rows.
    """
    large = rows.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > one_row).select(*KEY)
    if large.isEmpty():
        return _filled(rows, budget)
    small, huge = (rows.join(large, list(KEY), how) for how in ("left_anti", "left_semi"))
    return _filled(small, budget).unionByName(_jumped(huge, budget).select(*rows.columns, "page"))


def read_page(messages: DataFrame, page: int, budget: int, p: str | Preset | None = None) -> DataFrame:
    """Rows of the page (held between the first and the last), cut after its last assistant."""
    rows = assign_pages(costed(messages, p), budget)
    pages = F.max("page").over(_session())
    rows = rows.withColumn("pages", pages).where(F.col("page") == F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages")))
    return trim_to_assistant(rows.withColumn("pos", F.row_number().over(_session().orderBy("idx"))))


def page_meta(listed: DataFrame, chosen: DataFrame, budget: int) -> DataFrame:
    """W9 for a page: more before and after by page number."""
    totals = listed.groupBy(*KEY).agg(F.count("*").alias("total_messages"), F.sum("full_cost").alias("total_tokens"))
    got = chosen.groupBy(*KEY).agg(F.sum("cost").alias("returned_tokens"), F.count("*").alias("returned_messages"), F.min("idx").alias("range_from"), F.max("idx").alias("range_to"), F.max("page").alias("page"), F.max("pages").alias("pages"))
    before, after = F.col("page") > 1, F.col("page") < F.col("pages")
    return totals.join(got, list(KEY)).select(
        *KEY, "total_messages", "total_tokens", "returned_messages", "returned_tokens", F.lit(budget).cast("bigint").alias("token_budget"), "range_from", "range_to", "page", "pages",
        before.alias("has_more_before"), after.alias("has_more_after"), F.when(before, F.col("range_from") - 1).alias("cursor_before"), F.when(after, F.col("range_to") + 1).alias("cursor_after"),
    )


def page_count(total: str | Column, n: str | Column, budget: int) -> Column:
    """A10."""
    return F.when(P.col(n) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(P.col(total) / budget))).cast("bigint")


def detail_hint(messages: DataFrame, p: str | Preset) -> DataFrame:
    """Per session what the preset hides of the given messages, and estimated tokens of richer presets (null: not offered)."""
    p = preset(p)
    hidden = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.when(b["type"] == "tool_use", 0 if p.show_args else 1).otherwise(0))
    cut = (lambda b: F.lit(True)) if not p.show_results else (lambda b: P.u16len(b["content"]) > p.tool_result) if p.tool_result is not None else (lambda b: F.lit(False))
    truncated = F.size(F.filter("blocks", lambda b: (b["type"] == "tool_result") & cut(b)))
    thinking = F.exists("blocks", lambda b: (b["type"] == "thinking") & F.lit(not p.show_thinking))
    rows = messages.select(*KEY, hidden.alias("h"), truncated.alias("t"), thinking.alias("k"), P.message_tokens("blocks", preset("verbose")).alias("v"), P.message_tokens("blocks", preset("full")).alias("f"))
    sums = rows.groupBy(*KEY).agg(F.sum("h").alias("hidden_tool_calls"), F.sum("t").alias("truncated_results"), F.bool_or("k").alias("thinking_hidden"), F.sum("v").alias("v"), F.sum("f").alias("f"))
    about = lambda c: F.greatest(F.floor(F.col(c) / 100 + 0.5) * 100, F.lit(100)).cast("bigint")
    shown = sums.where((F.col("hidden_tool_calls") > 0) | (F.col("truncated_results") > 0) | F.col("thinking_hidden")) if p.name != "full" else sums.where(F.lit(False))
    none = F.lit(None).cast("bigint")
    return shown.select(*KEY, F.lit(p.name).alias("current_preset"), "hidden_tool_calls", "truncated_results", "thinking_hidden", (none if p.name == "verbose" else about("v")).alias("verbose_tokens"), about("f").alias("full_tokens"))


def project_detail(messages: DataFrame, detail: str) -> DataFrame:
    """``meta`` empties content and blocks; ``skeleton`` keeps 60 characters as the only block."""
    if detail == "meta":
        return messages.withColumn("content", F.lit("")).withColumn("blocks", F.filter("blocks", lambda b: F.lit(False)))
    if detail == "skeleton":
        none = F.lit(None).cast("string")
        block = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), none.alias("id"), none.alias("name"), none.alias("input_json"), none.alias("tool_use_id"), none.alias("content"), F.lit(None).cast("boolean").alias("is_error"))
        return messages.withColumn("content", P.summarize("content", 60)).withColumn("blocks", F.array(block))
    return messages

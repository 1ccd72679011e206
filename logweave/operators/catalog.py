"""Session index jobs: dedup, listing, search, resolve, tags, prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.presets import parse_duration
from ..functions.schemas import KEY
from .search_index import SearchIndex, indexed_counts
from .stats import match_counts

# Registry order of the sources; it breaks ties between entries of one id.
SOURCES = ("claude", "codex", "gemini", "copilot", "cursor-agent", "commandcode", "goose", "opencode", "kiro", "zed")


def source_rank(source: str | Column = "source") -> Column:
    col = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), col), F.lit(0)), F.lit(len(SOURCES) + 1))


def of_source(index: DataFrame, source: str | None = None) -> DataFrame:
    """F1."""
    return index.where(F.col("source") == source) if source else index


def dedup_index(index: DataFrame) -> DataFrame:
    """One row an id, the newest; ties keep the first source in registry order."""
    first = Window.partitionBy("id").orderBy(F.desc("updated_at"), source_rank(), "file_path")
    return index.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def newest_first(index: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first, the id breaks ties."""
    out = index.orderBy(F.desc("updated_at"), "id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def _matches(messages: DataFrame | SearchIndex, query: str) -> DataFrame:
    """A11 by a scan, or through an index."""
    return indexed_counts(messages, query) if isinstance(messages, SearchIndex) else match_counts(messages, query)


def with_match(index: DataFrame, messages: DataFrame | SearchIndex, query: str) -> DataFrame:
    """Sessions that have any matching message."""
    return index.join(_matches(messages, query).select("source", F.col("session_id").alias("id")), ["source", "id"], "left_semi")


def list_sessions(index: DataFrame, messages: DataFrame | SearchIndex | None = None, query: str | None = None, source: str | None = None, limit: int | None = 20, offset: int = 0, scan: int | None = None) -> DataFrame:
    """The page of sessions, each with ``total_available`` and ``has_more``. ``scan`` searches the newest so many only."""
    rows = dedup_index(of_source(index, source))
    if query:
        rows = with_match(newest_first(rows, scan) if scan else rows, messages, query)
    total = rows.agg(F.count("*").alias("total_available"))
    page = newest_first(rows, limit, offset).withColumn("total_available", total.scalar())
    return page.withColumn("has_more", F.lit(offset + limit) < F.col("total_available") if limit is not None else F.lit(False))


def search_sessions(index: DataFrame, messages: DataFrame | SearchIndex, query: str, top: int = 10, newest: int | None = None, source: str | None = None) -> DataFrame:
    """E2 (T2): the sessions with most matching messages among the ``newest`` (all by default); ties newest first."""
    rows = dedup_index(of_source(index, source))
    rows = newest_first(rows, newest) if newest else rows
    counts = _matches(messages, query).withColumnRenamed("session_id", "id")
    return rows.join(counts, ["source", "id"]).orderBy(F.desc("matches"), F.desc("updated_at"), "id").limit(top)


def resolve_ids(index: DataFrame, requests: DataFrame) -> DataFrame:
    """For each ``requests(request)`` the entry with that id, else the newest whose id starts with it.

    Exact ids are an equi-join. For the rest, each id is cut to every length that is asked for, which makes the prefix match an
    equi-join too; the lengths are broadcast, one row each and at most as many as the longest request has characters.
    """
    rows = dedup_index(index)
    wanted = requests.select("request").where("request is not null and request != ''").distinct()
    exact = wanted.join(rows, F.col("request") == F.col("id"))
    lengths = wanted.join(exact.select("request"), "request", "left_anti").withColumn("n", F.length("request"))
    sizes = lengths.select("n").distinct()
    cut = rows.join(F.broadcast(sizes), F.length("id") >= F.col("n")).withColumn("request", F.substring("id", F.lit(1), F.col("n")))
    newest = Window.partitionBy("request").orderBy(F.desc("updated_at"), "id")
    near = lengths.select("request").join(cut.drop("n"), "request").withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return exact.unionByName(near.select(*exact.columns))


def unresolved(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests without an entry."""
    return requests.select("request").distinct().join(resolved.select("request"), "request", "left_anti")


def latest_in_cwd(index: DataFrame, newest: int = 5) -> DataFrame:
    """Per (source, cwd) asked for by its own rows: the latest session of that cwd among the source's ``newest``, else the source's newest."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("updated_at"), "id"))
    head = index.select("source", "cwd", "id", "updated_at", rank.alias("r")).where(F.col("r") <= newest)
    mine = head.groupBy("source", "cwd").agg(F.min_by("id", "r").alias("in_cwd"))
    top = head.where("r = 1").select("source", F.col("id").alias("newest_id"))
    asked = index.select("source", "cwd").distinct()
    return asked.join(mine, ["source", "cwd"], "left").join(top, "source").select("source", "cwd", F.coalesce("in_cwd", "newest_id").alias("id"))


def keep_snapshots(index: DataFrame, execution: str = "execution_id", size: str = "message_count") -> DataFrame:
    """Of the snapshots of one execution the one with most messages, ties the first file; rows without one all stay."""
    first = Window.partitionBy("source", execution).orderBy(F.desc(size), "file_path")
    held = index.where(F.col(execution).isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return held.unionByName(index.where(F.col(execution).isNull()))


def first_file(index: DataFrame) -> DataFrame:
    """Of files with one id the first in the live folder, then in the archive."""
    first = Window.partitionBy("source", "id").orderBy(F.contains("file_path", F.lit("archived")), "file_path")
    return index.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def prune_candidates(index: DataFrame, age: str, now: Column) -> DataFrame:
    """sessions last updated longer ago than ``age`` (``7d``); reported, never deleted."""
    ms = parse_duration(age)
    return dedup_index(index).where(F.unix_millis("updated_at") < F.unix_millis(now) - ms)


def apply_tags(tags: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """(session_id, tag, seq) after additions, then removals; both idempotent.

    ``seq`` numbers a session's tags as they were inserted, from 1: those that were there keep their order, new ones follow in
    the order of the additions' ``seq`` (without one: by name).
    """
    numbered = lambda df, turn: df.select("session_id", "tag", F.struct(F.lit(turn).alias("turn"), (F.col("seq") if "seq" in df.columns else F.lit(0)).cast("bigint").alias("seq")).alias("at"))
    out = numbered(tags, 0)
    if add is not None:
        out = out.unionByName(numbered(add, 1))
    out = out.groupBy("session_id", "tag").agg(F.min("at").alias("at"))
    out = out.join(remove.select("session_id", "tag"), ["session_id", "tag"], "left_anti") if remove is not None else out
    return out.select("session_id", "tag", F.row_number().over(Window.partitionBy("session_id").orderBy("at", "tag")).cast("bigint").alias("seq"))


def with_tags(index: DataFrame, tags: DataFrame, tag: str | None = None) -> DataFrame:
    """The index with each session's tags in the order of their insertion; with ``tag`` only sessions that have it."""
    held = apply_tags(tags).groupBy(F.col("session_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda t: t["tag"]).alias("tags"))
    out = index.join(held, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.where(F.array_contains("tags", tag)) if tag else out


def index_of(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """An index straight from normalised tables: the first user message, cleaned, is the summary."""
    from ..functions.scalars import clean_prompt

    first = messages.where("role = 'user'").groupBy(*KEY).agg(F.min_by("content", "idx").alias("p"))
    return sessions.join(first, list(KEY), "left").select(F.col("session_id").alias("id"), "source", "cwd", "updated_at", clean_prompt("p").alias("summary"), "file_path")

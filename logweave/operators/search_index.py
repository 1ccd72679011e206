"""Full-text search through a trigram index.

Messages are dealt to blocks of some BLOCK messages: parts of sessions, by hash. For each trigram of lower-cased contents the index
holds the numbers of the blocks that have it, in segments of SEGMENT blocks. A query's trigrams select postings, their block lists are
intersected by segment, and only messages of the blocks that remain are searched, exactly. A query of one or two characters takes the
blocks of all trigrams that hold it; contents shorter than three characters are grams themselves. So counts equal a scan's for every query.

A hot trigram is no problem: postings are distinct blocks, summed up by task before the shuffle, and a list is at most a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import KEY
from .stats import match_counts

#: Messages of a block, on average, and blocks of a segment.
BLOCK, SEGMENT = 256, 32_768
#: Candidate blocks that are pushed into the scan as a list; more are joined.
PUSHED = 1_000
#: Bytes of a row group of the messages, so that blocks left out are not read.
ROW_GROUP = 4 << 20


@dataclass
class SearchIndex:
    """``messages`` with their ``block``, ``postings`` (gram, segment, blocks) and the number of blocks."""

    messages: DataFrame
    postings: DataFrame
    blocks: int


def grams(text: Column) -> Column:
    """Distinct trigrams of a text, in one pass over it; the text itself if it is shorter."""
    n = F.char_length(text)
    return F.when(n >= 3, F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))."), F.lit(1)))).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def build_index(messages: DataFrame, path: str, block: int = BLOCK) -> SearchIndex:
    """Write messages in order of blocks, and the postings, below ``path``."""
    spark = messages.sparkSession
    blocks = max(1, -(-messages.count() // block))
    number = F.pmod(F.xxhash64(*KEY, F.floor(F.col("idx") / block)), F.lit(blocks)).cast("int")
    dealt = messages.withColumn("block", number)
    dealt.repartitionByRange("block").sortWithinPartitions("block", *KEY, "idx").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/messages")
    held = spark.read.schema(dealt.schema).parquet(f"{path}/messages")
    each = held.where("content is not null").select("block", F.explode(grams(F.lower("content"))).alias("gram")).distinct()
    listed = each.groupBy("gram", F.expr(f"block div {SEGMENT}").alias("segment")).agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    listed.repartitionByRange("gram").sortWithinPartitions("gram", "segment").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    spark.createDataFrame([(blocks,)], "blocks int").coalesce(1).write.parquet(f"{path}/size")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{path}/messages"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size").first()["blocks"])


def candidate_blocks(index: SearchIndex, query: str) -> DataFrame:
    """Blocks (``block``) that may hold the query, in any case; every block that does is among them."""
    low = index.postings.sparkSession.range(1).select(F.lower(F.lit(query)).alias("q"), grams(F.lower(F.lit(query))).alias("g")).first()
    if not low["q"]:
        return index.messages.select("block").distinct()
    if len(low["q"]) < 3:
        return index.postings.where(F.contains("gram", F.lit(low["q"]))).select(F.explode("blocks").alias("block")).distinct()
    wanted = sorted(low["g"])
    found = index.postings.where(F.col("gram").isin(wanted)).groupBy("segment").agg(F.collect_list("blocks").alias("lists"))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    return found.where(F.size("lists") == len(wanted)).select(F.explode(both).alias("block"))


def candidates(index: SearchIndex, query: str) -> DataFrame:
    """Messages of the blocks that may hold the query."""
    blocks = candidate_blocks(index, query)
    few = [r["block"] for r in blocks.limit(PUSHED + 1).collect()]
    rows = index.messages.where(F.col("block").isin(few)) if len(few) <= PUSHED else index.messages.join(blocks, "block")
    return rows.drop("block")


def indexed_counts(index: SearchIndex, query: str) -> DataFrame:
    """Matching messages by session, as a scan counts them."""
    return match_counts(candidates(index, query), query)


def skipped(index: SearchIndex, query: str) -> DataFrame:
    """One row: blocks in all, blocks searched, blocks passed over."""
    return candidate_blocks(index, query).agg(F.lit(index.blocks).alias("blocks"), F.count("*").cast("int").alias("searched")).withColumn("skipped", F.col("blocks") - F.col("searched"))

"""Physical lines of large files, read in blocks by many tasks.

Spark cuts a text file into blocks and tells with each line the block it came from. A line's place in its block
follows from its number in the task, which grows by one a line. Counts of the blocks, one narrow row each, run within a file, so a line's physical
number is its block's first number and its place. No line is shuffled: the table of blocks is sent where it is small, and
joined by block otherwise (a block is one task's share).

Both passes over the files must cut them alike. The number of parts that Spark cuts for is therefore pinned in the session
(``spark.sql.files.minPartitionNum``), and every line must find its block, by file, first byte and task; if not (as when a file was
written between the passes) the job ends with an error rather than with wrong numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import new_path
from .readers import FILE_PATTERNS

#: Blocks whose table is broadcast: some 100 bytes each.
SENT_BLOCKS = 100_000


@dataclass
class Lines:
    """``lines`` (file_path, line_no, value) and ``facts`` (file_path, raw_line_count, file_bytes, mtime)."""

    lines: DataFrame
    facts: DataFrame


def _read(spark: SparkSession, path: str, source: str | None) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    meta = {"file_path": "file_path", "_start": "file_block_start", "file_bytes": "file_size", "mtime": "file_modification_time"}
    rows = text.select("value", *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()])
    rows = rows.where(F.col("file_path").rlike(FILE_PATTERNS[source])) if source else rows
    return rows.withColumns({"_at": F.monotonically_increasing_id(), "_task": F.spark_partition_id()})


def read_lines(spark: SparkSession, path: str, source: str | None = None, sent: int = SENT_BLOCKS) -> Lines:
    """The lines of all files below ``path``, as ``readers.lines_of`` gives them from whole files.

    Lines end at LF; a CR before it goes too. What follows the last LF is a line if it is not empty, with its CR. A byte order mark at a
    file's start is left out. Files without lines have no facts.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    rows = _read(spark, path, source)
    blocks = rows.groupBy("file_path", "_start", "_task").agg(F.count("*").alias("n"), F.min("_at").alias("first_at"), F.sum(F.octet_length("value")).alias("bytes"), F.first("file_bytes").alias("file_bytes"), F.first("mtime").alias("mtime"))
    at = new_path(spark, "blocks")
    blocks.write.parquet(at)
    blocks = spark.read.schema(blocks.schema).parquet(at)
    before = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    total = F.sum("n").over(whole)
    # one byte more than the file has (with a mark of three bytes left out: two less): nothing ends its last line
    open_end = (F.sum("bytes").over(whole) + total - F.col("file_bytes")).isin(1, -2)
    placed = blocks.select("file_path", "_start", "_task", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.when(open_end, total - 1).alias("open_line"), total.alias("total"), "file_bytes", "mtime")
    facts = placed.groupBy("file_path").agg(F.first("total").alias("raw_line_count"), F.first("file_bytes").alias("file_bytes"), F.first("mtime").alias("mtime"))
    table = placed.select("file_path", "_start", "_task", "first_at", "base", "open_line")
    many = blocks.count() > sent
    joined = rows.select("file_path", "_start", "_task", "_at", "value").join(table.hint("merge") if many else F.broadcast(table), ["file_path", "_start", "_task"], "left")
    line_no = F.col("base") + F.col("_at") - F.col("first_at")
    found = F.when(line_no.isNull(), F.raise_error(F.concat(F.lit("cut otherwise than before: "), "file_path")).cast("bigint")).otherwise(line_no)
    value = F.when(F.endswith("value", F.lit("\r")) & ~F.coalesce(line_no == F.col("open_line"), F.lit(False)), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return Lines(joined.select("file_path", found.alias("line_no"), value.alias("value")), facts)

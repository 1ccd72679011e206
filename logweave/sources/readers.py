"""Reading transcript files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import running

#: Lines that a head scan looks at, by source.
HEAD_LINES = {"claude": 30, "commandcode": 30, "goose": 30, "codex": 50}

# Which files of a tree belong to a source.
FILE_PATTERNS = {
    "claude": r"\.jsonl$",
    "codex": r"\.jsonl$",
    "gemini": r"/session-[^/]*\.json$",
    "copilot": r"/events\.jsonl$",
    "cursor-agent": r"/agent-transcripts/.*\.jsonl$",
    "commandcode": r"^(?!.*\.checkpoints\.).*\.jsonl$",
    "goose": r"\.jsonl$",
    "opencode": r"/(ses|msg|prt)_[^/]*\.json$",
    "kiro": r"(\.chat|/workspace-sessions/[^/]+/(?!sessions\.json)[^/]+\.json)$",
}


def read_files(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """(file_path, value, file_bytes, mtime), one row a file below ``path``; ``source`` filters by its pattern."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = files.select(F.col("_metadata.file_path").alias("file_path"), "value", F.col("_metadata.file_size").alias("file_bytes"), F.col("_metadata.file_modification_time").alias("mtime"))
    return rows.where(F.col("file_path").rlike(FILE_PATTERNS[source])) if source else rows


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, line_no, value): physical lines of whole files, from 0, without the empty piece after the last break."""
    pieces = F.split("value", "\r?\n")
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return files.select("file_path", F.posexplode(kept).alias("line_no", "value"))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that hold JSON, as ``v VARIANT``; others are dropped."""
    return lines.select("file_path", "line_no", F.try_parse_json("value").alias("v")).where("v is not null")


def documents(files: DataFrame) -> DataFrame:
    """One JSON document a file."""
    return files.select("file_path", F.try_parse_json("value").alias("v")).where("v is not null")


def facts_of(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """S3: (file_path, raw_line_count, file_bytes, mtime); without a file table bytes and mtime are null."""
    counts = lines.groupBy("file_path").agg(F.count("*").alias("raw_line_count"))
    if files is None:
        return counts.withColumns({"file_bytes": F.lit(None).cast("bigint"), "mtime": F.lit(None).cast("timestamp")})
    return counts.join(files.select("file_path", "file_bytes", "mtime"), "file_path")


def head(lines: DataFrame, source: str) -> DataFrame:
    """The first physical lines of each file."""
    return lines.where(F.col("line_no") < HEAD_LINES[source])


def numbered(rows: DataFrame) -> DataFrame:
    """``raw_index``: place among the given lines of the file, from 0; only the lines' numbers are ranked, and joined back."""
    places = running(rows.select("file_path", "line_no"), ["file_path"], "line_no", {"raw_index": F.lit(1)})
    return rows.join(places, ["file_path", "line_no"])


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns, each computed once: the optimiser does not merge them into what names them later."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select("*", "_made.*").drop("_made")


def first_of(value: Column, order: str | Column = "line_no") -> Column:
    """The first non-null value by order."""
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_of(value: Column, order: str | Column = "line_no") -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.max_by(value, F.when(value.isNotNull(), order))


def base_name(path: str | Column = "file_path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.(jsonl|json|chat)$", "")


def parent(path: str | Column = "file_path", levels: int = 1) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    for _ in range(levels):
        path = F.regexp_replace(path, r"/[^/]*$", "")
    return path


def last_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)

"""Sinks (S6, S7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.schemas import KEY
from ..operators.render import jsonl_lines
from .heads import store_of


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder a source, so that a source filter reads only its own files."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def lay_out(df: DataFrame, table: str, path: str, buckets: int = 200, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Parquet files bucketed by session, each bucket one file in order of session and ``order``, as table ``table``.

    Windows, sums and joins by session of laid-out tables with the same number of buckets need no shuffle.
    """
    spark = df.sparkSession
    rows = df.repartition(buckets, *KEY).sortWithinPartitions(*KEY, *[c for c in order if c in df.columns])
    rows.write.format("parquet").mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_jsonl(messages: DataFrame, meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text lines; a session's lines stand together, its meta record first."""
    lines = jsonl_lines(messages, meta)
    lines.repartition("source", "session_id").sortWithinPartitions("source", "session_id", "line_no").select("source", "value").write.mode(mode).partitionBy("source").text(path)


def write_files(lines: DataFrame, path: str) -> DataFrame:
    """(file_path, line_no, value) as one text file for each file path, below ``path``; (file_path, bytes) of the files written.

    A file is written under a name of its own and renamed, so a task that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root, _ = store_of(path)
        name = sink = None
        size, done = 0, []

        def end() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{root}/{name.strip('/')}{mark}", f"{root}/{name.strip('/')}")
                done.append((name, size))

        mark = f".{TaskContext.get().taskAttemptId()}"
        for b in batches:
            for file_path, value in zip(b.column("file_path").to_pylist(), b.column("value").to_pylist()):
                if file_path != name:
                    end()
                    name, size = file_path, 0
                    at = f"{root}/{name.strip('/')}"
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(at + mark)
                size += sink.write((value or "").encode("utf-8") + b"\n")
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file_path", "bytes"])

    return lines.select("file_path", "line_no", "value").repartition("file_path").sortWithinPartitions("file_path", "line_no").mapInArrow(write, "file_path string, bytes bigint")

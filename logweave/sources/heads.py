"""Heads of transcript files: a Python data source that opens each file and stops after its first lines.

``read_heads(spark, {"claude": "/logs/claude", ...})`` gives a row for each of the first lines of each file of each source. Comparisons of
``source``, ``file_name`` and ``file_path`` with texts (equal, in, starts with, ends with, contains) are pushed into the listing: roots of
other sources are not listed, files of other names are not opened.

The driver lists only upper folders, until there are enough to deal out; tasks list what is below them. A folder that itself holds many files is
dealt to several tasks by the names' checksum. Of a file BLOCK bytes are read at a time, until its lines are complete.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .readers import FILE_PATTERNS, HEAD_LINES

SCHEMA = "source string, file_path string, file_name string, file_bytes bigint, mtime timestamp, line_no int, value string, bytes_read bigint"
#: Bytes read at a time, folders to deal out at least, files of one folder for a task.
BLOCK, FOLDERS, FILES = 16_384, 256, 2_000
#: Lines of a file of a source that has no number of its own.
OTHER_LINES = 30
ROWS = 2_000

#: How each filter judges a text.
TESTS = {
    EqualTo: lambda text, x: text == x,
    In: lambda text, x: text in x,
    StringStartsWith: lambda text, x: text.startswith(x),
    StringEndsWith: lambda text, x: text.endswith(x),
    StringContains: lambda text, x: x in text,
}
COLUMNS = ("source", "file_name", "file_path")


@dataclass
class Folder(InputPartition):
    """The files of a folder, with those below it if ``deep``; one of ``shares`` parts of them."""

    source: str
    path: str
    deep: bool
    share: int = 0
    shares: int = 1


def store_of(root: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a root, its path there, and what stands before a path there to name it."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/"), "file:"
    store, path = pafs.FileSystem.from_uri(root)
    path = path.rstrip("/")
    return store, path, "file:" if isinstance(store, pafs.LocalFileSystem) else root.rstrip("/").removesuffix(path)


def first_lines(stream, n: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """The first n lines, without their LF or CR LF, and how many bytes were read for them."""
    lines: list[bytes] = []
    held: list[bytes] = []
    read = 0
    while len(lines) < n:
        got = stream.read(block)
        read += len(got)
        if not got:
            if any(held):
                lines.append(b"".join(held))
            break
        *ended, rest = got.split(b"\n")
        for piece in ended:
            held.append(piece)
            lines.append(b"".join(held).removesuffix(b"\r"))
            held = []
        held.append(rest)
    return lines[:n], read


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots: dict[str, str] = json.loads(options["roots"])
        self.lines: dict[str, int] = json.loads(options.get("lines", "{}"))
        self.folders = int(options.get("folders", FOLDERS))
        self.files = int(options.get("files", FILES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, **texts: str) -> bool:
        return all(TESTS[kind](texts[column], value) for column, kind, value in self.tests if column in texts)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source, root in self.roots.items():
            if not self.passes(source=source):
                continue
            store, path, _ = store_of(root)
            level = [path]
            while level and len(level) < self.folders:
                below = []
                for folder in level:
                    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
                    n = sum(f.is_file for f in found)
                    shares = -(-n // self.files)
                    out += [Folder(source, folder, False, k, shares) for k in range(shares)]
                    below += [f.path for f in found if f.type == pafs.FileType.Directory]
                level = below
            out += [Folder(source, folder, True) for folder in level]
        return out

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there is nothing to deal out
            return
        store, _, prefix = store_of(self.roots[partition.source])
        pattern = FILE_PATTERNS.get(partition.source)
        wanted = self.lines.get(partition.source, OTHER_LINES)
        rows: list[tuple] = []
        for f in store.get_file_info(pafs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True)):
            if not f.is_file or zlib.crc32(f.base_name.encode()) % partition.shares != partition.share:
                continue
            named = prefix + f.path
            if pattern and not re.search(pattern, named) or not self.passes(file_name=f.base_name, file_path=named):
                continue
            with store.open_input_stream(f.path, buffer_size=0) as stream:
                lines, read = first_lines(stream, wanted)
            rows += [(partition.source, named, f.base_name, f.size, f.mtime, k, line.decode("utf-8", "replace"), read) for k, line in enumerate(lines)]
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


KINDS = pa.schema([("source", pa.string()), ("file_path", pa.string()), ("file_name", pa.string()), ("file_bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("line_no", pa.int32()), ("value", pa.string()), ("bytes_read", pa.int64())])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS.types)], schema=KINDS)


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def read_heads(spark: SparkSession, roots: dict[str, str], lines: dict[str, int] | None = None, **options: int) -> DataFrame:
    """The first lines of all files below the roots, by source (``lines``, else HEAD_LINES, else OTHER_LINES of each)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeadSource)
    read = spark.read.format("transcript_heads").option("roots", json.dumps(roots)).option("lines", json.dumps(lines or HEAD_LINES))
    for k, v in options.items():
        read = read.option(k, str(v))
    return read.load()


def facts_of(heads: DataFrame) -> DataFrame:
    """(file_path, file_bytes, mtime, raw_line_count) of the files with lines; the whole number of lines is not known."""
    return heads.where("line_no = 0").select("file_path", "file_bytes", "mtime", F.lit(None).cast("bigint").alias("raw_line_count"))

"""Token ids as Arrow stream files with fixed-size-list batches.

The corpus is one stream of ids: the documents in ascending doc_id order, each followed by the end id. A shard
holds a run of documents. Its file is an Arrow IPC stream (uncompressed, so a memory map serves it without a
copy) of record batches with two columns, ``tokens: fixed_size_list<uint16 or uint32>[length]`` and
``mask: fixed_size_list<bool>[length]``: row r of a shard is its ids r*length .. (r+1)*length, and the mask is
false only on the padding of a shard's last row. Each batch but the last has ``ROWS_PER_BATCH`` rows, so any
sequence is found by arithmetic. A table beside the files says in which shard each document lies and where.

Tasks write a file under a name of their own and rename it, so a task that runs twice leaves one whole file.

Encoding is exact and cheap: the vocabulary's pre-tokeniser never crosses ASCII white space, so the library
encodes distinct chunks between white space and their ids are kept in a table bounded by its bytes (``ChunkEncoder``).

Edge cases: null text counts as empty and gives the end id alone; a null id sorts first; repeated ids keep
all rows, in order of text; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, scratch, written
from .textbatch import chunks

SEQUENCE = 2048
ROWS_PER_BATCH = 64
#: Bytes of chunks and ids that a worker keeps, in two generations, with ENTRY_BYTES for each entry.
KEPT_BYTES, ENTRY_BYTES = 170_000_000, 110
#: Longer chunks are seldom seen again and are never kept.
KEPT_CHUNK = 64
#: Characters that are cut into chunks at once, and those given to the library at once.
BATCH_CHARS, LIBRARY_CHARS = 500_000, 200_000
#: A chunk of more characters is cut where the pre-tokeniser splits in any case.
CUT_CHARS = 16_384
MANIFEST = "shard int, path string, doc_id long, first long, n_tokens long"


#: Marks of special tokens, which are found before letters are made lower case.
SPECIAL_MARK = b"<|"
#: ASCII marks that stand apart from a word they follow.
TRAILING = b".,;:!?%&$#*"
#: Between a letter or number and a mark the pre-tokeniser always splits ("|" is part of special tokens).
SPLITS = re.compile(r"(?<=[^\W_])(?=[!-/:-@\[-`{}~\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f])")
#: The normaliser and pre-tokeniser for which chunks are encoded alone; texts of other vocabularies are encoded whole.
CHUNKED = (
    ["NFC", "Replace", "Lowercase"],
    [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)


class ChunkEncoder:
    """Ids of texts, as little-endian bytes, from the ids of their chunks between ASCII white space.

    The vocabulary's normaliser makes letters lower case, and its pre-tokeniser neither crosses white space nor
    joins a letter with the marks after it. So the chunks that a batch adds to the kept ones are looked up in lower case,
    without trailing marks, and only the distinct new ones go to the library. Kept chunks are bounded by their bytes:
    when the young generation is full it becomes the old one, and what is used again moves back. A vocabulary with
    another normaliser or pre-tokeniser gets whole texts.

    A text of letters alone, without any mark or white space, is one word to the vocabulary; the library needs some
    200 bytes a character for it.
    """

    def __init__(self, tokenizer_path: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        told = json.loads(self.tokenizer.to_str())
        steps = lambda key, inner: (told[key] or {}).get(inner, [told[key]])
        self.chunked = ([x and x["type"] for x in steps("normalizer", "normalizers")], steps("pre_tokenizer", "pretokenizers")) == CHUNKED
        # words of Latin-1 letters alone pass the normaliser and the splitting unchanged: the same model without them
        self.plain = Tokenizer.from_file(tokenizer_path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes, self.kept_bytes = 0, kept_bytes

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if SPECIAL_MARK in raw:
            return [c if SPECIAL_MARK in c else c.lower() for c in raw.split()]
        return raw.lower().split()

    @staticmethod
    def parts(chunk: bytes) -> tuple[bytes, ...]:
        """The chunk, or its word and the marks behind it."""
        word = chunk.rstrip(TRAILING)
        if len(word) == len(chunk) or not word or SPECIAL_MARK in chunk:
            return (chunk,)
        if not (word[-1:].isalpha() or word[-1] >= 0x80 and word.decode("utf-8")[-1].isalpha()):
            return (chunk,)
        return word, chunk[len(word) :]

    def encode(self, tokenizer, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, with about LIBRARY_CHARS characters in the library at once."""
        code = "H" if self.kind.itemsize == 2 else "I"
        for a, b in chunks(texts, LIBRARY_CHARS):
            for e in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False):
                yield array(code, e.ids).tobytes()

    def long(self, chunk: str) -> bytes:
        """Ids of a long chunk, cut where it splits anyway."""
        cuts = [0]
        for m in SPLITS.finditer(chunk):
            if m.start() - cuts[-1] >= CUT_CHARS:
                cuts.append(m.start())
        return b"".join(self.encode(self.tokenizer, [chunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(chunk)])]))

    def find(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in the young generation; short ones are kept."""
        got: dict[bytes, bytes] = {}
        if self.old:
            got = {c: self.old[c] for c in new if c in self.old}
        split = [(c, p) for c in new.difference(got) if len(p := self.parts(c)) > 1]
        inner = {x for _, p in split for x in p}.difference(new)
        known = {p: ids for p in inner if (ids := self.kept.get(p) or self.old.get(p))}
        pieces = new.difference(got, (c for c, _ in split)) | inner
        words: list[tuple[bytes, str]] = []
        others: list[tuple[bytes, str]] = []
        for p in pieces.difference(known):
            t = p.decode("utf-8")
            if t.isalpha() and max(t) <= "\xff":
                words.append((p, t.lower()))
            elif len(t) > CUT_CHARS:
                known[p] = self.long(t)
            else:
                others.append((p, t))
        for tokenizer, found in ((self.plain, words), (self.tokenizer, others)):
            known.update(zip((p for p, _ in found), self.encode(tokenizer, [t for _, t in found])))
        got.update(known)
        got.update((c, got[word] + got[marks]) for c, (word, marks) in split)
        short = {c: ids for c, ids in got.items() if len(c) <= KEPT_CHUNK}
        self.bytes += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)
        self.kept.update(short)
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each of the texts; give it about BATCH_CHARS characters at once."""
        if not self.chunked:
            return list(self.encode(self.tokenizer, texts))
        if 2 * self.bytes > self.kept_bytes:
            self.old, self.kept, self.bytes = self.kept, {}, 0
        split = [self.chunks(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.kept)
        if not new:
            return [b"".join(map(self.kept.__getitem__, parts)) for parts in split]
        found = self.find(new)
        rare = {c: ids for c, ids in found.items() if len(c) > KEPT_CHUNK}
        if not rare:
            return [b"".join(map(self.kept.__getitem__, parts)) for parts in split]
        return [b"".join([rare[c] if c in rare else self.kept[c] for c in parts]) for parts in split]


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(tokenizer_path: str, kept_bytes: int) -> ChunkEncoder:
    """One encoder a worker process: its kept chunks serve all its tasks."""
    key = (tokenizer_path, kept_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.Array]]:
    """Texts and ids of runs of rows with about BATCH_CHARS bytes of text; a longer row is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        a = total = 0
        for i, n in enumerate([*sizes, None]):
            if a < i and (n is None or total + n > BATCH_CHARS):
                part = batch.slice(a, i - a)
                yield [t or "" for t in part.column("text").to_pylist()], part.column("doc_id")
                a, total = i, 0
            total += n or 0


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None, length: int = SEQUENCE, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """Encode and write the documents; returns the written table (shard, path, doc_id, first, n_tokens).

    ``first`` is the document's first id within its shard. Documents are dealt by ranges of doc_id, so
    shards are in ascending order too. ``kept_bytes`` bounds the table of chunks that a worker keeps: less memory, more work.
    """
    out_dir = out_dir or scratch(docs.sparkSession, "tokens")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        encode = encoder(tokenizer_path, kept_bytes)
        end = np.array([end_id], dtype=encode.kind).tobytes()
        store, root = _store(out_dir)
        store.create_dir(root, recursive=True)
        path, mine = f"{root}/shard-{shard:06d}.arrows", f"{root}/.shard-{shard:06d}-{context.taskAttemptId()}"
        item = pa.from_numpy_dtype(encode.kind)
        schema = pa.schema([("tokens", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        sink = writer = None
        rest, at, block = b"", 0, length * ROWS_PER_BATCH

        def put(ids: np.ndarray) -> None:
            rows = -(-len(ids) // length)
            padded = np.zeros(rows * length, dtype=encode.kind)
            padded[: len(ids)] = ids
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (padded, np.arange(rows * length) < len(ids))]
            writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

        for ids_of, doc_ids in pieces_of(batches):
            ids = [x + end for x in encode(ids_of)]
            if writer is None:
                sink = store.open_output_stream(mine)
                writer = pa.ipc.new_stream(sink, schema)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // encode.kind.itemsize
            stop = at + np.cumsum(sizes)
            flow = np.frombuffer(rest + b"".join(ids), dtype=encode.kind)
            full = len(flow) // block * block
            for a in range(0, full, block):
                put(flow[a : a + block])
            rest = flow[full:].tobytes()
            at = int(stop[-1])
            n = len(ids)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int32()), "path": [f"{out_dir}/shard-{shard:06d}.arrows"] * n, "doc_id": doc_ids, "first": pa.array(stop - sizes), "n_tokens": pa.array(sizes)})
        if writer is not None:
            if rest:
                put(np.frombuffer(rest, dtype=encode.kind))
            writer.close()
            sink.close()
            store.move(mine, path)
        give_back()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(shards, MANIFEST), "token-documents")


class ShardReader:
    """Sequences, masks and ids of a shard.

    Where the store allows a memory map, any batch is at hand without a copy. Elsewhere batches are read in order and one
    at a time is held; going back opens the file again.
    """

    def __init__(self, path: str):
        self.store, self.path = _store(path)
        self.mapped = isinstance(self.store, pafs.LocalFileSystem)
        self.open()
        self.batches = list(self.stream) if self.mapped else None
        self.length = self.stream.schema.field("tokens").type.list_size

    def open(self) -> None:
        self.stream = pa.ipc.open_stream(pa.memory_map(self.path) if self.mapped else self.store.open_input_file(self.path))
        self.at, self.held = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if self.mapped:
            return self.batches[k]
        if k < self.at:
            self.open()
        while self.at < k:
            self.held, self.at = self.stream.read_next_batch(), self.at + 1
        return self.held

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.batch(row // ROWS_PER_BATCH)
        pick = lambda name: batch.column(name)[row % ROWS_PER_BATCH].values.to_numpy(zero_copy_only=name == "tokens")
        return pick("tokens"), pick("mask")

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """Ids first .. first + n of the shard's stream, in pieces, across its rows and batches."""
        block = self.length * ROWS_PER_BATCH
        while n > 0:
            k, at = divmod(first, block)
            got = self.batch(k).column("tokens").flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield got
            first, n = first + len(got), n - len(got)


def read_back(manifest: DataFrame) -> DataFrame:
    """Each document of a written table from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it in the whole stream.
    """
    sizes = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, ShardReader] | None = None
        for b in batches:
            crc = []
            for path, first, n in zip(b["path"], b["first"], b["n_tokens"]):
                if held is None or held[0] != path:
                    held = (path, ShardReader(path))
                sum_ = 0
                for part in held[1].ids(first, n):
                    sum_ = zlib.crc32(part.astype("<u4").tobytes(), sum_)
                crc.append(sum_)
            yield pd.DataFrame({"shard": b["shard"], "doc_id": b["doc_id"].astype("Int64"), "first": b["first"], "n_tokens": b["n_tokens"], "ids_crc32": crc})

    got = manifest.mapInPandas(read, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return got.join(base, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")

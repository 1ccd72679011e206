"""Exact dedup over a cuckoo-filter index of digests.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a digest (sha256) stands for the
normalised text. The index is split into buckets by digest, one task each. A bucket holds a cuckoo filter over the live
digests and its content: the digests with their number of rows and the row that stays, in sorted runs. What arrives is
asked of the filter in batches: digests it does not know are new and are appended without a look at the content; hits are
verified against the content, digest by digest, and merged only if they are equal (a false hit is new too). A filter that
overflows is rebuilt at twice the size from the stored digests, with other bytes of them as keys. A digest whose last row is retracted
is deleted from both, so an index can follow a corpus from which rows are withdrawn (``update_index``).

Rows are summed per digest before they are dealt to buckets, so a group of copies of any size reaches its
bucket as a few rows. On the way back large groups, few by their share of all rows, are broadcast; the others
join by digest (``join_groups``).

Edge cases: null text counts as empty; all empty and white-space-only texts are one group; a null id counts as
larger than any id; of rows equal in length and id exactly one stays (the first that the scan numbers, so all the
same columns are returned whichever it is); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, join_groups, tasks, written

#: Rows of one digest that the sum before the deal leaves at most.
SALTS = 16
#: Rows that one bucket of the index is made from, on average.
BUCKET_ROWS = 400_000
SLOTS, MAX_KICKS, MAX_REBUILDS = 4, 200, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
DIGEST = np.dtype("S32")
CONTENT = np.dtype([("norm_len", "i4"), ("rows", "i8"), ("n_chars", "i4"), ("neg_id", "i8"), ("neg_row", "i8")])


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; inserts, finds and deletes 64-bit keys, an array of them at once."""

    def __init__(self, capacity: int = 1024):
        self.n_buckets = 1 << max(4, (int(capacity / SLOTS / 0.9) - 1).bit_length())
        self.table = np.zeros((self.n_buckets, SLOTS), dtype=np.uint16)
        self.size = 0
        self._turn = 0

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.uint64) * _MIX >> np.uint64(20)) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (keys & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may be held (never false for one that is)."""
        prints, one = self._places(keys)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[self._other(one, prints)] == prints[:, None]).any(axis=1)

    def _put(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(bucket[order], bucket[order])
        free = np.argsort(self.table[bucket] != 0, axis=1, kind="stable")  # free slots first
        fits = rank < (self.table[bucket] == 0).sum(axis=1)
        self.table[bucket[fits], free[fits, rank[fits]]] = prints[fits]
        return fits

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it is then to be rebuilt."""
        prints, bucket = self._places(keys)
        self.size += len(keys)
        for kick in range(MAX_KICKS):
            for _ in range(2):
                left = ~self._put(prints, bucket)
                prints, bucket = prints[left], self._other(bucket[left], prints[left])
                if not len(prints):
                    return True
            # one fingerprint a bucket takes the slot of another, which moves on to its other bucket
            at, first = np.unique(bucket, return_index=True)
            self._turn = (self._turn + 1) % SLOTS
            moved = self.table[at, self._turn].copy()
            self.table[at, self._turn] = prints[first]
            prints[first] = moved
            bucket[first] = self._other(at, moved)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are held, one slot each."""
        prints, one = self._places(keys)
        for print_, *places in zip(prints, one, self._other(one, prints)):
            at = next(b for b in places if (self.table[b] == print_).any())
            self.table[at, np.flatnonzero(self.table[at] == print_)[0]] = 0
        self.size -= len(keys)


class DigestBucket:
    """One bucket of the index: a cuckoo filter over the live digests, and their content in sorted runs.

    A run holds its digests in order, and their content as a record array; runs double in size, so a hit is looked for in a
    few of them.
    """

    def __init__(self, capacity: int = 1024):
        self.filter, self.level = CuckooFilter(capacity), 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def keys(self, digests: np.ndarray) -> np.ndarray:
        """Eight bytes of each digest; which ones changes with each rebuild."""
        return digests.view(np.uint8).reshape(-1, 32).view(np.uint64)[:, self.level % 4].copy()

    def _insert(self, digests: np.ndarray) -> None:
        if self.filter.insert(self.keys(digests)):
            return
        capacity = self.filter.n_buckets * SLOTS
        every = np.concatenate([*(d for d, _ in self.runs), digests])
        for _ in range(MAX_REBUILDS):
            capacity, self.level = 2 * max(capacity, len(every)), self.level + 1
            self.filter = CuckooFilter(capacity)
            if self.filter.insert(self.keys(every)):
                return
        raise RuntimeError("a cuckoo filter can't take its keys at any size")

    def _seek(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place in it) of each digest; run -1: the content has no such digest."""
        run, place = np.full(len(digests), -1), np.zeros(len(digests), dtype=np.int64)
        for k, (held, _) in enumerate(self.runs):
            at = np.minimum(np.searchsorted(held, digests), len(held) - 1)
            same = held[at] == digests
            run[same], place[same] = k, at[same]
        return run, place

    def add(self, digests: np.ndarray, content: np.ndarray) -> None:
        """Add distinct digests with their content rows; rows of live ones are counted on, and the better row stays."""
        hit = self.filter.find(self.keys(digests))
        new = ~hit
        if hit.any():  # the verification: a false hit is not in the content
            at = np.flatnonzero(hit)
            run, place = self._seek(digests[at])
            new[at[run < 0]] = True
            for k in np.unique(run[run >= 0]):
                mine = run == k
                held = self.runs[k][1]
                held[place[mine]] = merged(held[place[mine]], content[at[mine]])
        if new.any():
            self._insert(digests[new])
            order = np.argsort(digests[new])
            self.runs.append((digests[new][order], content[new][order]))
            while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
                (d1, c1), (d2, c2) = self.runs.pop(), self.runs.pop()
                d, c = np.concatenate([d2, d1]), np.concatenate([c2, c1])
                order = np.argsort(d, kind="stable")
                self.runs.append((d[order], c[order]))

    def remove(self, digests: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Retract rows of distinct digests; which digests are thereby no longer live. Digests that are not live are ignored."""
        hit = np.flatnonzero(self.filter.find(self.keys(digests)))
        run, place = self._seek(digests[hit])
        gone = np.zeros(len(digests), dtype=bool)
        for k in np.unique(run[run >= 0]):
            mine = run == k
            held, content = self.runs[k]
            content["rows"][place[mine]] -= rows[hit[mine]]
            dead = content["rows"][place[mine]] <= 0
            gone[hit[mine][dead]] = True
            keep = np.ones(len(held), dtype=bool)
            keep[place[mine][dead]] = False
            self.runs[k] = (held[keep], content[keep])
        self.filter.delete(self.keys(digests[gone]))
        self.runs = [r for r in self.runs if len(r[0])]
        return gone

    def content(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, DIGEST), np.zeros(0, CONTENT)
        return np.concatenate([d for d, _ in self.runs]), np.concatenate([c for _, c in self.runs])


def merged(held: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Content of both: the rows together, and of the two rows that stayed the one with more characters, then the smaller id, then the one read first."""
    better = np.zeros(len(held), dtype=bool)
    level = np.ones(len(held), dtype=bool)
    for c in ("n_chars", "neg_id", "neg_row"):
        better |= level & (new[c] > held[c])
        level &= new[c] == held[c]
    out = np.where(better, new, held)
    out["rows"] = held["rows"] + new["rows"]
    return out


def distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests of a batch, and their content."""
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=DIGEST)
    content = np.zeros(len(digests), dtype=CONTENT)
    for c in CONTENT.names:
        content[c] = batch.column(c).to_numpy(zero_copy_only=False)
    order = np.lexsort((content["neg_row"], content["neg_id"], content["n_chars"], digests))  # the best row of a digest is last
    digests, content = digests[order], content[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, np.int64)
    out = content[np.r_[first[1:], len(digests)] - 1] if len(first) else content
    if len(first):
        out["rows"] = np.add.reduceat(content["rows"], first)
    return digests[first], out


def digests(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, digest, norm_len, n_chars) of each row; JVM-side."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, f"{SPACE_CLASS}+", "")
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.length(norm).alias("norm_len"), F.length(text).alias("n_chars"))


INDEX_SCHEMA = "digest binary, norm_len int, group_size long, keep_chars int, keep_id long, keep_row long"


def told(bucket: DigestBucket) -> Iterator[pa.RecordBatch]:
    held, content = bucket.content()
    for a in range(0, len(held), 50_000):
        d, c = held[a : a + 50_000], content[a : a + 50_000]
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(d), [None, pa.py_buffer(d.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_pydict({"digest": column, "norm_len": c["norm_len"].copy(), "group_size": c["rows"].copy(), "keep_chars": c["n_chars"].copy(), "keep_id": -c["neg_id"], "keep_row": -c["neg_row"]})


def buckets(rows: DataFrame, total: int) -> int:
    return max(tasks(rows.sparkSession), total // BUCKET_ROWS + 1)


def build_index(rows: DataFrame) -> DataFrame:
    """One entry a live digest from ``digests(...)`` rows, through the cuckoo buckets."""
    last = F.lit(2**63 - 1)
    best = F.max(F.struct("n_chars", (-F.coalesce("doc_id", last)).alias("neg_id"), (-F.col("row_id")).alias("neg_row")))
    partial = rows.groupBy("digest", F.pmod(F.col("row_id"), F.lit(SALTS)).alias("salt")).agg(F.first("norm_len").alias("norm_len"), F.count("*").alias("rows"), best.alias("best"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = DigestBucket()
        for b in batches:
            if b.num_rows:
                bucket.add(*distinct(b))
        yield from told(bucket)

    flat = partial.select("digest", "norm_len", "rows", "best.*")
    return flat.repartition(buckets(rows, rows.count()), "digest").mapInArrow(fill, INDEX_SCHEMA)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Live digests and their row counts after rows ``added`` and ``removed`` (both from ``digests``).

    Only (digest, norm_len, group_size) follow: which row stays is not known after a removal without the
    rows themselves. A removed digest that the index does not hold is ignored.
    """
    parts = index.select("digest", "norm_len", F.col("group_size").alias("rows"), F.lit(0).alias("step"))
    for step, frame in enumerate((added, removed), 1):
        parts = parts.unionByName(frame.groupBy("digest").agg(F.first("norm_len").alias("norm_len"), F.count("*").alias("rows")).withColumn("step", F.lit(step)))
    parts = parts.withColumns({c: F.lit(0).cast(k) for c, k in (("n_chars", "int"), ("neg_id", "long"), ("neg_row", "long"))})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = DigestBucket()
        for b in batches:
            for step in sorted(set(b.column("step").to_pylist())):
                got = distinct(b.filter(pc.equal(b.column("step"), step)))
                bucket.remove(got[0], got[1]["rows"]) if step == 2 else bucket.add(*got)
        for b in told(bucket):
            yield b.select(["digest", "norm_len", "group_size"])

    dealt = parts.repartition(tasks(index.sparkSession), "digest").sortWithinPartitions("step")
    return dealt.mapInArrow(apply, "digest binary, norm_len int, group_size long")


def dedup(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as (doc_id, keep_id, group_size, kept, digest)."""
    rows = written(digests(docs), "digests")
    index = written(build_index(rows), "digest-index")
    out = join_groups(rows.select("row_id", "doc_id", "digest"), index.select("digest", "group_size", "keep_id", "keep_row"), "digest", "group_size")
    keep = F.when(F.col("keep_id") == 2**63 - 1, None).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "digest")

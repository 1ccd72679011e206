"""Benchmark decontamination by suffix arrays over the training text.

The training documents are cut into shards (the batches a task reads). A shard's words become numbers, and
the suffixes of its word sequence are sorted: the shard's suffix array. Each suffix of each benchmark item is
binary-searched in it; equal runs of at least ``WINDOW`` words (a whole item, if it is shorter) give the
matching places, and neighbouring places on one diagonal join to the longest verbatim matches with their
locations in document and item.

The array orders suffixes by their first WINDOW words, all that such a decision needs: a longer match is a chain
of windows that follow each other. Suffixes whose first word is in no item can match nothing and are left out. Items
share many windows; each distinct one is searched once, and the items that hold it are attached to what was found.

The benchmark is sent to the tasks in blocks of bounded size (``BLOCK_CHARS``); each block passes over all
documents, and the hits of all blocks are united per document. An item larger than a block is cut into pieces that
overlap by a window less one word, so no window is lost; a match over such a cut is told as two.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Edge cases: null or empty texts and items have no
words; an item without words has no window; repeated items count by their ids; an empty benchmark
contaminates nothing; items with a null id are searched and add no name to the list; rows that share a doc_id share their hits; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written

WINDOW = 10
#: Bytes of benchmark words that one broadcast block holds at most.
BLOCK_CHARS = 16_000_000
#: Words of one suffix array; bounds a task's memory. A longer document is a shard of its own.
SHARD_WORDS = 2_000_000

#: Bytes that end a word; upper-case letters are mapped to lower case before.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8; the bytes of characters beyond ASCII are all word bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Block:
    """Pieces of benchmark items, as (item id, place of its first word, words), in numbers, ready to be searched.

    ``q_words`` and ``q_len`` are the distinct windows; window d stands at the places ``at[d] : at[d + 1]`` of ``w_item``
    (the piece) and ``w_pos`` (its place in the item).
    """

    def __init__(self, pieces: list[tuple[object, int, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.ids = [item for item, _, _ in pieces]
        number = self.vocab.setdefault
        size = np.fromiter((len(w) for _, _, w in pieces), dtype=np.int64, count=len(pieces))
        flat = np.fromiter((number(x, len(self.vocab) + 1) for _, _, w in pieces for x in w), dtype=np.int64, count=int(size.sum()))
        self.bits = max(1, (len(self.vocab) + 1).bit_length())
        self.per_key = min(window, 62 // self.bits)
        # every test suffix, cut to the window; a shorter item is one whole query, filled up with 0
        begin, n = np.cumsum(size) - size, np.maximum(size - window, 0) + 1
        item = np.repeat(np.arange(len(pieces)), n)
        place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(size, window)[item]
        padded = np.concatenate([flat, np.zeros(window, np.int64)])
        rows = padded[(begin[item] + place)[:, None] + np.arange(window)]
        rows[np.arange(window) >= length[:, None]] = 0
        self.q_words, owner = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.q_len = (self.q_words > 0).sum(axis=1)
        order = np.argsort(owner.ravel(), kind="stable")
        self.at = np.searchsorted(owner.ravel()[order], np.arange(len(self.q_words) + 1))
        self.w_item, self.w_pos = item[order], (place + np.array([p for _, p, _ in pieces], dtype=np.int64)[item])[order]

    def keys(self) -> list[tuple[int, int]]:
        """Word ranges of the window that go into one 62-bit key each."""
        return [(a, min(self.window, a + self.per_key)) for a in range(0, self.window, self.per_key)]


def suffix_hits(seq: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of a distinct window of the block in the number sequence."""
    none = np.zeros(0, np.int64)
    if not len(block.q_len) or not len(seq):
        return none, none
    padded = np.concatenate([seq, np.zeros(block.window, np.int64)])
    place = np.flatnonzero(seq)  # suffixes that begin with a benchmark word
    if not len(place):
        return none, none
    low = np.zeros(len(block.q_len), np.int64)
    high = low.copy()
    rank = None
    for a, b in block.keys():
        key = np.zeros(len(padded) - block.window, np.int64)
        for k in range(a, b):
            key = (key << block.bits) | padded[k : k + len(key)]
        key = key[place]
        q_low = np.zeros(len(block.q_len), np.int64)
        q_high = q_low.copy()
        for k in range(a, b):
            open_end = block.q_len <= k
            q_low = (q_low << block.bits) | block.q_words[:, k]
            q_high = (q_high << block.bits) | np.where(open_end, (1 << block.bits) - 1, block.q_words[:, k])
        if rank is None:
            rank, low, high = key, q_low, q_high
        else:  # order by what came before, then by this key: both as dense ranks
            u1, r1 = np.unique(rank, return_inverse=True)
            u2, r2 = np.unique(key, return_inverse=True)
            shift = int(len(u2) + 1).bit_length()
            rank = (r1.astype(np.int64) << shift) | r2
            l1, h1 = np.searchsorted(u1, low), np.searchsorted(u1, high, side="right") - 1
            l2, h2 = np.searchsorted(u2, q_low), np.searchsorted(u2, q_high, side="right") - 1
            whole = block.q_len > a  # the earlier words are fixed: one rank, if it is there
            exact = (l1 == h1) & (l2 <= h2)
            low = np.where(whole, np.where(exact, (l1 << shift) | l2, 1), l1 << shift)
            high = np.where(whole, np.where(exact, (l1 << shift) | h2, 0), (h1 << shift) | ((1 << shift) - 1))
    order = np.argsort(rank, kind="stable")  # the suffix array: places in order of their first words
    ranked = rank[order]
    start, stop = np.searchsorted(ranked, low), np.searchsorted(ranked, high, side="right")
    n = np.maximum(stop - start, 0)
    n[low > high] = 0
    query = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
    return query, place[order[start[query] + inside]]


def longest(query: np.ndarray, place: np.ndarray, doc: np.ndarray, block: Block) -> pd.DataFrame:
    """Chains of windows on one diagonal: (doc, item, doc place, item place, length) of the verbatim matches."""
    n = block.at[query + 1] - block.at[query]
    spot = np.arange(n.sum()) + np.repeat(block.at[query] - (np.cumsum(n) - n), n)  # the items that hold each window
    query, place, doc = (np.repeat(x, n) for x in (query, place, doc))
    item, pos, size = block.w_item[spot], block.w_pos[spot], block.q_len[query]
    order = np.lexsort((place, place - pos, item))
    item, pos, size, place, doc = item[order], pos[order], size[order], place[order], doc[order]
    if not len(item):
        return pd.DataFrame({"doc": [], "item": [], "place": [], "item_place": [], "length": []}, dtype=np.int64)
    diagonal = place - pos
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    return pd.DataFrame({"doc": doc[first], "item": item[first], "place": place[first], "item_place": pos[first], "length": place[last] - place[first] + size[last]})


def search_texts(texts: list[str | None], block: Block) -> tuple[np.ndarray, pd.DataFrame]:
    """Number of words of each text, and its verbatim matches (doc is the index of the text)."""
    counts, found = np.zeros(len(texts), np.int64), []
    get = block.vocab.get
    parts, first, size = [], 0, 0

    def flush(upto: int) -> None:
        if not parts:
            return
        sizes = counts[first:upto] + 1  # one 0 after each text: no match runs over it
        seq = np.concatenate(parts)
        query, place = suffix_hits(seq, block)
        starts = np.cumsum(sizes) - sizes
        doc = np.searchsorted(starts, place, side="right") - 1
        hits = longest(query, place, doc, block)
        hits["place"] -= starts[hits["doc"]]
        hits["doc"] += first
        found.append(hits)

    for i, text in enumerate(texts):
        w = words(text)
        counts[i] = len(w)
        if parts and size + len(w) > SHARD_WORDS:
            flush(i)
            parts, first, size = [], i, 0
        seq = np.zeros(len(w) + 1, np.int64)
        seq[: len(w)] = np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w))
        parts.append(seq)
        size += len(w)
    flush(len(texts))
    return counts, pd.concat(found) if found else longest(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), block)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The items in blocks of bounded size, read one after another to the driver; items without words have no window."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        rest, first = words(row["text"]), 0
        while rest:
            upto = len(rest)
            if sum(map(len, rest)) + upto > block_chars:
                upto = max(2 * window, int(np.searchsorted(np.cumsum([len(x) + 1 for x in rest]), block_chars)))
            piece, more = rest[:upto], upto < len(rest)
            n = sum(map(len, piece)) + len(piece)
            if held and size + n > block_chars:
                yield Block(held, window)
                held, size = [], 0
            held.append((row["item_id"], first, piece))
            size += n
            step = upto - window + 1 if more else upto
            rest, first = rest[step:], first + step
    yield Block(held, window)


MATCHES = "doc_id long, n_words long, item_id string, place long, item_place long, length long"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row (doc_id, n_words, item_id, place, item_place, length) a longest match, and one with a null place a document.

    The result is a written table. Every block of the benchmark passes over all documents.
    """
    out = None
    for k, block in enumerate(blocks(benchmark, window)):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], held=held, head=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                counts, hits = search_texts(batch.column("text").to_pylist(), held.value)
                if head:
                    yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "item_id": pa.nulls(len(ids), pa.string()), **{c: pa.nulls(len(ids), pa.int64()) for c in ("place", "item_place", "length")}})
                if len(hits):
                    at = pa.array(hits["doc"].to_numpy())
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(at), "n_words": pa.array(counts[hits["doc"]], pa.int64()), "item_id": pa.array([None if (x := held.value.ids[i]) is None else str(x) for i in hits["item"]], pa.string()), **{c: pa.array(hits[c].to_numpy(), pa.int64()) for c in ("place", "item_place", "length")}})
            give_back()

        part = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, MATCHES), "matches")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(matches: DataFrame) -> DataFrame:
    """Per document (doc_id, n_words, n_hit, items): words inside any match, and the sorted ids of its items."""
    hit = matches.where(F.col("place").isNotNull())
    stop = F.col("place") + F.col("length")
    before = Window.partitionBy("doc_id").orderBy("place", F.col("length").desc(), "item_id").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), stop - F.greatest(F.col("place"), F.coalesce(F.max(stop).over(before), F.lit(0))))
    spans = hit.groupBy("doc_id", "place", "length").agg(F.first("item_id").alias("item_id"))
    n_hit = spans.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    items = hit.groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = n_hit.join(items, F.col("doc_id").eqNullSafe(F.col("_of"))).drop("doc_id")
    every = matches.where(F.col("place").isNull()).select("doc_id", "n_words")
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("_of")), "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

A text with a space before it is the byte string of both vocabularies: vocabulary A (byte-level BPE) encodes it as it is,
vocabulary B (pieces with byte fallback) adds that space itself. Both token sequences cut the same bytes. For an interval of
bytes that starts and ends at a shared cut, the end of the middle A token is looked up among the ends of the B tokens by
bisection; if it is no end there, the search widens around the middle, twice as far each time, until a common end is found.
The interval is divided there, and both halves go on; an interval without a common end inside is a leaf: one group. All
intervals of a batch of documents take a step at once in numpy, so the number of steps follows the longest document's
logarithm, and what a step costs follows the intervals that are still open.

Every A token of a group is linked with every B token of it. Links are counted by id pair within a document (distinct pairs and
how often each occurs), never listed corpus-wide; the counts of pairs over documents come from one aggregation keyed by pair. To look the
counts up again, the most frequent pairs, ``SENT_PAIRS`` at most, are broadcast; documents' other pairs join by pair.

Memory: about BATCH_CHARS characters are encoded at once and about LINKS_AT_ONCE links expanded at once. Tokens of groups with many
links are counted by id before they are expanded, and a document with more links is worked off in blocks of A ids.

Edge cases: null and empty texts, and texts whose A or B bytes differ from the space and the text (as where the text itself holds
U+2581), have no tokens, zeros, and the empty string as digest; an empty table gives an empty table; every row is a document,
rows of one id or with a null id too; other columns, also with the names of results, are not read; equally frequent pairs of an
A id are all its best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written
from .token_output import pieces_of

#: Links expanded at once; groups with more links are reduced to distinct ids first.
LINKS_AT_ONCE, LARGE_GROUP = 2_000_000, 4096
#: Pairs whose counts are broadcast, the most frequent ones: some 20 bytes each.
SENT_PAIRS = 500_000

ALIGNED = "row long, doc_id long, head boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else the next beyond 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


#: The splitting of byte-level vocabularies before their merges (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a longer run without white space go to the vocabulary's own library.
LONG_RUN = 10_000


class ByteLevel:
    """Vocabulary A: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letter = byte_letters()
        vocab = told["model"]["vocab"]
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.size = self.library.get_vocab_size()
        self.bytes = [b""] * self.size
        for entry, k in vocab.items():
            if entry not in special:
                self.bytes[k] = bytes(letter[c] for c in entry)
        merged = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        pre = told["pre_tokenizer"] or {}
        in_order = all(vocab.get(m.replace(" ", "", 1)) == 256 + k for k, m in enumerate(merged))
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        # where ids stand in the order of the merges the same merges are made faster by rank
        self.fast = None
        if in_order and plain and told["normalizer"] is None and not told["model"].get("ignore_merges"):
            ranks = {b: k for k, b in enumerate(self.bytes) if b}
            if len(ranks) == 256 + len(merged):
                self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.asarray(e.ids, dtype=np.int64) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            if len(t) > LONG_RUN and max(map(len, t.split())) > LONG_RUN:
                out.append(np.asarray(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int64))
            else:
                out.append(np.asarray(self.fast.encode_ordinary(t), dtype=np.int64))
        return out


class Pieces:
    """Vocabulary B: ids of texts, to which it adds a space in front, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.bytes = []
        for k in range(self.size):
            piece = self.library.id_to_piece(k)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(k) else piece.replace("▁", " ").encode("utf-8"))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, dtype=np.int64) for x in self.library.encode(texts, num_threads=1)]


@cache
def vocabularies(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Once a worker process."""
    return ByteLevel(a_path), Pieces(b_path)


def divide(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups [lo, hi) of A tokens, in order, of the intervals [lo, hi), which begin and end at shared cuts."""
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    reach = np.zeros(len(lo), dtype=np.int64)
    none = np.iinfo(np.int64).max
    while len(lo):
        one = hi - lo == 1
        if one.any():
            leaves.append((lo[one], hi[one]))
            lo, hi, reach = lo[~one], hi[~one], reach[~one]
            if not len(lo):
                break
        middle = (lo + hi - 2) // 2
        left, right = np.maximum(lo, middle - reach), np.minimum(hi - 2, middle + reach)
        width = right - left + 1
        first = np.cumsum(width) - width
        at = np.arange(int(width.sum())) + np.repeat(left - first, width)
        end = a_ends[at]
        hit = b_ends[np.minimum(np.searchsorted(b_ends, end), len(b_ends) - 1)] == end
        off = at - np.repeat(middle, width)
        near = np.minimum.reduceat(np.where(hit, 2 * np.abs(off) + (off > 0), none), first)
        found = near < none
        cut = middle[found] + np.where(near[found] & 1, 1, -1) * (near[found] >> 1) + 1
        leaf = ~found & (left == lo) & (right == hi - 2)
        if leaf.any():
            leaves.append((lo[leaf], hi[leaf]))
        wider = ~found & ~leaf
        lo, hi, reach = (
            np.concatenate([lo[found], cut, lo[wider]]),
            np.concatenate([cut, hi[found], hi[wider]]),
            np.concatenate([np.zeros(2 * len(cut), dtype=np.int64), 2 * reach[wider] + 1]),
        )
    if not leaves:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lo, hi = (np.concatenate(x) for x in zip(*leaves))
    order = np.argsort(lo)
    return lo[order], hi[order]


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights, first)


def by_group(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group: group, id, how many."""
    keys, n = summed(group * size + ids, np.ones(len(ids), dtype=np.int64))
    return keys // size, keys % size, n


def id_pairs(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, sizes: tuple[int, int], at_once: int = LINKS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct id pairs (a * size of B + b) of one document and their numbers of links, in blocks that share no pair."""
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    wa, wb = np.ones(len(a), dtype=np.int64), np.ones(len(b), dtype=np.int64)
    links = np.bincount(a_group, minlength=groups) * np.bincount(b_group, minlength=groups)
    if groups and links.max() > LARGE_GROUP:
        (a_group, a, wa), (b_group, b, wb) = by_group(a_group, a, sizes[0]), by_group(b_group, b, sizes[1])
    n_b = np.bincount(b_group, minlength=groups)
    b_first = np.cumsum(n_b) - n_b
    order = np.argsort(a, kind="stable")
    ends = np.cumsum(n_b[a_group[order]])
    begin = 0
    while begin < len(order):
        # tokens of the next A ids with some at_once links; an id with more of them is alone in its block
        base = ends[begin - 1] if begin else 0
        stop = int(np.searchsorted(ends, base + at_once, "right"))
        last = a[order[min(max(stop, begin + 1), len(order)) - 1]]
        stop = int(np.searchsorted(a[order], last, "left")) if stop < len(order) else len(order)
        if stop <= begin:
            stop = int(np.searchsorted(a[order], last, "right"))
        keys, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        x = begin
        while x < stop:
            base = ends[x - 1] if x else 0
            y = min(stop, max(x + 1, int(np.searchsorted(ends, base + at_once, "right"))))
            token = order[x:y]
            n = n_b[a_group[token]]
            each = np.repeat(token, n)
            other = np.arange(len(each)) + np.repeat(b_first[a_group[token]] - (np.cumsum(n) - n), n)
            got = summed(a[each] * sizes[1] + b[other], wa[each] * wb[other])
            keys, times = got if x == begin else summed(np.concatenate([keys, got[0]]), np.concatenate([times, got[1]]))
            x = y
        yield keys, times
        begin = stop


class Aligned:
    """Both encodings of some texts, with all tokens in one row and the groups they form."""

    def __init__(self, texts: list[str], a: ByteLevel, b: Pieces):
        self.sizes = (a.size, b.size)
        spaced = [" " + t for t in texts]
        a_ids, b_ids = a(spaced), b(texts)
        self.whole = []
        for k, t in enumerate(spaced):
            raw = t.encode("utf-8")
            same = len(raw) > 1 and all(b"".join(map(v.bytes.__getitem__, ids[k].tolist())) == raw for v, ids in ((a, a_ids), (b, b_ids)))
            self.whole.append(same)
            if not same:
                a_ids[k] = b_ids[k] = np.zeros(0, dtype=np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64) for ids in (a_ids, b_ids))
        length = [np.fromiter(map(len, v.bytes), dtype=np.int64, count=v.size) for v in (a, b)]
        self.a_ends, self.b_ends = np.cumsum(length[0][self.a]), np.cumsum(length[1][self.b])
        stop = np.cumsum(self.n_a)
        some = self.n_a > 0
        self.lo, self.hi = divide(self.a_ends, self.b_ends, (stop - self.n_a)[some], stop[some])
        self.b_hi = np.searchsorted(self.b_ends, self.a_ends[self.hi - 1]) + 1 if len(self.hi) else self.hi
        self.b_lo = np.r_[0, self.b_hi[:-1]] if len(self.hi) else self.hi
        #: First group of each text, and the end of the last.
        self.group = np.searchsorted(self.lo, np.r_[0, stop])
        self.a_group = np.repeat(np.arange(len(self.lo)), self.hi - self.lo)
        self.b_group = np.repeat(np.arange(len(self.lo)), self.b_hi - self.b_lo)
        self.a_at, self.b_at = np.r_[0, stop], np.r_[0, np.cumsum(self.n_b)]

    def n_links(self) -> list[int]:
        each = np.r_[0, np.cumsum((self.hi - self.lo) * (self.b_hi - self.b_lo))]
        return (each[self.group[1:]] - each[self.group[:-1]]).tolist()

    def pairs(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one text."""
        g = self.group[k]
        x, y = slice(self.a_at[k], self.a_at[k + 1]), slice(self.b_at[k], self.b_at[k + 1])
        return id_pairs(self.a[x], self.a_group[x] - g, self.b[y], self.b_group[y] - g, self.sizes)

    def digests(self, marked: list[bytes]) -> list[str]:
        """sha256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; ``marked`` has each number with ',', '|' and ';' behind it."""
        a_mark, b_mark = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        if len(self.hi):
            a_mark[self.hi - 1], b_mark[self.b_hi - 1] = 1, 2
        # A tokens of a group stand before its B tokens
        a_place = np.arange(len(self.a)) + self.b_lo[self.a_group] if len(self.a) else np.zeros(0, dtype=np.int64)
        b_place = np.arange(len(self.b)) + self.hi[self.b_group] if len(self.b) else np.zeros(0, dtype=np.int64)
        text = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        text[a_place], text[b_place] = 3 * self.a + a_mark, 3 * self.b + b_mark
        out = []
        for k, whole in enumerate(self.whole):
            told = b"".join(map(marked.__getitem__, text[self.a_at[k] + self.b_at[k] : self.a_at[k + 1] + self.b_at[k + 1]].tolist()))
            out.append(hashlib.sha256(told[:-1]).hexdigest() if whole else "")
        return out


@cache
def marked_numbers(n: int) -> list[bytes]:
    return list(chain.from_iterable((b"%d," % k, b"%d|" % k, b"%d;" % k) for k in range(n)))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Written table: a head row each document, with its digest and its first pairs, and further rows for more blocks of pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = vocabularies(a_path, b_path)
        marked = marked_numbers(max(a.size, b.size))
        row = TaskContext.get().partitionId() << 33
        for texts, ids in pieces_of(batches):
            got = Aligned(texts, a, b)
            links, digests, n_groups = got.n_links(), got.digests(marked), np.diff(got.group)
            out: dict[str, list] = {name.split()[0]: [] for name in ALIGNED.split(", ")}
            held = 0

            def batch() -> pa.RecordBatch:
                columns = {c: v for c, v in out.items() if c not in ("pairs", "times")}
                done = pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if c == "head" else pa.string() if c == "groups_sha256" else pa.int64()) for c, v in columns.items()] + [pa.array(out[c], pa.list_(pa.int64())) for c in ("pairs", "times")], names=list(out))
                for v in out.values():
                    v.clear()
                return done

            for k, doc_id in enumerate(ids.to_pylist()):
                head = True
                for pairs, times in chain(got.pairs(k) if got.whole[k] else (), [(None, None)]):
                    if pairs is None and not head:
                        break
                    told = (row, doc_id, head, int(got.n_a[k]), int(got.n_b[k]), int(n_groups[k]), links[k], digests[k], pairs, times) if head else (row, doc_id, False, *[None] * 5, pairs, times)
                    for c, v in zip(out.values(), told):
                        c.append(v)
                    head = False
                    held += 0 if pairs is None else len(pairs)
                    if held > LINKS_AT_ONCE:
                        yield batch()
                        held = 0
                row += 1
            if out["row"]:
                yield batch()
        give_back()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(read.mapInArrow(work, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """Written table of id pairs: in how many documents each is linked, and whether no pair of its A id is in more."""
    counted = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    best = counted.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("most"))  # a row an id of vocabulary A
    return written(counted.join(F.broadcast(best), F.expr(f"pair div {b_size}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def sent_from(counts: DataFrame, most: int) -> int:
    """The least count, a power of two, that at most ``most`` pairs reach."""
    sizes = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("n")).collect()}
    floor, told = 64, 0
    for b in range(63, -1, -1):
        told += sizes.get(b, 0)
        if told > most:
            break
        floor = b
    return 1 << floor


def align(docs: DataFrame, a_path: str, b_path: str, sent: int = SENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    _, b = vocabularies(a_path, b_path)
    aligned = aligned_documents(docs, a_path, b_path)
    counts = pair_counts(aligned, b.size)
    floor = sent_from(counts, sent)
    often = F.broadcast(counts.where(F.col("n") >= floor)) if floor < 1 << 63 else counts.limit(0)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    tally = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    parts = tally(each.join(often, each["pairs"] == often["pair"]))
    if floor > 1:
        rare = counts.where(F.col("n") < floor)
        parts = parts.unionByName(tally(each.join(often, each["pairs"] == often["pair"], "left_anti").join(rare.hint("merge"), F.col("pairs") == F.col("pair"))))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    heads = aligned.where("head").drop("head", "pairs", "times")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return heads.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, group, start, end, a_ids, b_ids) of each group: its place in the bytes of the text with a space before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabularies(a_path, b_path)
        for texts, ids in pieces_of(batches):
            got = Aligned(texts, a, b)
            text = np.repeat(np.arange(len(texts)), np.diff(got.group))
            n = len(text)
            base = np.r_[0, got.a_ends][got.a_at[:-1]]
            end = got.a_ends[got.hi - 1] - base[text] if n else np.zeros(0, dtype=np.int64)
            start = np.r_[0, got.a_ends][got.lo] - base[text] if n else end
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[lo, hi[-1:]] if n else np.zeros(1), pa.int32()), pa.array(v, pa.int32())) for lo, hi, v in ((got.lo, got.hi, got.a), (got.b_lo, got.b_hi, got.b))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)).cast(pa.int64()), pa.array(np.arange(n) - got.group[text]), pa.array(start), pa.array(end), *lists], names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")

"""N-gram Jaccard join: near-duplicate links and their components, by token-group matrices.

A document's tokens are its distinct word n-grams. Two documents link when their sets have a Jaccard similarity
of at least PERCENT/100. The join is exact: every link between different sets is either found or lies inside one
component that other links already connect.

1. *Screen.* The tokens of a document in hash order: of linked documents, any k-prefix longer than the tokens that may
   differ must share k tokens. Tasks count, per token of such a prefix, in how many documents it occurs; within a task's
   batch a token is counted once before it is dealt, so a passage that a third of all documents hold is one entry a
   batch. A document with too few shared tokens links with none and is done.
2. *Representatives.* Of equal sets one document goes on.
3. *Keys.* Of the documents left, tokens are counted in full. A document's rarest tokens, as many as may differ and one
   more, are its keys: linked documents share one. The documents of a key are its posting.
4. *Groups.* Every document is compared with the first document of each of its postings (its hubs). The links found this way
   gather similar documents into groups, however large they are, with one comparison a document and hub.
5. *What is left.* A token is open if documents of two groups hold it. A document with too few open ones among its rarest
   tokens (the screen's bound again), or then among all its tokens (the overlap that a link needs), links with no other group
   and is done. Of postings with the same documents one goes on.
6. *Token-group matrix.* In an open posting each group's token union is stored. The overlap of a query document with a union
   bounds its overlap with every member, so only groups that reach the needed overlap are opened and compared
   exactly; groups that a link has joined meanwhile are passed over, and only links that connect are returned. A posting
   of more than BLOCK_TOKENS tokens is dealt to blocks by sizes and groups (``dealt_blocks``).
7. *Components* of all links give each document its class.

Hashes of 64 bits stand for tokens. Edge cases: null or empty texts and texts without words have no tokens and link with
nothing; fewer than n words are one token; a null id can't be linked or named and stays alone; rows that repeat
an id count as one document, whose set is that of one of its rows (the one whose set has the least digest); ties need no
rule, as only components count; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, join_groups, tasks, written
from .components import components

NGRAM, PERCENT = 4, 85
#: Tokens, with repeats, and documents of one part of a large posting, and tokens of the blocks that one task solves together.
BLOCK_TOKENS, BLOCK_DOCS, TASK_TOKENS = 300_000, 600, 1_500_000
#: Documents that are compared with one copy of their hub.
HUB_ROWS = 500
#: Share of a document's tokens, beyond those that may differ, that the screen looks at.
SCREEN = 0.15
#: Bytes of text, or of tokens, that a task turns into one chunk.
CHUNK_BYTES = 8_000_000
#: Tokens that one counting task holds on average, and bytes of text with about as many screened tokens.
RANGE_TOKENS, RANGE_TEXT = 1_500_000, 24_000_000

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


def token_set(text: bytes | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams. ``text`` is UTF-8; bytes.lower() maps A-Z only."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], dtype=np.uint64)
    mixed = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k : k + len(mixed)]) * (_M1 if k % 2 else _M2)
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M4
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap that a set of this size has with any set it links with."""
    return -(-size * percent // 100)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of about CHUNK_BYTES; a larger row is a run of its own."""
    values = batch.column(column)
    sizes = pc.binary_length(values) if pa.types.is_string(values.type) else pc.multiply(pc.list_value_length(values), 8)
    sizes = [n or 0 for n in sizes.to_pylist()]
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_BYTES:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield batch.slice(a)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


CHUNKS = "kind int, chunk string, part int, doc_ids array<long>, marks array<long>, sizes array<int>, signs array<binary>, counts binary, tokens binary"


def _pack(kind: int, chunk: str, part: int, *, doc_ids=(), marks=(), sizes=(), signs=(), counts=b"", tokens=b"") -> dict:
    return {"kind": kind, "chunk": chunk, "part": part, "doc_ids": doc_ids, "marks": marks, "sizes": sizes, "signs": signs, "counts": counts, "tokens": tokens}


def _chunk_rows(chunk: str, doc_ids: list, marks: list, sets: list[np.ndarray], signs: list[bytes], sizes: np.ndarray, parts: int) -> Iterator[dict]:
    """One head row (documents, token count of each, place of each token among the chunk's distinct tokens) and the distinct tokens by range."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    distinct, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    lengths = np.fromiter(map(len, sets), dtype="<u4", count=len(sets))
    yield _pack(0, chunk, -1, doc_ids=doc_ids, marks=marks, sizes=sizes.tolist(), signs=signs, counts=lengths.tobytes(), tokens=place.astype("<u4").tobytes())
    edge = np.searchsorted((distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
    for r in np.flatnonzero(np.diff(edge)):
        a, b = edge[r], edge[r + 1]
        yield _pack(1, chunk, int(r), counts=np.minimum(n[a:b], 65535).astype("<u2").tobytes(), tokens=distinct[a:b].astype("<u8").tobytes())


_CHUNK_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.string()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("signs", pa.list_(pa.binary())), ("counts", pa.binary()), ("tokens", pa.binary())])


def _emit(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["tokens"])
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(held, schema=_CHUNK_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_CHUNK_ARROW)


def token_counts(chunks: DataFrame) -> DataFrame:
    """Per chunk and range, in how many documents each of the chunk's distinct tokens occurs (cut at 65535)."""

    def count(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        n = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.minimum(np.bincount(place, n, minlength=len(distinct)), 65535).astype("<u2")[place]
        cuts = np.cumsum([len(t) for t in tokens])[:-1]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "counts": pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())})

    return chunks.where("kind = 1").select("chunk", "part", "counts", "tokens").groupBy("part").applyInArrow(count, "chunk string, part int, counts binary")


def _with_counts(chunks: DataFrame, counts: DataFrame, per_chunk, schema: str, kind: str = "<u2") -> DataFrame:
    """Apply per_chunk(head row, count of each of the chunk's distinct tokens) -> table to every chunk; ``kind`` is a count's type."""

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        head, rest = rows[0], rows[1:]
        got = np.frombuffer(b"".join(r["counts"] for r in rest), kind)
        return per_chunk(head, got)

    heads = chunks.where("kind = 0").select("chunk", "part", "doc_ids", "marks", "sizes", "signs", "counts", "tokens")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("marks", "array<long>"), ("sizes", "array<int>"), ("signs", "array<binary>"))]
    back = counts.select("chunk", "part", *none, "counts", F.lit(None).cast("binary").alias("tokens"))
    return heads.unionByName(back).groupBy("chunk").applyInArrow(meet, schema)


def screen_chunks(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Chunks over the prefixes that the screen looks at, of every document with an id and a token."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, k = TaskContext.get().partitionId(), 0

        def rows():
            nonlocal k
            for batch in (part for whole in batches for part in _parts(whole, "text")):
                sets = [token_set(t, n) for t in _texts(batch)]
                size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                keep = np.minimum(size, size - needed(size, percent) + np.maximum(1, (SCREEN * size).astype(np.int64)))
                signs = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                k += 1
                yield from _chunk_rows(f"{name}-{k}", batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), [s[:p].copy() for s, p in zip(sets, keep)], signs, size, parts)

        yield from _emit(rows())
        give_back()

    return marked_texts(docs).mapInArrow(split, CHUNKS)


def marked_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the rows with an id; the mark tells rows of one id apart by their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _screen(percent: int):
    def judge(head: dict, counts: np.ndarray) -> pa.Table:
        size = np.array(head["sizes"], dtype=np.int64)
        lengths = np.frombuffer(head["counts"], "<u4")
        shared = counts[np.frombuffer(head["tokens"], "<u4")] > 1
        owner = np.repeat(np.arange(len(size)), lengths)
        n = np.bincount(owner[shared], minlength=len(size))
        own = lengths - np.minimum(lengths, size - needed(size, percent))  # k of this document's k-prefix
        # k differs between two linked documents: they share the smaller; sizes differ by PERCENT at most
        least = np.maximum(1, own * percent // 100 - 1)
        return pa.table({"doc_id": pa.array(head["doc_ids"], pa.int64()), "mark": pa.array(head["marks"], pa.int64()), "n": pa.array(size, pa.int32()), "sign": pa.array(head["signs"], pa.binary()), "open": pa.array((size > 0) & (n >= least))})

    return judge


def _own(size: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of its prefix a document looks at beyond those that may differ."""
    return np.maximum(1, np.minimum(needed(size, percent), (SCREEN * size).astype(np.int64)))


def _keys(percent: int):
    def choose(head: dict, counts: np.ndarray) -> pa.Table:
        size = np.array(head["sizes"], dtype=np.int64)
        place = np.frombuffer(head["tokens"], "<u4")
        owner = np.repeat(np.arange(len(size)), size)
        df = counts[place].astype(np.int64)
        # rank of each token within its document: rarest first, then by place (the order of hashes)
        order = np.lexsort((place, df, owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        differ, own = size - needed(size, percent), _own(size, percent)
        owner = owner[order]
        key = (rank < (differ + own)[owner]) & (df[order] > 1)
        at, owner, rank = order[key], owner[key], rank[key]
        tokens = np.frombuffer(head["counts"], "<u8")  # the head of this kind carries the distinct tokens
        ids = np.array(head["doc_ids"], dtype=np.int64)
        # linked documents share as many tokens of their prefixes as the one with fewer of them looks at
        least = np.maximum(1, own * percent // 100 - 1)
        return pa.table({"token": pa.array(tokens[place[at]].view(np.int64)), "doc_id": pa.array(ids[owner]), "size": pa.array(size[owner], pa.int32()), "key": pa.array(rank <= differ[owner]), "least": pa.array(least[owner], pa.int32())})

    return choose


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<int64> column as token arrays."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=True).view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def full_chunks(sets: DataFrame, parts: int) -> DataFrame:
    """Chunks over whole sets (doc_id, tokens); here the head row also carries the distinct tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, k = TaskContext.get().partitionId(), 0

        def rows():
            nonlocal k
            for batch in (part for whole in batches for part in _parts(whole, "tokens")):
                k += 1
                got = _sets(batch.column("tokens"))
                size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
                for row in _chunk_rows(f"{name}-{k}", batch.column("doc_id").to_pylist(), [], got, [], size, parts):
                    if row["kind"] == 0:
                        row["counts"] = np.unique(np.concatenate(got)).tobytes()
                    yield row

        yield from _emit(rows())
        give_back()

    return sets.mapInArrow(split, CHUNKS)


def block_links(ids: list[int], groups: list[int], home: list[bool], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect documents of different groups of a block, found through a token-group matrix.

    Queries are the documents at home in the block; a document that stands in several blocks is at home in one.
    """
    order = sorted(range(len(ids)), key=lambda i: groups[i])
    ids, home, sets = [ids[i] for i in order], [home[i] for i in order], [sets[i] for i in order]
    _, group = np.unique(np.array(groups, dtype=np.int64), return_inverse=True)
    group = np.sort(group)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(ids))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    # the matrix: each group's token union, one after another
    first = np.searchsorted(group, np.arange(group[-1] + 2))
    unions = [np.unique(flat[begin[a] : begin[b - 1] + size[b - 1]]) if b - a > 1 else flat[begin[a] : begin[a] + size[a]] for a, b in zip(first[:-1], first[1:])]
    u_len = np.fromiter(map(len, unions), dtype=np.int64, count=len(unions))
    u_flat, u_begin = np.concatenate(unions), np.cumsum(u_len) - u_len
    alone = np.diff(first) == 1
    parent = list(range(len(unions)))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    need = needed(size, percent)
    for q in np.flatnonzero(home):
        mine = flat[begin[q] : begin[q] + size[q]]
        mark[mine] = 1
        bound = np.add.reduceat(mark[u_flat], u_begin)
        open_ = np.flatnonzero(bound >= need[q])
        # the bound of a single document is its overlap
        open_ = open_[~alone[open_] | (100 * bound[open_] >= percent * (size[first[open_]] + size[q] - bound[open_]))]
        for g in open_:
            if root(g) == root(group[q]):
                continue
            members = np.arange(first[g], first[g + 1])
            members = members[(size[members] >= need[q]) & (need[members] <= size[q])]
            if not len(members):
                continue
            if alone[g]:
                got = bound[g : g + 1]
            else:
                n = size[members]
                ends = np.cumsum(n)
                got = np.add.reduceat(mark[flat[np.arange(ends[-1]) + np.repeat(begin[members] - (ends - n), n)]], ends - n)
            near = members[100 * got >= percent * (size[members] + size[q] - got)]
            if len(near):
                parent[max(root(g), root(group[q]))] = min(root(g), root(group[q]))
                links.append((int(ids[q]), int(ids[near[0]])))
        mark[mine] = 0
    return links


def _solve_blocks(percent: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("token", "ascending"), ("block", "ascending"), ("group", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        token, block = table.column("token").to_numpy(), table.column("block").to_numpy()
        cut = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1]), True]) if len(token) else np.zeros(1, np.int64)
        ids, groups, home = (table.column(c).to_pylist() for c in ("doc_id", "group", "home"))
        sets = _sets(table.column("tokens").chunk(0)) if len(token) else []
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            out += block_links(ids[a:b], groups[a:b], home[a:b], sets[a:b], percent)
        out = sorted(set(out))
        del sets
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return solve


def hub_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents with the first documents of their postings.

    A hub of many documents is copied, once for HUB_ROWS of them, so no task compares all that share a hub. Hubs are told in
    chunks, as in the screen: no posting is joined row by row.
    """
    docs = written(keys.groupBy("doc_id").agg(F.collect_list("token").alias("tokens")).select("doc_id", F.col("doc_id").alias("group"), F.lit(0).alias("least"), "tokens"), "key-sets")
    chunks = written(group_chunks(docs, _ranges(docs)), "key-chunks")
    pairs = written(_with_counts(chunks, group_spans(chunks, first=True), _hub_pairs, "a long, b long", "<i8").distinct(), "hub-pairs")
    discard(docs, chunks)
    many = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "hub-sizes")
    copies = F.ceil(F.col("n") / HUB_ROWS).cast("int")
    ask = join_groups(pairs, many, "b", "n").select("a", "b", F.pmod(F.xxhash64("a"), copies).cast("int").alias("copy"))
    member = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    hub = many.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b").select("b", "y", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    met = ask.join(member.hint("merge"), "a").join(hub.hint("merge"), ["b", "copy"])
    both = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("n"))
    links = written(both.where(100 * F.col("o") >= percent * (F.col("n") - F.col("o"))).select("a", "b"), "hub-links")
    discard(pairs, many)
    return links


def _ranges(sets: DataFrame) -> int:
    """Into how many ranges the tokens of the sets are dealt."""
    return int((sets.agg(F.sum(F.size("tokens"))).first()[0] or 0) // RANGE_TOKENS) + 1


def _hub_pairs(head: dict, first: np.ndarray) -> pa.Table:
    """Each document with the first documents of its tokens, but for itself."""
    ids = np.array(head["doc_ids"], dtype=np.int64)
    a, b = np.repeat(ids, head["sizes"]), first[np.frombuffer(head["tokens"], "<u4")]
    a, b = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _opened(head: dict, open_: np.ndarray) -> pa.Table:
    ids = np.array(head["doc_ids"], dtype=np.int64)
    owner = np.repeat(np.arange(len(ids)), head["sizes"])
    n = np.bincount(owner[open_[np.frombuffer(head["tokens"], "<u4")] > 0], minlength=len(ids))
    return pa.table({"doc_id": pa.array(ids[n >= np.array(head["marks"], dtype=np.int64)], pa.int64())})


def open_enough(sets: DataFrame) -> DataFrame:
    """Ids of ``sets(doc_id, group, least, tokens)`` of which at least ``least`` tokens stand in sets of other groups too."""
    chunks = written(group_chunks(sets, _ranges(sets)), "left-chunks")
    left = written(_with_counts(chunks, group_spans(chunks), _opened, "doc_id long").distinct(), "left-ids")
    discard(chunks)
    return left


def sifted(keys: DataFrame) -> DataFrame:
    """``keys(token, doc_id, group, least, ...)`` without the documents that share fewer than ``least`` of their tokens with other groups.

    The tokens are looked at in chunks, a row a document: no posting is joined row by row.
    """
    docs = written(keys.groupBy("doc_id").agg(F.first("group").alias("group"), F.first("least").alias("least"), F.collect_list("token").alias("tokens")), "key-sets")
    enough = open_enough(docs)
    kept = written(keys.join(enough.hint("merge"), "doc_id", "left_semi"), "sifted-keys")
    discard(docs, enough)
    return kept


def group_spans(chunks: DataFrame, first: bool = False) -> DataFrame:
    """Per chunk and range, for each of the chunk's distinct tokens whether documents of two groups hold it (1) or not (0).

    With ``first`` the least group that holds it.
    """

    def span(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        ends = [np.frombuffer(x, "<i8").reshape(2, -1) for x in table.column("counts").to_pylist()]
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        low, high = (f.reduceat(np.concatenate([e[k] for e in ends])[order], begin) for k, f in enumerate((np.minimum, np.maximum)))
        told = np.empty(len(flat), "<i8" if first else "<u2")
        told[order] = np.repeat(low if first else low != high, np.diff(np.r_[begin, len(flat)]))
        cuts = np.cumsum([len(t) for t in tokens])[:-1]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "counts": pa.array([x.tobytes() for x in np.split(told, cuts)], pa.binary())})

    return chunks.where("kind = 1").select("chunk", "part", "counts", "tokens").groupBy("part").applyInArrow(span, "chunk string, part int, counts binary")


def group_chunks(sets: DataFrame, parts: int) -> DataFrame:
    """Chunks over sets (doc_id, group, least, tokens), ``least`` as mark; with each distinct token go its least and largest group."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, k = TaskContext.get().partitionId(), 0

        def rows():
            nonlocal k
            for batch in (part for whole in batches for part in _parts(whole, "tokens")):
                k += 1
                got = _sets(batch.column("tokens"))
                size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
                group = np.repeat(batch.column("group").to_numpy(), size)
                distinct, place = np.unique(np.concatenate(got), return_inverse=True)
                order = np.argsort(place, kind="stable")
                first = np.searchsorted(place[order], np.arange(len(distinct)))
                ends = np.stack([f.reduceat(group[order], first) for f in (np.minimum, np.maximum)]) if len(distinct) else np.zeros((2, 0), np.int64)
                chunk = f"{name}-{k}"
                yield _pack(0, chunk, -1, doc_ids=batch.column("doc_id").to_pylist(), marks=batch.column("least").to_pylist(), sizes=size.tolist(), tokens=place.astype("<u4").tobytes())
                edge = np.searchsorted((distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                for r in np.flatnonzero(np.diff(edge)):
                    x, y = edge[r], edge[r + 1]
                    yield _pack(1, chunk, int(r), counts=ends[:, x:y].astype("<i8").tobytes(), tokens=distinct[x:y].astype("<u8").tobytes())

        yield from _emit(rows())
        give_back()

    return sets.mapInArrow(split, CHUNKS)


def shared_enough(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``keys`` of the documents that can link with another group.

    First by the tokens of their prefixes, then, for those that are left, by all tokens: a link needs an overlap of
    ``needed``, so that many of a document's tokens must stand in documents of other groups. Whole sets are looked at in chunks, as in the
    screen: no row is made for each token of each document.
    """
    prefix = sifted(keys)
    docs = prefix.groupBy("doc_id").agg(F.first("group").alias("group"))
    need = F.floor((F.size("tokens") * percent + 99) / 100).cast("int").alias("least")
    whole = written(docs.join(sets.hint("merge"), "doc_id").select("doc_id", "group", need, "tokens"), "left-sets")
    left = open_enough(whole)
    kept = written(prefix.join(left.hint("merge"), "doc_id", "left_semi"), "left-keys")
    discard(prefix, whole, left)
    return kept


def dealt_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of large postings, ``rows(token, doc_id, size, group)``, dealt to blocks: (token, doc_id, size, group, block, home).

    Sizes of linked documents differ by the similarity at most, so a posting falls into windows of sizes; a document
    stands in its own, where it is at home, and as a guest in the next one. In a window the parts of the largest group meet the parts of
    the others, and those meet each other; documents of the largest group need not meet.
    """
    step = log(100 / percent) * 1.000001
    own = F.floor(F.log(F.col("size").cast("double")) / step)
    places = F.explode(F.array(*[F.struct((own + k).alias("window"), F.lit(k == 0).alias("home")) for k in (0, 1)])).alias("x")
    windows = rows.select("token", "doc_id", "size", "group", places).select("token", "doc_id", "size", "group", "x.*").withColumn("sub", F.xxhash64("token", "window"))
    windows = written(windows, "windows")
    # a document counts as so many tokens at least that a part has BLOCK_DOCS documents at most
    weight = F.greatest("size", F.lit(-(-BLOCK_TOKENS // BLOCK_DOCS)))
    loads = windows.groupBy("sub", "group").agg(F.count("*").alias("n"), F.sum(weight).alias("load"))
    subs = loads.groupBy("sub").agg(F.sum("n").alias("n"), F.max_by("group", "load").alias("main"), F.max("load").alias("most"), F.sum("load").alias("load"))
    count = lambda load: F.ceil(load / BLOCK_TOKENS).cast("int")
    subs = written(subs.where("load > most").select("sub", "n", "main", count(F.col("most")).alias("km"), count(F.col("load") - F.col("most")).alias("ko")), "sub-postings")
    met = join_groups(windows, subs, "sub", "n")
    of = F.xxhash64("doc_id")
    mine = F.when(F.col("group") == F.col("main"), F.pmod(of, F.col("km"))).otherwise(F.pmod(of, F.col("ko"))).cast("string")
    name = lambda kind, x, y: F.concat(F.col("window").cast("string"), F.lit(kind), x, F.lit("-"), y)
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: f(j.cast("string")))
    by_main = every("ko", lambda j: name("m", mine, j))
    by_rest = F.concat(every("km", lambda i: name("m", i, mine)), every("ko", lambda j: name("o", F.least(j, mine), F.greatest(j, mine))))
    blocks = F.explode(F.when(F.col("group") == F.col("main"), by_main).otherwise(by_rest)).alias("block")
    return met.select("token", "doc_id", "size", "group", blocks, "home")


def posting_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the groups of open postings; ``keys(token, doc_id, size, group)``."""
    spark = keys.sparkSession
    of = F.xxhash64("doc_id")
    told = keys.groupBy("token").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.bit_xor(of).alias("xor"), F.sum(of.cast("decimal(20,0)")).alias("sum"), (F.min("group") != F.max("group")).alias("open")).where("open")
    # postings with the same documents: one goes on
    one = told.groupBy("n", "xor", "sum").agg(F.min("token").alias("token"), F.first("load").alias("load"))
    one = written(one.select("token", "n", ((F.col("load") > BLOCK_TOKENS) | (F.col("n") > BLOCK_DOCS)).alias("large")), "postings")
    rows = written(join_groups(keys.select("token", "doc_id", "size", "group"), one, "token", "n"), "posting-rows")
    dealt = rows.where("not large").select("token", "doc_id", "size", "group", F.lit("").alias("block"), F.lit(True).alias("home"))
    if one.where("large").count():
        dealt = dealt.unionByName(dealt_blocks(rows.where("large"), percent))
    dealt = written(dealt, "blocks")
    total = dealt.agg(F.sum("size")).first()[0] or 0
    task = F.pmod(F.xxhash64("token", "block"), F.lit(max(tasks(spark), int(total // TASK_TOKENS) + 1))).alias("task")
    load = dealt.join(sets.hint("merge"), "doc_id").select("token", "block", "group", "doc_id", "home", "tokens", task)
    links = written(load.groupBy("task").applyInArrow(_solve_blocks(percent), "a long, b long"), "posting-links")
    discard(one, rows, dealt)
    return links


def near_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect the components of ``sets(doc_id, tokens array<long>)`` (distinct, not empty)."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    chunks = written(full_chunks(sets.select("doc_id", "tokens"), int(total // RANGE_TOKENS) + 1), "sets")
    found = written(_with_counts(chunks, token_counts(chunks), _keys(percent), "token long, doc_id long, size int, key boolean, least int"), "keys")
    discard(chunks)
    by_hub = hub_links(found.where("key").select("token", "doc_id"), sets, percent)
    groups = components(by_hub).select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    grouped = written(found.join(groups, "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id")), "grouped-keys")
    discard(found)
    left = shared_enough(grouped, sets, percent)
    by_posting = posting_links(left.where("key"), sets, percent)
    discard(grouped)
    return by_hub.unionByName(by_posting)


def jaccard_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(tasks(docs.sparkSession), int(text_bytes // RANGE_TEXT) + 1)
    chunks = written(screen_chunks(docs, n, percent, parts), "screen")
    judged = written(_with_counts(chunks, token_counts(chunks), _screen(percent), "doc_id long, mark long, n int, sign binary, open boolean"), "judged")
    discard(chunks)
    one = judged.groupBy("doc_id").agg(F.min_by(F.struct("mark", "n", "sign", "open"), F.struct("sign", "mark")).alias("x")).select("doc_id", "x.*")
    # of equal sets the smallest id goes on; a set that repeats was counted twice, so all its documents are open
    open_docs = written(one.where("open").select("doc_id", "mark", "sign"), "open")
    same = written(open_docs.groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "same-sets")
    member = written(join_groups(open_docs, same, "sign", "rows").select("doc_id", "mark", "rep"), "same")
    discard(open_docs, same)
    wanted = member.where("doc_id = rep").select("doc_id", "mark")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tokens": pa.array([token_set(t, n).view(np.int64) for t in _texts(batch)], pa.list_(pa.int64()))})
        give_back()

    # the wanted ids grow with the data: never broadcast
    picked = marked_texts(docs).join(wanted.hint("merge"), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    sets = written(picked.select("doc_id", "text").mapInArrow(encode, "doc_id long, tokens array<long>"), "tokens")
    links = written(near_links(sets, percent).unionByName(member.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "near-links")
    discard(sets, member)
    named = components(links).withColumnRenamed("id", "doc_id")
    discard(links)
    size = one.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(size, "doc_id", "left").join(named, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

"""Toxicity: a bag of hashed subwords, averaged embeddings and a linear softmax, trained jointly in numpy.

A passage (``WINDOW`` characters) is the bag of the character n-grams of its words, word edges included, so
a misspelling that was never seen shares most of its vectors with the known word. A text scores as its most
toxic passage, because a few words in a long text must not be averaged away. Training alternates: choose the
passages that stand for each labelled text (the strongest of a toxic text; the strongest and random
ones of a clean text), then fit embeddings and softmax on them. The first choice is by the log odds of each n-gram to stand in
a toxic text. A logistic fit on the training texts maps the
strongest passage to a probability.

Since averaging and the softmax's input are linear, the fitted model is folded to one weight a slot for
scoring. Every character of a text is scored.

Edge cases: null counts as empty; an empty text has no passage and gets the lowest score; null ids or labels
are not learnt; an empty or one-sided label table gives score 0 everywhere; repeated labels of one id count
once (the highest); ties need no rule; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import chunks, gram_slots, letters

#: Labelled rows that training reads at most of either class, in expectation (chosen by a hash of the id).
TRAIN_ROWS_PER_CLASS = 1200
#: Characters that training holds at once, and those of one row; rows that go beyond are left out of the fit, unless their
#: class would have none.
TRAIN_CHARS, ROW_CHARS = 12_000_000, 400_000
BITS = 18
SIZES = (3, 4, 5)
WINDOW = 32
#: Training texts that an n-gram must occur in to get a vector; rarer ones stay neutral.
MIN_TEXTS = 4
DIM = 8
ROUNDS, STEPS, RATE = 4, 50, 0.05
#: Pull of the embeddings to zero.
RIDGE = 1e-3


def prepare(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Start of each text, slots of each n-gram size by position (-1: none), code length."""
    code, starts = letters(texts, disguised=True)
    slots = []
    for n in SIZES:
        slot, ok = gram_slots(code, n, BITS)
        full = np.full(len(code), -1, dtype=np.int32)
        full[: len(slot)] = np.where(ok, slot.astype(np.int32), -1)
        slots.append(full)
    return starts, slots, np.int64(len(code))


def prepared(texts: list[str]) -> Iterator[tuple[int, int, tuple[np.ndarray, list[np.ndarray], np.ndarray]]]:
    """Runs of texts with their slots."""
    for a, b in chunks(texts):
        yield a, b, prepare(texts[a:b])


def strongest(texts: list[str], weight: np.ndarray, runs: Iterable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of the strongest passage of each text (-inf: no n-gram), and where it starts in the text.

    ``runs`` are the texts' slots (``prepared``) where they are kept.
    """
    best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64)
    padded = np.append(weight, np.float32(0))  # slot -1 adds nothing
    for a, b, (starts, slots, size) in prepared(texts) if runs is None else runs:
        total, count = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
        for slot in slots:
            total[1:] += padded[slot]
            count[1:] += slot >= 0
        np.cumsum(total, out=total)
        np.cumsum(count, out=count)
        # a text with its leading space is [starts - 1, next start - 1)
        begin, end = starts[:-1] - 1, starts[1:] - 1
        at = np.arange(size)
        limit = np.repeat(end, end - begin)
        at = at[: len(limit)]
        stop = np.minimum(at + WINDOW, limit)
        n = count[stop] - count[at]
        mean = np.where(n > 0, (total[stop] - total[at]) / np.maximum(n, 1), -np.inf)
        # short tails are no passages of their own: a window cut by the end of its text counts only as the text's first
        cut = (at + WINDOW > limit) & (at != np.repeat(begin, end - begin))
        mean[cut] = -np.inf
        top = np.maximum.reduceat(mean, begin)
        best[a:b] = top
        first = np.flatnonzero(mean == np.repeat(top, end - begin))
        owner = np.repeat(np.arange(b - a), end - begin)[first]
        seen, index = np.unique(owner, return_index=True)
        where[a + seen] = first[index] - begin[seen]
    return best, where


def texts_by_slot(texts: list[str]) -> np.ndarray:
    """In how many of the texts each slot occurs."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    for a, b in chunks(texts):
        row, slot, _ = bags(texts[a:b])
        total += np.bincount(slot, minlength=1 << BITS)
    return total


def bags(passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the passages: row, slot and share of the row's n-grams."""
    starts, slots, _ = prepare(passages)
    owner = np.repeat(np.arange(len(passages)), np.diff(starts))
    row, slot = [], []
    for s in slots:
        at = np.flatnonzero(s[: len(owner)] >= 0)
        row.append(owner[at])
        slot.append(s[at])
    row, slot = np.concatenate(row), np.concatenate(slot).astype(np.int64)
    key, n = np.unique((row << BITS) | slot, return_counts=True)
    row, slot = key >> BITS, key & ((1 << BITS) - 1)
    return row, slot, n / np.bincount(row, n, minlength=len(passages))[row]


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Folded weight of each slot, then slope and offset of the logistic map."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    pos, neg = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    in_pos, in_neg = (texts_by_slot([texts[i] for i in at]) for at in (pos, neg))
    common = in_pos + in_neg >= MIN_TEXTS
    weight = np.where(common, np.log((in_pos + 0.5) / (len(pos) + 1)) - np.log((in_neg + 0.5) / (len(neg) + 1)), 0).astype(np.float32)
    runs = list(prepared(texts))  # 12 bytes a character, which every round needs
    for _ in range(ROUNDS):
        passages, label = [], []
        _, where = strongest(texts, weight, runs)
        for i in pos:
            passages.append(texts[i][max(0, where[i] - 1) : where[i] + WINDOW])
            label.append(1)
        for i in neg:
            spots = [where[i], *rng.integers(0, max(1, len(texts[i]) - WINDOW), 8)]
            passages += [texts[i][max(0, s - 1) : s + WINDOW] for s in spots]
            label += [0] * len(spots)
        row, slot, share = bags(passages)
        frequent = common[slot]
        row, slot, share = row[frequent], slot[frequent], share[frequent].astype(np.float32)
        y = np.array(label)
        cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        used, slot = np.unique(slot, return_inverse=True)
        by_slot = np.argsort(slot, kind="stable")
        edges_row = np.searchsorted(row, np.arange(len(passages)))
        edges_slot = np.searchsorted(slot[by_slot], np.arange(len(used)))
        filled = np.bincount(row, minlength=len(passages)) > 0
        part = table[used]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (part, soft, bias)]
        for step in range(1, STEPS + 1):
            mean = np.zeros((len(passages), DIM), dtype=np.float32)
            mean[filled] = np.add.reduceat(part[slot] * share[:, None], edges_row[filled], axis=0)
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= cost[:, None]
            back = (p @ soft.T).astype(np.float32)
            grads = (np.add.reduceat((back[row] * share[:, None])[by_slot], edges_slot, axis=0) + np.float32(RIDGE) * part, mean.T @ p, p.sum(axis=0))
            for x, g, (m, v) in zip((part, soft, bias), grads, state):  # Adam
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        table[used] = part
        folded = table @ (soft[:, 1] - soft[:, 0])
        weight = np.zeros(1 << BITS, dtype=np.float32)
        weight[used] = folded[used]  # slots that training never saw are neutral
    best, _ = strongest(texts, weight, runs)
    return weight, *logistic(np.where(np.isfinite(best), best, -1.0), toxic)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a balanced logistic fit with a small ridge (Newton's method)."""
    mid, scale = x.mean(), x.std() or 1.0
    z = (x - mid) / scale
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    design, beta = np.stack([z, np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (cost * (p - y)) + 1e-3 * np.array([beta[0], 0])
        hess = (design * (cost * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        beta -= np.linalg.solve(hess, grad)
    return float(beta[0] / scale), float(beta[1] - beta[0] * mid / scale)


class ToxicityModel:
    def __init__(self, weight: np.ndarray | None, slope: float = 0.0, offset: float = 0.0):
        self.weight, self.slope, self.offset = weight, slope, offset

    def score(self, texts: list[str | None]) -> np.ndarray:
        plain = [t or "" for t in texts]
        if self.weight is None:
            return np.zeros(len(plain))
        best, _ = strongest(plain, self.weight)
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(best), 1 / (1 + np.exp(-(self.slope * np.where(np.isfinite(best), best, 0) + self.offset))), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labels: about ``rows_per_class`` rows of either class.

    The draw is on the label table alone; the drawn ids, bounded by twice that number in expectation, are then
    broadcast to the documents, so texts are not shuffled.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / sizes.get(1, 1))).otherwise(min(1.0, rows_per_class / sizes.get(0, 1)))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def fit(labelled: DataFrame) -> ToxicityModel:
    """Fit from the bounded rows of ``labelled(doc_id, text, toxic)``, as ``labelled_sample`` gives them.

    The fit itself runs in one task over that sample and returns only the folded model.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, str]]] = {0: [], 1: []}
        spare: dict[int, tuple[int, str]] = {}  # the shortest row of a class that was left out
        size = {0: 0, 1: 0}
        for batch in batches:
            for doc_id, text, toxic in batch.itertuples(index=False):
                text = text or ""
                if len(text) <= ROW_CHARS and size[toxic] + len(text) <= TRAIN_CHARS // 2:
                    held[toxic].append((doc_id, text))
                    size[toxic] += len(text)
                elif toxic not in spare or len(text) < len(spare[toxic][1]):
                    spare[toxic] = (doc_id, text)
        rows = [(i, t, c) for c in (0, 1) for i, t in held[c] or [x for x in (spare.get(c),) if x]]
        if not rows:
            return
        got = pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]).sort_values(["doc_id", "text"])
        got = got.iloc[np.random.default_rng(1).permutation(len(got))]
        y = got["toxic"].to_numpy()
        if len(set(y)) == 2:
            weight, slope, offset = train(got["text"].tolist(), y)
            yield pd.DataFrame({"weight": [weight.tobytes()], "slope": [slope], "offset": [offset]})

    got = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id")).mapInPandas(learn, "weight binary, slope double, offset double").collect()
    return ToxicityModel(np.frombuffer(got[0]["weight"], dtype=np.float32), got[0]["slope"], got[0]["offset"]) if got else ToxicityModel(None)


def score(docs: DataFrame, model: ToxicityModel, score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text; only ``text`` is read for it. A column of that name is replaced."""
    keep = [c for c in docs.columns if c != score_col]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(score_col, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.select(*keep).mapInArrow(add, schema)

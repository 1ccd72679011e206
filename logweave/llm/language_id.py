"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (2^bits slots by languages) is fitted from counts that Spark sums over a
bounded sample of labelled rows, broadcast, and applied to Arrow batches in numpy: each text is a sparse
vector of n-gram counts, scored by gathering matrix rows and summing them per text.

Edge cases: a null text or one without letters is ``und`` with score 0; a null id is never learnt from;
null labels are not learnt, and every other label is, up to MAX_LANGS (beyond that the fit raises); an empty training table gives ``und`` everywhere; ties go to the first
language in sorted order; repeated rows are scored alike; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back
from .textbatch import chunks, gram_slots, letters

#: Rows of each language that training reads at most, in expectation (chosen by a hash of the id).
TRAIN_ROWS_PER_LANG = 3000
#: The most languages one model holds; bounds the broadcast matrix to 2^BITS * MAX_LANGS floats. More are refused.
MAX_LANGS = 1000
BITS = 15
SIZES = (2, 3)
UNKNOWN = "und"


def gram_counts(texts: list[str], bits: int = BITS) -> np.ndarray:
    """Counts of the hashed n-grams of all the texts together."""
    total = np.zeros(1 << bits, dtype=np.int64)
    for a, b in chunks(texts):
        code, _ = letters(texts[a:b])
        for n in SIZES:
            slot, ok = gram_slots(code, n, bits)
            total += np.bincount(slot[ok], minlength=1 << bits)
    return total


def score_texts(texts: list[str], matrix: np.ndarray, prior: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each text the log posterior (up to a constant) of each language, and its number of n-grams."""
    out = np.zeros((len(texts), matrix.shape[1]))
    grams = np.zeros(len(texts), dtype=np.int64)
    for a, b in chunks(texts):
        code, starts = letters(texts[a:b])
        for n in SIZES:
            slot, ok = gram_slots(code, n, bits)
            # n-grams that begin at the space before a text belong to it
            at = np.flatnonzero(ok)
            cut = np.searchsorted(at, starts - 1)
            rows = matrix[slot[at]]
            count = np.diff(cut)
            grams[a:b] += count
            full = np.flatnonzero(count)
            if len(full):
                out[a + full] += np.add.reduceat(rows, cut[full], axis=0, dtype=np.float64)
    return out + prior, grams


class LanguageModel:
    """Languages in sorted order, log-probability matrix (slots by languages) and log prior."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        plain = [t or "" for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(plain), np.zeros(len(plain))
        logp, _ = score_texts(plain, self.matrix, self.prior)
        best = logp.argmax(axis=1)
        score = 1 / np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.fromiter((any(map(str.isalpha, t)) for t in plain), dtype=bool, count=len(plain))
        names = [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        return names, np.where(known, score, 0.0)


def fit(labelled: DataFrame, rows_per_lang: int = TRAIN_ROWS_PER_LANG) -> LanguageModel:
    """Fit from ``labelled(doc_id, text, lang)``.

    Of each language about ``rows_per_lang`` rows are read, chosen by a hash of the id, so the pass over
    the texts is bounded; how many rows each language has is counted over all rows.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: their matrix would not fit; raise language_id.MAX_LANGS or BITS to suit")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / sizes[k])))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                sums[lang] = sums.get(lang, 0) + gram_counts([t or "" for t in texts])
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": at, "n": total[at]})

    counts = rows.where(drawn).select("lang", "text").mapInPandas(count, "lang string, slot long, n long")
    got = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << BITS, len(langs)))
    table[got["slot"].to_numpy(), got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()] = got["n"].to_numpy()
    table += 0.5
    total = np.array([sizes[k] for k in langs], dtype=float)
    return LanguageModel(langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(total / total.sum()))


def identify(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior; only ``text`` is read for it.

    Columns of those two names in ``docs`` are replaced.
    """
    keep = [c for c in docs.columns if c not in (lang_col, score_col)]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_col, score_col])
        give_back()

    return docs.select(*keep).mapInArrow(score, schema)

"""Toxicity: scoring against a brute-force version, and held-out quality at sf0.1."""

import numpy as np
import pandas as pd

from logweave.llm import queries as Q
from logweave.llm import toxicity as X


def brute_strongest(text, weight):
    """Every passage of WINDOW characters of the text with its leading space: the mean weight of the n-grams that begin in it."""
    starts, slots, _ = X.prepare([text])
    begin, end = int(starts[0]) - 1, int(starts[1]) - 1
    best, where = -np.inf, 0
    for at in range(begin, end):
        if at != begin and at + X.WINDOW > end:
            break
        grams = [int(s[p]) for s in slots for p in range(at, min(at + X.WINDOW, end)) if s[p] >= 0]
        mean = np.mean([weight[g] for g in grams]) if grams else -np.inf
        if mean > best + 1e-9:
            best, where = mean, at - begin
    return best, where


def test_scoring_equals_brute_force():
    rng = np.random.default_rng(1)
    weight = rng.normal(0, 1, 1 << X.BITS).astype(np.float32)
    words = "the house idi0t stupid über ÉCOLE 日本 x . , 12 st*pid a@b".split()
    texts = ["", " ", "a", "...", "word " * 40, *(" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(60)), " ".join(f"w{k}x" for k in range(3000))]
    best, where = X.strongest(texts, weight)
    kept, places = X.strongest(texts, weight, list(X.prepared(texts)))
    assert np.array_equal(best, kept) and np.array_equal(where, places)
    for text, b, w in zip(texts, best, where):
        wanted, at = brute_strongest(text, weight)
        assert (not np.isfinite(wanted) and not np.isfinite(b)) or abs(wanted - b) < 1e-4
        if np.isfinite(wanted):
            again = X.prepare([text])
            begin, end = int(again[0][0]) - 1, int(again[0][1]) - 1
            grams = [int(s[p]) for s in again[1] for p in range(begin + int(w), min(begin + int(w) + X.WINDOW, end)) if s[p] >= 0]
            assert abs(np.mean(weight[grams]) - wanted) < 1e-4
    # ties and repeated rows: equal texts have equal scores, null counts as empty
    model = X.ToxicityModel(weight, 1.0, 0.0)
    scores = model.score(["the house", None, "the house", ""])
    assert scores[0] == scores[2] and scores[1] == scores[3] == 0


def test_op5_held_out_quality_at_a_tenth(spark):
    """A sixth of the held-out toxic rows has no toxic word at all (their labels are noise), so recall ends near 0.84."""
    sf = "/root/testdata/sf0.1"
    got = Q.op5_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert held[held["toxic"] == 1]["predicted"].mean() >= 0.82
    assert held[held["toxic"] == 0]["predicted"].mean() <= 0.012

"""Registered queries against their SQL, or against brute force where SQL can't express them (sf0.001)."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from logweave.llm import queries as Q
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name], SF)


def test_op3_equals_direct_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    got = Q.op3_token_output(spark, SF).toPandas().set_index("doc_id")
    start = 0
    for doc_id, text in documents().sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        row = got.loc[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8_equals_plain_regexes(spark):
    got = Q.op8_secret_scan(spark, SF).toPandas().set_index("doc_id")
    key = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    found = 0
    for doc_id, text in documents()[["doc_id", "text"]].itertuples(index=False):
        spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        told = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        row = got.loc[doc_id]
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        found += len(spans)
    assert found


def test_op9_held_out_accuracy(spark):
    got = Q.op9_language_id(spark, SF).toPandas().merge(documents()[["doc_id", "lang"]], on="doc_id")
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_op5_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op5_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.1
    assert held[held["toxic"] == 1]["score"].mean() > held[held["toxic"] == 0]["score"].mean() + 0.4


def test_op10_reaches_its_targets(spark):
    got = Q.op10_mixing(spark, SF).toPandas()
    weight = got["n_tokens"] * got["rate"] / got["n_tokens"].sum()
    for d, t in Q.TARGETS.items():
        assert abs((weight * got[f"p_{d}"]).sum() - t) < 0.02
    assert (got["rate"] >= 0).all() and np.allclose(got[["p_good", "p_poor", "p_toxic"]].sum(axis=1), 1)

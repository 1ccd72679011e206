"""Token alignment, embedding whitening and URL filtering against brute force, and their edge cases."""

import hashlib
import math
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm import queries as Q
from logweave.llm import token_alignment as A
from logweave.llm import url_filter as U
from logweave.llm import whitening as W

SF = "/root/testdata/sf0.001"
PATHS = (Q.vocabulary("byte_bpe_50k.json"), Q.vocabulary("piece_bpe_32k.model"))

ODD = [None, "", "a", " ", "x <|endoftext|> </s> <0x41>", "a\x00b", "😀😀 ééé", "holds ▁ itself", "don't I'VE 12345", "  \r\n\n \t x ", "q" * 30_000, "the " * 5_000, "日本語の文" * 40]


def brute_groups(text):
    a, b = A.vocabularies(*PATHS)
    if not text:
        return None
    raw = (" " + text).encode()
    x, y = a.library.encode(" " + text, add_special_tokens=False).ids, b.library.encode(text)
    if any(b"".join(v.bytes[i] for i in ids) != raw for v, ids in ((a, x), (b, y))):
        return None
    ends = [np.cumsum([len(v.bytes[i]) for i in ids]).tolist() for v, ids in ((a, x), (b, y))]
    out, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for k, ids in enumerate((x, y)):
            begin = at[k]
            while at[k] < len(ids) and ends[k][at[k]] <= cut:
                at[k] += 1
            group.append(ids[begin : at[k]])
        out.append(group)
    return out


def brute_alignment(rows):
    links, told = [], []
    for _, text in rows:
        groups = brute_groups(text)
        c = Counter()
        for p, q in groups or []:
            c.update((i, j) for i in p for j in q)
        links.append(c)
        told.append(groups)
    docs = Counter(pair for c in links for pair in c)
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, _), groups, c in zip(rows, told, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups or [])
        out.append((doc_id, sum(len(p) for p, _ in groups or []), sum(len(q) for _, q in groups or []), len(groups or []), c.total(), sum(n for pair, n in c.items() if docs[pair] == best[pair[0]]), sum(n * docs[pair] for pair, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_op11_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert plain(Q.op11_token_alignment(spark, SF)) == brute_alignment(list(docs[["doc_id", "text"]].itertuples(index=False, name=None)))


@pytest.mark.parametrize("sent", [500_000, 40, 0])
def test_op11_odd_rows(spark, make_docs, sent):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(2, "a"), (None, "the house"), (None, None), (7, "the house and the house")]
    got = A.align(make_docs(rows, clash=["n_a", "row", "pairs", "head"]), *PATHS, sent=sent)
    assert plain(got) == brute_alignment(rows)


def test_op11_empty_table(spark, make_docs):
    assert plain(A.align(make_docs([]), *PATHS)) == []


def test_op11_blocks_of_links_and_groups_without_cuts():
    # one group of 300 tokens by 200, few ids: more links than are expanded at once
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 30, 200)
    ga, gb = np.r_[np.zeros(290, int), np.arange(1, 11)], np.r_[np.zeros(190, int), np.arange(1, 11)]
    want = Counter()
    for i, g in zip(a, ga):
        want.update((int(i) * 30 + int(j)) for j, h in zip(b, gb) if g == h)
    for once in (5, 100, 10**6):
        got = {}
        for keys, times in A.id_pairs(a, ga, b, gb, (40, 30), once):
            assert not set(keys.tolist()) & set(got)
            got.update(zip(keys.tolist(), times.tolist()))
        assert got == want


def test_op11_divide_finds_every_cut():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 5000):
        for share in (0.9, 0.01, 0.0):
            a_ends = np.cumsum(rng.integers(1, 4, n)) * 2
            both = rng.random(n) < share
            both[-1] = True
            b_ends = np.unique(np.r_[a_ends[both], a_ends[~both] + 1])
            b_ends = b_ends[b_ends <= a_ends[-1]]
            lo, hi = A.divide(a_ends, b_ends, np.array([0]), np.array([n]))
            assert hi.tolist() == (np.flatnonzero(np.isin(a_ends, b_ends)) + 1).tolist() and lo.tolist() == [0, *hi[:-1].tolist()]


def test_op11_groups_give_places(spark, make_docs):
    rows = [(1, "the house ééé"), (2, None), (3, "the house")]
    got = sorted(map(tuple, A.groups(make_docs(rows), *PATHS).collect()))
    a, b = A.vocabularies(*PATHS)
    for doc_id, text in ((1, rows[0][1]), (3, rows[2][1])):
        mine = [r for r in got if r[0] == doc_id]
        raw = (" " + text).encode()
        for _, g, start, end, x, y in mine:
            assert raw[start:end] == b"".join(a.bytes[i] for i in x) == b"".join(b.bytes[i] for i in y)
        assert [[r[4], r[5]] for r in mine] == brute_groups(text)
    assert not [r for r in got if r[0] == 2]


# whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType()), T.StructField("x", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "mine", "mine") for i, v in rows], VECTORS)


def exact_polynomial(m):
    """Faddeev-LeVerrier over fractions."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[-1] * (i == j)) for j in range(d)] for i in range(d)]
        mb = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(mb[i][i] for i in range(d)) / k)
    return [int(x) for x in reversed(c)]


def gram(rng, d, rank, size):
    x = [[int(v) for v in rng.integers(-size, size, d)] for _ in range(rank)]
    return np.array([[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)], dtype=object)


def test_op12_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(2)
    for d, rank, size in ((1, 1, 5), (2, 2, 10**9), (6, 6, 10**12), (7, 3, 1000), (5, 5, 2)):
        m = gram(rng, d, rank, size)
        if int(np.trace(m)):
            assert W.characteristic(spark, m) == exact_polynomial(m.tolist())
    assert W.characteristic(spark, np.array([[0, 0, 2], [0, 0, 0], [2, 0, 5]], dtype=object) ** 2 * 4)  # a pivot of zero


def test_op12_roots_and_vectors(spark):
    for diagonal in ([9, 4, 4, 0], [7, 7, 7], [10**30, 10**30 + 1, 3], [1]):
        m = np.diag([int(x) for x in diagonal]).astype(object)
        v, values, shares = W.components(spark, m, 16)
        want = [float(x) for x in sorted((x for x in diagonal if x), reverse=True)]
        assert np.allclose(values, want, rtol=1e-15) and np.allclose(shares, [x / sum(diagonal) for x in want])
        assert np.allclose(v.T @ v, np.eye(len(want)), atol=1e-15) and np.allclose(np.array(m, float) @ v, v * np.array(values), rtol=1e-12, atol=1e-15 * max(want))
    # nearly equal roots are still told apart
    v, _, _ = W.components(spark, np.diag([10**30, 10**30 + 1]).astype(object), 16)
    assert np.allclose(np.abs(v), [[0.0, 1.0], [1.0, 0.0]], rtol=0, atol=1e-40)


def judged(spark, rows, most=16):
    return [tuple(r) for r in W.whiten(vectors(spark, rows), most=most).collect()]


def test_op12_query_against_numpy(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.floor(64 * np.stack(e["embedding"]).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    w, v = np.linalg.eigh(centred.T @ centred / n)
    got = Q.op12_whitening(spark, SF).toPandas()
    assert len(got) == 16 * len(e) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    deviation = dict(zip(e["vec_id"], ((n * x - s) ** 2).sum(axis=1)))
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"]))
    for k in range(16):
        mine = got[got["component"] == k + 1].set_index("vec_id").loc[e["vec_id"]]
        want = (x - s / n) @ v[:, -1 - k] / math.sqrt(w[-1 - k])
        assert min(np.abs(mine["whitened"] - want).max(), np.abs(mine["whitened"] + want).max()) < 1e-8
        assert np.allclose(mine["explained"], w[-1 - k] / w.sum(), rtol=1e-9)


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.5, 0.25]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [1e30, 1.0])]
    got = judged(spark, rows)
    assert sorted((r[0] is None, r[0], r[1]) for r in got if r[0]) == sorted((False, i, c) for i in (1, 1, 2) for c in (1, 2)) and len(got) == 8
    assert {r[2] for r in got} == {3} and all(r[6] < 1e-9 for r in got)
    assert len({r[3] for r in got if r[0] == 1}) == 1
    # no variance, one vector, none
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert judged(spark, rows) == []
    # rank one of three dimensions: one component
    assert {r[1] for r in judged(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(6)])} == {1}
    # entries beyond what products of doubles or longs hold
    wide = judged(spark, [(1, [3e15, 1.0]), (2, [-3e15, 2.0]), (3, [0.0, 7.0])])
    assert all(r[3] is None and r[6] < 1e-4 for r in wide) and len(wide) == 6


def test_op12_exact_scatter():
    rng = np.random.default_rng(4)
    for top in (10, 2**30, 2**60):
        y = rng.integers(-top, top, (3000, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert W.exact_scatter(y).tolist() == want


# URLs

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("rule", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "mine", "mine") for i, u in rows], PAGES)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
    tail = rest[len(host) :]
    path = min((tail.split(c, 1)[0] for c in "?#"), key=len)
    query = tail.split("#", 1)[0].partition("?")[2]
    return "".join(c.lower() if c.isascii() else c for c in host), path, query


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_op13_list_rules_of_whole_table(spark):
    got = {r["page_id"]: r for r in Q.op13_url_filter(spark, SF).collect()}
    told = pd.read_parquet(f"{SF}/pages.parquet")
    assert len(got) == len(told)
    for i, url in told[["page_id", "url"]].itertuples(index=False):
        host, path, _ = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def brute_tokens(url):
    host, path, query = brute_parts(url)
    if not host:
        return set()
    import regex

    names = host.split(".")
    out = {"h:" + ".".join(names[k:]) for k in range(len(names))}
    out |= {"p:" + w for w in regex.split(r"[^\p{L}\p{N}]+", path.lower()) if w}
    return out | {"q:" + w for x in regex.split("[&;]", query.lower()) if (w := x.split("=", 1)[0])}


def test_op13_mining_and_matching_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    urls = []
    for _ in range(400):
        spam = rng.random() < 0.4
        host = rng.choice(["pills.bad.test", "win.bad.test", "shop.good.test"] if spam else ["www.good.test", "blog.good.test", "pills.bad.test"])
        urls.append((f"http://{host}/{rng.choice(['buy', 'en', 'fr'])}/{rng.integers(0, 9)}?{rng.choice(['ref', 'page'])}=1", "block" if spam else "allow"))
    labelled = spark.createDataFrame([*urls, (None, "block"), ("http://x.test/", None), ("no url", "allow")], "url string, verdict string")
    mined = U.mine(labelled, support=10, confidence=0.7)
    sets, both = Counter(), Counter()
    for url, verdict in urls:
        t = sorted(brute_tokens(url))
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                sets[c] += 1
                both[c, verdict] += 1
    rules = {(c, v): (n, n / sets[c]) for (c, v), n in both.items() if n >= 10 and n / sets[c] >= 0.7}
    kept = {(c, v): x for (c, v), x in rules.items() if not any((s := tuple(t for t in c if t != drop), v) in rules and rules[s, v][1] >= x[1] for drop in c)}
    got = {(tuple(r["antecedent"]), r["verdict"]): (r["n"], r["confidence"]) for r in mined.collect()}
    assert got == pytest.approx(kept) and {v for _, v in got} == {"allow", "block"}
    rows = [(k, u) for k, (u, _) in enumerate(urls)] + [(1000, None), (None, "http://pills.bad.test/buy/1?ref=1"), (7, "no scheme"), (7, "ftp://WWW.Good.Test"), (8, "https://a.example.org/es/x"), (9, "x://" + "long" * 2000 + "/" + "w/" * 3000)]
    for sent in (10**6, 0):
        judged = U.judge(pages(spark, rows), mined, U.RULES, sent=sent).collect()
        want = []
        for i, url in rows:
            host, path, _ = brute_parts(url)
            rule, verdict = brute_rule(host, path)
            fit = [] if verdict else [(c, n, v) for (t, v), (n, c) in kept.items() if set(t) <= brute_tokens(url)]
            want.append((i, host, path, rule, verdict or (max(fit)[2] if fit else "allow"), len(fit)))
        assert sorted(map(tuple, judged), key=str) == sorted(want, key=str)


def test_op13_without_rows_or_labels(spark):
    none = U.mine(spark.createDataFrame([], "url string, verdict string"))
    assert U.judge(pages(spark, []), none, U.RULES).collect() == []
    assert [tuple(r) for r in U.judge(pages(spark, [(1, "http://b.com/de/")]), none, U.RULES).collect()] == [(1, "b.com", "/de/", "com/de/", "block", 0)]
    # equally long rules: the longer host; a rule's host is no mere ending of a name
    at = pages(spark, [(1, "http://b.cc/x"), (2, "http://bb.cc/x")])
    assert [r["rule"] for r in U.judge(at, none, [("block", "cc", "/xx"), ("allow", "b.cc", "/"), ("block", "cc", "/x")]).orderBy("page_id").collect()] == ["b.cc/", "cc/x"]


def test_op13_sample_is_bounded(spark):
    rows = spark.range(5000).select(F.concat(F.lit("http://a.test/"), F.col("id").cast("string")).alias("url"), F.lit("block").alias("verdict"))
    got = U.mine(rows, sample=500).collect()
    assert got and max(r["n"] for r in got) < 800

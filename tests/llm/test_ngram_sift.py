"""Documents that can link with another group, against a plain loop."""

import random

import pytest

from logweave.llm import ngram_join as N


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sifting_by_whole_sets(spark, seed):
    r = random.Random(seed)
    docs = {}
    for k in range(60):
        group = k % 12
        docs[k] = (group, sorted({r.randrange(-(2**63), 2**63) if r.random() < 0.1 else (hash((group // 3, r.randrange(30), seed)) % 2**63) for _ in range(r.randrange(1, 40))}))
    sets = spark.createDataFrame([(k, t) for k, (_, t) in docs.items()], "doc_id long, tokens array<long>")
    keys = spark.createDataFrame([(t, k, len(ts), True, 1, g) for k, (g, ts) in docs.items() for t in ts[:5]], "token long, doc_id long, size int, key boolean, least int, `group` long")

    def spread(pairs):
        groups = {}
        for t, g in pairs:
            groups.setdefault(t, set()).add(g)
        return {t for t, g in groups.items() if len(g) > 1}

    first = spread((t, g) for g, ts in docs.values() for t in ts[:5])
    left = {k for k, (_, ts) in docs.items() if sum(t in first for t in ts[:5]) >= 1}
    whole = spread((t, docs[k][0]) for k in left for t in docs[k][1])
    want = {k for k in left if sum(t in whole for t in docs[k][1]) >= -(-len(docs[k][1]) * 80 // 100)}
    got = {x["doc_id"] for x in N.shared_enough(keys, sets, 80).collect()}
    assert got == want and want != left


def test_sifting_nothing(spark):
    sets = spark.createDataFrame([(1, [5, 6]), (2, [7])], "doc_id long, tokens array<long>")
    keys = spark.createDataFrame([(5, 1, 2, True, 1, 1), (7, 2, 1, True, 1, 2)], "token long, doc_id long, size int, key boolean, least int, `group` long")
    assert N.shared_enough(keys, sets, 80).count() == 0


def test_near_copies_are_not_joined_row_by_row(spark, monkeypatch):
    r, rows, join = random.Random(7), [], N.join_groups
    monkeypatch.setattr(N, "join_groups", lambda part, groups, key, size: rows.append(part.count() if key == "token" else 0) or join(part, groups, key, size))
    base = [r.randrange(2**62) for _ in range(100)]
    near = [(k, sorted(base[: 90 + k % 5] + [r.randrange(2**62)])) for k in range(200)]
    links = N.near_links(spark.createDataFrame(near, "doc_id long, tokens array<long>"), 80)
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.collect():
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(x) for x in range(200)} == {0}
    assert sum(rows) < 200

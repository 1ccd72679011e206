"""Slices against plain loops, written from the semantics."""

import random

from pyspark.sql import functions as F

from logweave.operators import slicing as S


def loop_pages(costs, budget):
    page, filled, out = 1, 0, []
    for c in costs:
        if filled and filled + c > budget:
            page, filled = page + 1, 0
        filled += c
        out.append(page)
    return out


def loop_slice(costs, center, budget, anchor):
    n, chosen, total = len(costs), [center], costs[center]
    if anchor == "head":
        order = list(range(center + 1, n))
    elif anchor == "tail":
        order = list(range(center - 1, -1, -1))
    else:
        order, lo, hi = [], center - 1, center + 1
        while lo >= 0 or hi < n:
            if lo >= 0:
                order.append(lo)
                lo -= 1
            if hi < n:
                order.append(hi)
                hi += 1
    for i in order:
        if total + costs[i] > budget:
            break
        total += costs[i]
        chosen.append(i)
    return sorted(chosen)


def loop_trim(chosen, roles):
    end = len(chosen) - 1
    while end >= 0 and roles[chosen[end]] != "assistant":
        end -= 1
    return chosen[: end + 1] if end >= 0 and end + 1 >= len(chosen) / 2 else chosen


def test_pages_equal_the_loop(spark):
    rng = random.Random(1)
    for budget in (4, 37, 120):
        costs = {f"s{k}": [rng.randint(4, 60) for _ in range(rng.randint(1, 40))] for k in range(100)}
        rows = spark.createDataFrame([("claude", s, k, c) for s, cs in costs.items() for k, c in enumerate(cs)], "source string, session_id string, idx int, cost int")
        got = {}
        for r in S.assign_pages(rows, budget).orderBy("session_id", "idx").collect():
            got.setdefault(r["session_id"], []).append(r["page"])
        assert got == {s: loop_pages(cs, budget) for s, cs in costs.items()}


def test_slices_equal_the_loop(spark):
    rng = random.Random(2)
    rows, sessions = [], {}
    for s in range(150):
        n = rng.randint(1, 14)
        data = [(rng.choice(["user", "assistant", "system"]), rng.randint(4, 50), rng.random() < 0.15) for _ in range(n)]
        sessions[str(s)] = data
        rows += [("claude", str(s), i + 1, r, c, c, h) for i, (r, c, h) in enumerate(data)]
    df = spark.createDataFrame(rows, "source string, session_id string, idx int, role string, cost long, full_cost long, hit boolean")
    for anchor in ("head", "tail", "search"):
        got = {}
        for r in S.trim_to_assistant(S.within_budget(S.ranked(df, anchor), 90)).select("session_id", "idx").collect():
            got.setdefault(r[0], []).append(r[1] - 1)
        for s, data in sessions.items():
            costs, roles = [c for _, c, _ in data], [r for r, _, _ in data]
            hits = [i for i, d in enumerate(data) if d[2]]
            center = {"head": 0, "tail": len(data) - 1}.get(anchor, hits[0] if hits else len(data) - 1)
            assert sorted(got[s]) == loop_trim(loop_slice(costs, center, 90, anchor), roles), (anchor, s)


def test_empty_sessions_have_zero_meta(spark):
    sessions = spark.createDataFrame([("claude", "a"), ("claude", "b")], "source string, session_id string")
    messages = sessions.where("session_id = 'a'")
    row = S.empty_meta(sessions, messages, 100, "head").collect()
    assert [(r["session_id"], r["total_messages"], r["cursor_after"]) for r in row] == [("b", 0, None)]
    assert S.read_page  # pages of such sessions are absent


def test_page_count(spark):
    got = spark.createDataFrame([(0, 0), (10, 1), (4001, 9)], "t long, n long").select(S.page_count("t", "n", 4000).alias("p")).collect()
    assert [r["p"] for r in got] == [0, 1, 2]


def test_detail_meta_and_hint(spark):
    from logweave.operators import explode as X

    one = X.block("thinking", text=F.lit("x" * 10))
    df = spark.range(1).select(F.lit("claude").alias("source"), F.lit("s").alias("session_id"), F.lit("c").alias("content"), F.array(one).cast("array<" + X.BLOCK + ">").alias("blocks"))
    assert S.project_detail(df, "meta").first()["blocks"] == []
    hint = S.detail_hint(df, "standard").first()
    assert hint["thinking_hidden"] and hint["full_tokens"] == 100
    assert S.detail_hint(df, "full").count() == 0

"""Pages of sessions of any size (W7) against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import slicing as S
from logweave.plans import registry
from tests.oracle import same


def brute(rows, budget):
    out, page, run = {}, {}, {}
    for source, session, idx, cost in sorted(rows):
        key = source, session
        if key not in page or run[key] + cost > budget:
            page[key], run[key] = page.get(key, 0) + 1, 0
        run[key] += cost
        out[source, session, idx] = page[key]
    return out


@pytest.mark.parametrize("one_row", [0, 25, 10_000])
@pytest.mark.parametrize("budget", [1, 50, 10_000])
def test_pages_equal_a_plain_loop(spark, one_row, budget):
    r = random.Random(budget)
    rows = [("claude", f"s{s}", 3 * k + 1, r.choice([4, 7, 30, 90])) for s, n in enumerate((1, 2, 25, 26, 150)) for k in range(n)]
    rows += [("codex", "s4", k, 4) for k in range(40)]
    df = spark.createDataFrame(rows, "source string, session_id string, idx int, cost int").withColumns({"role": F.lit("user"), "full_cost": F.col("cost"), "hit": F.lit(False)})
    got = S.assign_pages(df, budget, one_row)
    assert got.columns == [*df.columns, "page"]
    assert {(x["source"], x["session_id"], x["idx"]): x["page"] for x in got.collect()} == brute(rows, budget)
    assert got.count() == len(rows)


def test_pages_of_no_rows(spark):
    df = spark.createDataFrame([], "source string, session_id string, idx int, cost int")
    assert S.assign_pages(df, 10).collect() == []


@pytest.mark.parametrize("name", ["w7_pages", "w8_page_read", "e3_read_page"])
def test_page_queries_run_without_python_workers(spark, name):
    sf = "/root/testdata/sf0.001"
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    same(spark, registry.queries()[name], registry.oracle_sql()[name], sf)

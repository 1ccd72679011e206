"""Files read in blocks, heads of files, and places in order within large groups."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators.ranks import running
from logweave.plans import registry
from logweave.sources import claude, heads, readers
from logweave.sources.lines import read_lines
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s1_s3_split_lines", "s4_s5_i12_claude_heads", "s2_s3_s4_gemini_files"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.fixture
def small_blocks(spark):
    """Blocks of some hundred bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def odd_files(folder):
    r = random.Random(1)
    long = ["x" * r.randrange(0, 90) + "é" * r.randrange(3) for _ in range(300)]
    files = {
        "a/large.jsonl": "\n".join(long) + "\n",
        "a/crlf.jsonl": "\r\n".join(long[:50]) + "\r\n",
        "b/open.jsonl": "\n".join(long[:40]) + "\nlast",
        "b/open-cr.jsonl": "one\r\n\r\ntwo\r",
        "b/lone-cr.jsonl": "one\rtwo\n\n\nthree\n",
        "b/blank.jsonl": "\n",
        "b/empty.jsonl": "",
        "b/one-long.jsonl": "y" * 5_000 + "\nz\n",
        "notes.txt": "no transcript\n",
    }
    for name, text in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    return str(folder)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_lines_read_in_blocks_equal_whole_files(spark, tmp_path, small_blocks, sent):
    at = odd_files(tmp_path)
    got = read_lines(spark, at, "claude", sent=sent)
    assert not sent or got.lines.rdd.getNumPartitions() > 20
    files = readers.read_files(spark, at, "claude")
    want = readers.lines_of(files)
    rows = lambda df: sorted(map(tuple, df.select("file_path", "line_no", "value").collect()))
    assert rows(got.lines) == rows(want)
    facts = lambda df: sorted(map(tuple, df.select("file_path", "raw_line_count", "file_bytes", "mtime").collect()))
    assert facts(got.facts) == facts(readers.facts_of(want, files))


def test_files_that_change_between_the_passes_are_refused(spark, tmp_path, small_blocks):
    at = odd_files(tmp_path)
    got = read_lines(spark, at, "claude")
    with open(f"{at}/a/0-new.jsonl", "w") as f:
        f.write("new\n" * 500)
    # the table of blocks is written; a new reading of the folder does not fit it
    lines = read_lines(spark, at, "claude")
    os.remove(f"{at}/a/0-new.jsonl")
    with pytest.raises(Exception):  # noqa: B017
        lines.lines.collect()
    assert got.lines.count() > 0


def test_heads_equal_heads_of_whole_files(spark, tmp_path):
    at = odd_files(tmp_path)
    got = heads.read_heads(spark, {"claude": at}, {"claude": 7}).where("source = 'claude'")
    want = readers.lines_of(readers.read_files(spark, at, "claude")).where("line_no < 7")
    rows = lambda df: sorted(map(tuple, df.select("file_path", "line_no", "value").collect()))
    assert rows(got) == rows(want)
    assert {r["file_bytes"] for r in heads.facts_of(got).where("file_path like '%one-long%'").collect()} == {5003}


@pytest.mark.parametrize("options", [{}, {"folders": 1}, {"folders": 100, "files": 2}])
def test_heads_deal_out_every_file_once(spark, tmp_path, options):
    for k in range(30):
        at = tmp_path / f"d{k % 4}" / f"e{k % 2}" / f"s{k}.jsonl"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("one\ntwo\n")
    (tmp_path / "top.jsonl").write_text("one\n")
    got = heads.read_heads(spark, {"claude": str(tmp_path)}, **options)
    assert sorted(r["file_name"] for r in got.where("line_no = 0").collect()) == sorted([*(f"s{k}.jsonl" for k in range(30)), "top.jsonl"])
    assert heads.read_heads(spark, {"claude": str(tmp_path / "none")}).count() == 0


def test_heads_read_a_small_part_and_push_filters(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"s{k}.jsonl").write_text("".join(f'{{"type":"user","n":{n}}}\n' for n in range(60_000)))
    got = heads.read_heads(spark, {"claude": str(tmp_path), "codex": str(tmp_path / "missing")})
    sums = got.where("line_no = 0").agg(F.sum("bytes_read"), F.sum("file_bytes")).first()
    assert sums[0] * 20 < sums[1]
    some = got.where("source = 'claude' and file_name in ('s1.jsonl', 's2.jsonl') and file_path like '%s1%'")
    assert {r["file_name"] for r in some.collect()} == {"s1.jsonl"}
    reader = heads.HeadReader({"roots": f'{{"claude": "{tmp_path}", "codex": "{tmp_path}"}}'})
    left = list(reader.pushFilters([heads.EqualTo(("source",), "codex"), heads.StringEndsWith(("file_name",), "3.jsonl"), heads.EqualTo(("line_no",), 0)]))
    assert [f.attribute for f in left] == [("line_no",)]
    assert {p.source for p in reader.partitions()} == {"codex"}
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert {n for b in read for n in b.column("file_name").to_pylist()} == {"s3.jsonl"}


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_running_sums_equal_plain_sums(spark, cell):
    r = random.Random(2)
    rows = [(g, k, t, r.randrange(4)) for g in "ab" for k in r.sample(range(500), 60) for t in range(r.randrange(1, 3))]
    df = spark.createDataFrame(rows, "g string, k long, t int, n int")
    got = {(x["g"], x["k"], x["t"]): (x["place"], x["before"]) for x in running(df, ["g"], "k", {"place": F.lit(1), "before": F.col("n")}, ["t"], cell).collect()}
    for g in "ab":
        place = before = 0
        for _, k, t, n in sorted(x for x in rows if x[0] == g):
            assert got[g, k, t] == (place, before)
            place, before = place + 1, before + n


def test_a_large_file_is_spread_over_tasks(spark):
    """One file with 80 % of the rows: no task sorts more than a cell of it, and no window carries parsed lines."""
    line = F.format_string('{"type":"user","uuid":"u%s","sessionId":"s","message":{"content":"hello %s"}}', F.col("id"), F.col("id"))
    lines = spark.range(1000).select(F.when(F.col("id") < 800, "/x/big.jsonl").otherwise(F.concat(F.lit("/x/"), (F.col("id") % 50).cast("string"), F.lit(".jsonl"))).alias("file_path"), F.col("id").alias("line_no"), line.alias("value"))
    got = running(lines.select("file_path", "line_no"), ["file_path"], "line_no", {"place": F.lit(1)}, cell=100).where("file_path = '/x/big.jsonl'")
    assert [r["place"] for r in got.orderBy("line_no").collect()] == list(range(800))
    messages = claude.ingest_claude(lines).messages
    plan = messages._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and not [x for x in windows if "messages" in x or " v#" in x]
    assert messages.count() == 1000

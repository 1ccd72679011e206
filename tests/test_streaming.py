"""Running sessions: stop, restart and replay give the batch's numbers, and each new message once."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from logweave.plans import registry
from logweave.plans import views as V
from logweave.streaming import running as R
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["st1_stream_totals", "st1_new_messages"])
def test_queries_equal_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stop_restart_replay_and_compaction(spark, tmp_path):
    m = V.conversation_messages(spark, SF).where("cast(session_id as int) < 12").withColumn("ts", F.expr("ts + interval 123456 microseconds")).cache()
    at = lambda name: str(tmp_path / name)
    names = list(m.columns)

    def go_on(totals=True):
        R.start_new(R.stream_messages(spark, at("in"), m.schema, 2), at("new"), at("c1")).awaitTermination()
        if totals:
            R.start_totals(R.stream_messages(spark, at("new"), m.schema, 3), at("totals"), at("c2")).awaitTermination()

    m.where("idx <= 4 and idx != 2").write.parquet(at("in"))
    go_on()
    kept = m.where("idx <= 4 and idx != 2")
    assert rows(spark.read.schema(m.schema).parquet(at("new")).select(*names)) == rows(kept)
    assert rows(R.latest_totals(spark, at("totals"))) == rows(R.running_totals(kept))
    # rows come again, late and in any order
    m.where("idx in (2, 4, 5)").write.mode("append").parquet(at("in"))
    m.where("idx > 3").orderBy(F.rand(1)).write.mode("append").parquet(at("in"))
    go_on()
    assert rows(spark.read.schema(m.schema).parquet(at("new")).select(*names)) == rows(m)
    assert rows(R.latest_totals(spark, at("totals"))) == rows(R.running_totals(m))
    # a batch that is replayed after a failure: its commit is lost, its folder half written
    def forget(checkpoint):
        kept = tmp_path / checkpoint / "commits"
        last = max(int(p.name) for p in kept.iterdir() if p.name.isdigit())
        for name in (str(last), f".{last}.crc"):
            (kept / name).unlink()
        return last

    last = forget("c2")
    shutil.rmtree(tmp_path / "totals" / f"batch={last}")
    forget("c1")
    go_on()
    assert rows(spark.read.schema(m.schema).parquet(at("new")).select(*names)) == rows(m)
    assert rows(R.latest_totals(spark, at("totals"))) == rows(R.running_totals(m))
    # folding the folders, twice, and one that stopped after its copy was written
    want = rows(R.running_totals(m))
    R.compact_totals(spark, at("totals"))
    assert len([p for p in (tmp_path / "totals").iterdir() if p.name.startswith("batch=")]) == 1
    R.compact_totals(spark, at("totals"))
    assert rows(R.latest_totals(spark, at("totals"))) == want
    number = next(p.name.split("=")[1] for p in (tmp_path / "totals").iterdir() if p.name.startswith("batch="))
    R.latest_totals(spark, at("totals")).write.parquet(f"{at('totals')}/_folded={number}")
    shutil.rmtree(tmp_path / "totals" / f"batch={number}")
    R.compact_totals(spark, at("totals"))
    assert rows(R.latest_totals(spark, at("totals"))) == want
    # and the stream goes on after it
    more = m.where("idx = 1").withColumn("session_id", F.concat(F.lit("new"), "session_id"))
    more.write.mode("append").parquet(at("in"))
    go_on()
    assert rows(R.latest_totals(spark, at("totals"))) == rows(R.running_totals(m.unionByName(more)))


def test_known_numbers():
    r = random.Random(1)
    for _ in range(200):
        numbers = [k for k in range(1, 20) for _ in range(r.randrange(1, 3))]
        r.shuffle(numbers)
        known, beyond, got = 0, set(), []
        while numbers:
            part, numbers = numbers[:4], numbers[4:]
            got += [n for n, new in zip(part, R.unseen(part, known, beyond)) if new]
            known = R.without_gap(known, beyond)
        assert sorted(got) == list(range(1, 20)) and known == 19 and not beyond


def test_batches_follow_the_data(spark, tmp_path):
    """Files and calls of a batch don't grow with shuffle partitions and sessions."""
    m = V.conversation_messages(spark, SF)
    at = lambda name: str(tmp_path / name)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        m.repartition(2).write.parquet(at("in"))
        R.start_new(R.stream_messages(spark, at("in"), m.schema, 2), at("new"), at("c1")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(list((tmp_path / "new").glob("*.parquet"))) <= R.FILES
    assert rows(spark.read.schema(m.schema).parquet(at("new"))) == rows(m)

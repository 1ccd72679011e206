"""Running sessions (ST1): each new message once, and totals kept up to date.

``stream_new`` turns a stream of messages, in which rows may come again and in any order, into each message once: Spark keeps
for each session how many messages of it are known without a gap, and which beyond (J7 with stored counts). Sessions share their state
in ``SLOTS`` slots, so a batch calls Python once a slot and not once a session. Its sink is Spark's file
sink, whose log makes a replayed batch count once; a batch writes ``FILES`` files at most, so the batches of what reads
them are as few as its own, whatever the number of shuffle partitions. ``stream_totals`` reads that sink as a stream and keeps each session's totals in the state
store (update mode); a batch writes the totals of the sessions it touched to a folder of its own number, so a batch that is
replayed replaces its folder. ``compact_totals`` folds those folders into one.

All queries end when what is present has been read; started again with the same checkpoint they go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as P
from ..functions.schemas import KEY, ROLES
from ..scratch import delete

SUMS = ("total_messages", *[f"n_{r}" for r in ROLES], "tokens")
#: Slots that hold the state of sessions, by hash: fixed for the life of a checkpoint. A batch writes the slots it touches.
SLOTS = 1024
#: Files of new messages that a batch writes.
FILES = 8
#: How times stand in a packed message: to the microsecond.
PACKED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def running_totals(messages: DataFrame) -> DataFrame:
    """Per session: messages, messages by role, tokens, last time. The same on a stream and on a table."""
    rows = messages.select(*KEY, "role", "ts", P.message_tokens("blocks").alias("tokens"))
    return rows.groupBy(*KEY).agg(F.count("*").alias("total_messages"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES], F.sum("tokens").alias("tokens"), F.max("ts").alias("last_ts"))


def stream_messages(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def unseen(numbers: list[int], known: int, beyond: set[int]) -> list[bool]:
    """Which of the numbers are new; ``beyond`` gets them."""
    out = []
    for n in numbers:
        out.append(n > known and n not in beyond)
        if out[-1]:
            beyond.add(n)
    return out


def without_gap(known: int, beyond: set[int]) -> int:
    """How many numbers from 1 are known without a gap; those leave ``beyond``."""
    while known + 1 in beyond:
        known += 1
        beyond.remove(known)
    return known


def stream_new(messages: DataFrame) -> DataFrame:
    """Each message of the stream once, by session and ``idx`` (from 1).

    A slot's rows are seen in Arrow batches; a session's state is a count and the numbers that came before their turn.
    """

    def fresh(slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, beyond = state.get if state.exists else ({}, {})
        known, beyond = dict(known), {s: set(b) for s, b in beyond.items()}
        for frame in frames:
            keep = pd.Series(False, frame.index)
            for session, numbers in frame.groupby("session")["idx"]:
                before = known.setdefault(session, 0)
                keep[numbers.index] = unseen(numbers.tolist(), before, beyond.setdefault(session, set()))
                known[session] = without_gap(before, beyond[session])
            if keep.any():
                yield frame.loc[keep, ["message"]]
        state.update((known, {s: sorted(b) for s, b in beyond.items() if b}))

    session = F.to_json(F.array(*KEY)).alias("session")
    packed = messages.where("idx > 0").select(F.pmod(F.xxhash64(*KEY), F.lit(SLOTS)).alias("slot"), session, "idx", F.to_json(F.struct(*messages.columns), PACKED).alias("message"))
    got = packed.groupBy("slot").applyInPandasWithState(fresh, "message string", "known map<string,int>, beyond map<string,array<int>>", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.from_json("message", messages.schema, PACKED).alias("m")).select("m.*").repartition(FILES)


def start_new(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New messages of the stream into Parquet files below ``out``."""
    return stream_new(messages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_totals(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Totals of the sessions that a batch touches into ``out``/batch=number; ``messages`` holds each message once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return running_totals(messages).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """Each session's newest totals."""
    kept = spark.read.parquet(out)
    names = [c for c in kept.columns if c not in (*KEY, "batch")]
    return kept.groupBy(*KEY).agg(F.max_by(F.struct(*names), "batch").alias("t")).select(*KEY, "t.*")


def compact_totals(spark: SparkSession, out: str) -> None:
    """Fold all folders of totals into the newest one. Run it while no batch is written.

    All are written under another name first; should it stop between, running it again finishes the work, as that copy then goes in
    place of the newest folder.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(int(f.getPath().getName().split("=")[1]) for f in store.listStatus(path(out)) if f.getPath().getName().startswith("batch="))
    # readers pass over names that begin with an underscore; the number says up to which batch the copy goes
    done = [f.getPath().getName() for f in store.listStatus(path(out)) if f.getPath().getName().startswith("_folded=") and store.exists(path(f.getPath(), "_SUCCESS"))]
    if done:
        upto = int(done[0].split("=")[1])
    elif len(numbers) < 2:
        return
    else:
        upto = numbers[-1]
        latest_totals(spark, out).write.mode("overwrite").parquet(f"{out}/_folded={upto}")
    for n in numbers:
        if n <= upto:
            delete(spark, f"{out}/batch={n}")
    store.rename(path(f"{out}/_folded={upto}"), path(f"{out}/batch={upto}"))

"""The given tables bound as transcripts: messages, tool messages, index, raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schemas import BLOCKS
from ..operators import explode as X
from ..operators.catalog import SOURCES

BASE_TIME = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def source_of(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.pmod(n, F.lit(10)) + 1).cast("int"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text messages: session = conversation, idx = turn + 1, a minute apart, an hour between sessions."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(BASE_TIME)) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(source_of(F.col("conv_id")).alias("source"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"), (F.col("turn") + 1).cast("int").alias("idx"), "role", ts.alias("ts"), F.col("text").alias("content"), F.array(X.block("text", text=F.col("text"))).cast(BLOCKS).alias("blocks"), F.col("turn").cast("int").alias("raw_line_index"))


def tool_messages(spark: SparkSession, sf_dir: str, source: str = "claude", ids: int = 40, late: int = 0, line: int = 1) -> DataFrame:
    """A tool call and its result an event: session = user, name = event type, ids repeat (event_id % ids), error events fail.

    A result comes after the ``late`` calls that follow its own. With ``line`` above 1 so many events share a raw line, and
    their ids are their places in it.

    Clicks are Edit calls, whose file is ``/f/`` and the number of their props.
    """
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    name = F.when(F.col("event_type") == "click", "Edit").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k")
    args = F.to_json(F.struct(F.concat(F.lit("/f/"), k).alias("file_path"), F.col("props").alias("q")))
    id_ = F.concat(F.lit("c"), F.pmod(F.col("event_id") if line == 1 else F.col("n") - 1, F.lit(ids if line == 1 else line)).cast("string"))
    failed = F.col("event_type") == "error"
    use = F.struct(F.lit("tool_use").alias("role"), F.concat(F.lit("Tool: "), name).alias("content"), F.array(X.block("tool_use", id=id_, name=name, input_json=args)).cast(BLOCKS).alias("blocks"))
    output = F.concat(F.lit("done "), F.repeat(F.col("props"), (F.pmod(F.col("event_id"), F.lit(20)) + 1).cast("int")))
    result = F.struct(F.lit("tool_result").alias("role"), output.alias("content"), F.array(X.block("tool_result", tool_use_id=id_, content=output, is_error=failed)).cast(BLOCKS).alias("blocks"))
    rows = e.withColumn("n", n).select(F.lit(source).alias("source"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("file_path"), "n", "ts", F.posexplode(F.array(use, result)).alias("s", "m"))
    idx = (2 * F.col("n") - 1 + F.col("s")) if not late else F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("n") + F.col("s") * late, "s"))
    return rows.select("source", "session_id", "file_path", idx.cast("int").alias("idx"), "m.role", "ts", "m.content", "m.blocks", F.ceil(F.col("n") / line).cast("int").alias("raw_line_index"))


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries: conversations, and users of the event table (an id occurs in both, so dedup matters)."""
    m = conversation_messages(spark, sf_dir)
    conv = m.groupBy("source", "session_id", "file_path").agg(F.max("ts").alias("updated_at"), F.min_by("content", F.when(F.col("role") == "user", F.col("idx"))).alias("p"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    cwd = lambda n: F.concat(F.lit("/p/"), F.pmod(n, F.lit(7)).cast("string"))
    a = conv.select(F.col("session_id").alias("id"), "source", cwd(F.col("session_id").cast("bigint")).alias("cwd"), "updated_at", F.substring("p", 1, 60).alias("summary"), "file_path")
    b = e.select(F.col("user_id").cast("string").alias("id"), source_of(F.col("user_id") + 1).alias("source"), cwd(F.col("user_id")).alias("cwd"), "updated_at", F.lit(None).cast("string").alias("summary"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("file_path"))
    return a.unionByName(b)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative token counters of each user: running sums, every third row without a total, every seventh with a last usage."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = lambda k: F.sum(F.pmod(F.col("event_id"), F.lit(k))).over(w)
    rows = e.select("user_id", F.row_number().over(w).alias("line_no"), run(100).alias("i"), run(30).alias("c"), run(50).alias("o"))
    total = F.when(F.col("line_no") % 3 != 0, F.struct(F.col("i").alias("input"), F.col("c").alias("cached"), F.col("o").alias("output")))
    last = F.when(F.col("line_no") % 7 == 0, F.struct((F.col("line_no") % 90).cast("bigint").alias("input"), (F.col("line_no") % 11).cast("bigint").alias("cached"), (F.col("line_no") % 5).cast("bigint").alias("output")))
    return rows.select(F.lit("codex").alias("source"), F.col("user_id").cast("string").alias("session_id"), "line_no", last.alias("last"), total.alias("total"))

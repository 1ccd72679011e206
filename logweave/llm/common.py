"""What the operators share: the shared scratch folder, written tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes what the contracts call white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset in a session of one
    process (as in tests) does a temporary folder stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return base.rstrip("/")


#: Scratch paths of this process that are not discarded yet.
_LIVE: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LIVE.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at a table that survives the loss of executors, and makes a result that
    several jobs need once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _LIVE.discard(path)


def discard(*frames: DataFrame) -> None:
    """Delete written tables that everything which needs them has been written from."""
    for df in frames:
        _delete(df.sparkSession, df.scratch_path)


def live() -> set[str]:
    """The scratch paths of this process that are not discarded yet."""
    return set(_LIVE)


def release(paths: set[str], docs: DataFrame) -> None:
    """Delete the scratch ``paths``, but for a table that ``docs`` itself is read from."""
    files = docs.inputFiles()
    for path in paths & _LIVE:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in files):
            _delete(docs.sparkSession, path)


def give_back() -> None:
    """Return the memory that a task has freed to the machine: Python workers go on to other tasks and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str | Column) -> Column:
    """crc32 of the id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(0))


def tasks(spark: SparkSession) -> int:
    """How many parts a shuffle deals its rows to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Groups of at least a HOT_SHAREth of all rows are joined by broadcast: at most HOT_SHARE rows, whatever the data.
HOT_SHARE = 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row a key, ``size`` its number of rows), both written tables.

    The large groups, few by their share of all rows (``total``, counted if not given), are broadcast, so no task gets a
    large group's rows; the rest joins by key.
    """
    floor = max(2, (rows.count() if total is None else total) // HOT_SHARE + 1)
    hot, cold = groups.where(F.col(size) >= floor), groups.where(F.col(size) < floor)
    tagged = rows.join(F.broadcast(hot), key, "left")
    known = tagged.where(F.col(size).isNotNull())
    rest = tagged.where(F.col(size).isNull()).select(*rows.columns).join(cold.hint("merge"), key)
    return known.unionByName(rest.select(*known.columns))

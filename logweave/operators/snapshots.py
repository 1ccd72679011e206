"""Counts and etags of sessions, kept up to date.

The table is dealt to buckets by session. A version's manifest, one row a bucket, says which version wrote each bucket's rows; a new version
rewrites only the buckets of sessions that changed and points to the old rows of the others. Every version stays readable, and two versions are compared
only in buckets that they do not share. A version is there once its manifest is; what an interrupted one has written is not read,
and the next attempt replaces it.

One writer at a time. Null keys are not taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import etag
from ..functions.schemas import KEY

ROWS = "source string, session_id string, updated_at timestamp, total_messages bigint, etag string, bucket int"
BUCKETS = 256


@dataclass
class Snapshots:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in store.listStatus(at)] if store.exists(at) else []
        whole = lambda p: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and whole(p))

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> version that wrote its rows."""
        if not version:
            return {}
        return {r["bucket"]: r["written"] for r in self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()}

    def _rows(self, written: dict[int, int]) -> DataFrame:
        if not written:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(written.items())]).select(*[c.split()[0] for c in ROWS.split(", ")])

    def at(self, version: int | None = None) -> DataFrame:
        """(source, session_id, updated_at, total_messages, etag) of a version, the newest by default; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        return self._rows(self.manifest(version)).drop("bucket")

    def before(self, version: int | None = None) -> DataFrame:
        """Counts for ``compare.new_messages``."""
        return self.at(version).select(*KEY, F.col("total_messages").alias("n_before"))

    def advance(self, appended: DataFrame) -> int:
        """A new version after these messages have been added; its number."""
        last = max(self.versions(), default=0)
        written, version = self.manifest(last), last + 1
        more = appended.where("source is not null and session_id is not null").groupBy(*KEY).agg(F.max("ts").alias("updated_at"), F.count("*").alias("total_messages"))
        more = more.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in more.select("bucket").distinct().collect())  # at most one row a bucket
        old = self._rows({b: v for b, v in written.items() if b in set(touched)})
        both = old.select(*more.columns).unionByName(more).groupBy(*KEY, "bucket").agg(F.max("updated_at").alias("updated_at"), F.sum("total_messages").alias("total_messages"))
        rows = both.select(*KEY, "updated_at", "total_messages", etag("updated_at", "total_messages").alias("etag"), "bucket")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        told = sorted({**written, **dict.fromkeys(touched, version)}.items())
        self.spark.createDataFrame(told, "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def changed(self, since: int, version: int | None = None) -> DataFrame:
        """(source, session_id, etag) of the later version that the earlier one does not have."""
        if version is None:
            version = max(self.versions(), default=0)
        new, old = self.manifest(version), self.manifest(since)
        moved = {b: v for b, v in new.items() if old.get(b) != v}
        was = self._rows({b: old[b] for b in moved if b in old})
        return self._rows(moved).select(*KEY, "etag").join(was.select(*KEY, "etag"), [*KEY, "etag"], "left_anti")

"""Versioned snapshots of the listing state.

A snapshot is a manifest: for each of a fixed number of key buckets, the folder
that holds its rows.  A run that changes few keys writes their buckets anew and
a manifest that refers to the older folders for the others, so what is written
follows the run and not the state.  Folders are never overwritten, and a
manifest counts only once Spark has added ``_SUCCESS``: a failed write changes
nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.schema import STATE, conform
from pricelode.session import scratch_path, tidy_shuffles


def migrate(state: DataFrame) -> DataFrame:
    """Alerted rows without an alert price take the last known price."""
    price = F.coalesce("notified_price", F.when(F.col("notified"), F.col("last_price")))
    return state.withColumn("notified_price", price)


@dataclass
class StateStore:
    spark: SparkSession
    root: str
    buckets: int = 64

    @classmethod
    def temporary(cls, spark: SparkSession) -> StateStore:
        return cls(spark, scratch_path(spark, "state"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("state_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifest_path(self, version: int) -> str:
        return f"{self.root.rstrip('/')}/manifests/v{version:012d}"

    def _folders(self, path: str) -> list[str]:
        """Names below ``path``; lists directory names, never data."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def versions(self) -> list[int]:
        """Complete snapshots."""
        names = self._folders(f"{self.root.rstrip('/')}/manifests")
        complete = [n for n in names if n[1:].isdigit() and "_SUCCESS" in self._folders(self._manifest_path(int(n[1:])))]
        return sorted(int(n[1:]) for n in complete)

    def manifest(self, at_most: int | None = None) -> dict[int, str]:
        """Folder of every bucket that has rows, in the newest snapshot up to ``at_most``."""
        versions = [v for v in self.versions() if at_most is None or v <= at_most]
        if not versions:
            return {}
        return {r["bucket"]: r["folder"] for r in self.spark.read.parquet(self._manifest_path(versions[-1])).collect()}

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r["bucket"] for r in keys.select(self._bucket()).distinct().collect()]  # ``buckets`` at most

    def load(self, at_most: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Newest complete snapshot, or the newest with a version up to ``at_most``; with ``keys``, the buckets of these keys only."""
        folders = self.manifest(at_most)
        wanted = folders if keys is None else [b for b in self._touched(keys) if b in folders]
        paths = [f"{folders[b]}/bucket={b}" for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        return migrate(self.spark.read.schema(STATE).parquet(*paths))

    def write(self, state: DataFrame, version: int | None = None) -> int:
        """Write all of the next snapshot (or the given version) and return its version."""
        return self._commit(state, {}, version)

    def update(self, changed: DataFrame, version: int | None = None, base: int | None = None) -> int:
        """Write a snapshot in which ``changed`` replaces the rows of its keys in snapshot ``base`` (the newest up to it)."""
        changed = conform(changed, STATE).select(*STATE.fieldNames())
        kept = self.load(base, changed).join(changed.select("state_key"), "state_key", "left_anti")
        return self._commit(kept.unionByName(changed), self.manifest(base), version)

    def _commit(self, rows: DataFrame, before: dict[int, str], version: int | None) -> int:
        if version is None:
            versions = self.versions()
            version = (versions[-1] if versions else 0) + 1
        folder = f"{self.root.rstrip('/')}/data/v{version:012d}-{uuid.uuid4().hex}"
        rows = conform(rows, STATE).select(*STATE.fieldNames(), self._bucket())
        with tidy_shuffles(rows.sparkSession):
            rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        written = {int(n.split("=")[1]): folder for n in self._folders(folder) if n.startswith("bucket=")}
        listed = self.spark.createDataFrame(sorted((before | written).items()), "bucket int, folder string")
        # "overwrite" clears what an attempt left that died before its commit, or the manifest of a batch that is run again.
        listed.coalesce(1).write.mode("overwrite").parquet(self._manifest_path(version))
        return version

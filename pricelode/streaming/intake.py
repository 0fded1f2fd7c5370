"""Streaming intake: landed listing files update state and raise alerts.

Every micro-batch runs the batch operators over the buckets of the state that
hold its keys, and writes these buckets only.  The state after batch *n* is
snapshot *origin + n + 1*, computed from snapshot *origin + n* or older, and the
alerts of batch *n* have their own folder; a batch that is run again after a
failure therefore replaces its results instead of adding to them.  The origin is
the newest snapshot when the checkpoint was new; it is kept beside the
checkpoint, so a fresh checkpoint goes on from an existing state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricelode.config import StateParams
from pricelode.operators import state as ops
from pricelode.session import materialize, release, tidy_shuffles
from pricelode.sources.state_store import StateStore


@dataclass
class ListingIntake:
    spark: SparkSession
    state_root: str
    alert_root: str
    as_of: Column = field(default_factory=F.current_date)
    candidates: Callable[[DataFrame], DataFrame] = lambda df: df
    params: StateParams = field(default_factory=StateParams)
    origin: int = 0

    def process(self, batch: DataFrame, batch_id: int) -> None:
        store = StateStore(self.spark, self.state_root)
        number = self.origin + batch_id
        batch = ops.with_keys(batch)
        keys = batch.select("state_key").unionByName(batch.select(F.col("legacy_key").alias("state_key")))
        before = store.load(at_most=number, keys=keys)
        rows, changed = ops.changed_state(batch, before, self.as_of, self.params)
        rows, changed = materialize(rows, "intake-rows"), materialize(changed, "intake-state")
        decided = ops.alert_decisions(self.candidates(rows), changed, self.params)
        sent = materialize(decided.filter("alert"), "intake-alerts")
        with tidy_shuffles(sent.sparkSession):
            sent.write.mode("overwrite").parquet(f"{self.alert_root.rstrip('/')}/batch={number}")
        store.update(ops.mark_alerted(changed, sent), version=number + 1, base=number)
        release(rows, changed, sent)

    def _origin_of(self, checkpoint: str) -> int:
        mark = f"{checkpoint.rstrip('/')}-origin"
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(mark, "_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            versions = StateStore(self.spark, self.state_root).versions()
            newest = versions[-1] if versions else 0
            self.spark.range(1).select(F.lit(newest).cast("bigint").alias("origin")).write.mode("overwrite").parquet(mark)
        return self.spark.read.parquet(mark).first()["origin"]

    def start(self, landing: str, schema: StructType, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
        self.origin = self._origin_of(checkpoint)
        stream = (
            self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
        )
        return (
            stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(self.alert_root)

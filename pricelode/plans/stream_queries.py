"""Queries that run the streaming operators over files landed from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelode.operators import state
from pricelode.plans.history_queries import part_listings
from pricelode.plans.valuation_queries import as_of
from pricelode.session import materialize, release, scratch_path, tidy_shuffles
from pricelode.sources.state_store import StateStore
from pricelode.streaming.alert_state import keyed_alerts
from pricelode.streaming.intake import ListingIntake


def _land(spark, root) -> tuple[str, object, int]:
    landing = scratch_path(spark, "landing")
    rows = materialize(part_listings(spark, root).drop("part"), "landing-rows")  # both halves read them
    # The older half of the rows lands first; each half is written by all tasks.
    older, files = F.coalesce(F.col("model_year") < 1999, F.lit(False)), spark.sparkContext.defaultParallelism
    with tidy_shuffles(spark):
        rows.filter(older).repartition(files).write.mode("append").parquet(landing)
        rows.filter(~older).repartition(files).write.mode("append").parquet(landing)
    release(rows)
    return landing, rows.schema, files


def _intake(spark, root):
    landing, schema, files = _land(spark, root)
    intake = ListingIntake(spark, scratch_path(spark, "stream-state"), scratch_path(spark, "stream-alerts"), as_of())
    query = intake.start(landing, schema, scratch_path(spark, "stream-checkpoint"), files_per_batch=files)
    query.awaitTermination()
    return StateStore(spark, intake.state_root).load().select(
        "state_key", "first_price", "last_price", "notified", "notified_price"
    )


def _keyed(spark, root):
    landing, schema, _ = _land(spark, root)
    out, name = scratch_path(spark, "keyed-out"), scratch_path(spark, "keyed-checkpoint")
    stream = spark.readStream.schema(schema).parquet(landing)
    keyed = stream.filter("listing_id is not null").withColumn("state_key", F.concat(F.lit("annons:"), "listing_id")).select(
        "state_key", "price", F.concat_ws("-", *[F.lpad(F.col(f"seq.k{i}").cast("string"), 12, "0") for i in range(1, 6)]).alias("pos"),
    )
    query = keyed_alerts(keyed).writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
    ).option("checkpointLocation", name).trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.max_by(F.struct("n_seen", "first_price", "last_price", "n_alerts", "alert_price"), "batch").alias("s")
    return spark.read.parquet(out).groupBy("state_key").agg(last).select("state_key", "s.*")


def _state_of_all(spark, root):
    """The same rows through the batch operators in one run."""
    rows = part_listings(spark, root)
    empty = StateStore.temporary(spark).load()
    return state.update_state(rows, empty, as_of())[1].select("state_key", "first_price", "last_price")


QUERIES = {"stream_intake": _intake, "stream_keyed_alerts": _keyed, "state_from_empty": _state_of_all}

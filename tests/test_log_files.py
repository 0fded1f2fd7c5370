"""The files of the observation log."""

import glob
import os

from pyspark.sql import functions as F

from pricelode.schema import OBSERVATION, conform
from pricelode.sources import observation_log


def test_log_files_are_packed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(observation_log, "FILE_ROWS", 100)
    rows = spark.range(3000).select(
        F.lit("annons").alias("kind"), F.lit("2001-07-01 00:30:00").cast("timestamp").alias("ts"),
        F.concat(F.lit("key"), (F.col("id") % 3).cast("string")).alias("listing_key"), F.col("id").cast("double").alias("price"),
    )
    observation_log.append(conform(rows, OBSERVATION), str(tmp_path))
    files = glob.glob(f"{tmp_path}/records/run-*/month=*/bucket=*/*.json*")
    assert len(files) >= 30 and all(f.endswith(".json.gz") for f in files)
    assert sum(os.path.getsize(f) for f in files) < 3000 * 40
    back = observation_log.scan_log(spark, str(tmp_path))
    assert sorted(r.price for r in back.select("price").collect()) == [float(i) for i in range(3000)]

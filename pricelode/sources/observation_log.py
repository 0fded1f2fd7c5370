"""The append-only log of listing and valuation observations.

Packed JSON lines below one folder, partitioned by month and by a bucket of the listing
key; every append is one Spark write.  The history of a few keys reads the files
of their buckets only.  The scan keeps going over blank, broken and non-object
lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.config import KIND_LISTING, KIND_VALUATION, TrendParams
from pricelode.functions.flags import is_true
from pricelode.operators.history import observation_key
from pricelode.operators.score import first_url
from pricelode.schema import OBSERVATION, conform

_BAD = "_broken"
BUCKETS = 16
FILE_ROWS = 1_000_000


def listing_records(listings: DataFrame, ts: Column) -> DataFrame:
    """One record per listing; unknown equipment is written as false."""
    flags = ("tow_hook", "heater", "certified", "big_battery")
    df = listings if "listing_key" in listings.columns else listings.withColumn("listing_key", observation_key())
    sources = F.col("sources") if "sources" in df.columns else F.array().cast("array<string>")
    out = df.select(
        F.lit(KIND_LISTING).alias("kind"), ts.alias("ts"), "listing_key", "listing_id", "reg_no", "model",
        "variant", "model_year", "mileage", "price", "trim",
        *[is_true(F.col(c)).alias(c) for c in flags],
        sources.alias("sources"),
        F.nullif(first_url(df), F.lit("")).alias("url"),
    )
    return conform(out, OBSERVATION)


def valuation_records(valued: DataFrame, ts: Column) -> DataFrame:
    """One record per valuation, bargain or not."""
    df = valued if "listing_key" in valued.columns else valued.withColumn("listing_key", observation_key())
    median = F.col("adjusted_median").cast("double") if "adjusted_median" in df.columns else F.lit(None).cast("double")
    out = df.select(
        F.lit(KIND_VALUATION).alias("kind"), ts.alias("ts"), "listing_key", "model", "variant", "model_year",
        "mileage", F.col("price").alias("asking_price"), "market_value", "diff", "bargain_pct", "n_comparables",
        "basis_strength", median.alias("adjusted_median"),
    )
    return conform(out, OBSERVATION)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("listing_key"), F.lit(BUCKETS)).cast("int").alias("bucket")


def append(records: DataFrame, root: str, timezone: str = TrendParams.timezone, run_id: str | None = None) -> None:
    """Adds records by month; those of a named run replace what an earlier attempt of the run has written."""
    local = F.convert_timezone(None, F.lit(timezone), F.col("ts"))
    folder = f"{root.rstrip('/')}/records/run-{run_id or uuid.uuid4().hex}"
    rows = records.withColumns({"month": F.date_format(local, "yyyy-MM"), "bucket": _bucket()})
    writer = rows.repartition("month", "bucket").write.partitionBy("month", "bucket").mode("overwrite")
    # A packed file is read by one task, so files are of bounded size.
    writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(folder)


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """All readable records of the given folders or files."""
    schema = T.StructType([*OBSERVATION.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", _BAD
    ).option("recursiveFileLookup", "true").json(list(paths))
    return rows.filter(F.col(_BAD).isNull() & F.col("kind").isNotNull()).select(*OBSERVATION.fieldNames())


def scan_log(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """All records of the log; with ``keys`` (``listing_key``), the records in the buckets of these keys only."""
    records = f"{root.rstrip('/')}/records"
    if keys is None:
        return scan(spark, records)
    touched = sorted(r["bucket"] for r in keys.select(_bucket()).distinct().collect())  # ``BUCKETS`` at most
    paths = [p for b in touched if _any_file(spark, p := f"{records}/run-*/month=*/bucket={b}")]
    return scan(spark, *paths) if paths else spark.createDataFrame([], OBSERVATION)


def _any_file(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))

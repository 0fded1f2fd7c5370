"""Session helpers: local sessions for tests and a shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = 8, app: str = "pricelode", **conf: str) -> SparkSession:
    """A local session as used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PRICELODE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster.

    Only where the cluster names none (local tests) a temporary folder is made
    and remembered for the session.
    """
    configured = spark.conf.get(SHARED_DIR_KEY, None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        configured = current or tempfile.mkdtemp(prefix="pricelode-")
        spark.conf.set(SHARED_DIR_KEY, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that this process has written to the shared folder; call it when their results are used up."""
    dropped = 0
    while _made:
        dropped += _delete(spark, _made.pop())
    return dropped


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go with the end of each: nothing reads them again."""
    was = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, was)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used to cut the lineage of iterative jobs.  Parquet in the shared folder
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def part_of(table: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, made of ``table`` alone: what releases it releases the table."""
    df._scratch = getattr(table, "_scratch", None)
    return df


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` made, once everything that reads them is written; others stay."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)

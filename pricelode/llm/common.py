"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.session import materialize, scratch_path  # noqa: F401  (re-exported)

#: Bytes of text that a task works on at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def rowwise(
    df: DataFrame, column: str, out: T.StructType, work: Callable[[list[bytes]], dict], keep: list[str], limit: int = SLICE_BYTES
) -> DataFrame:
    """``keep`` columns of ``df`` plus what ``work`` makes of the texts of ``column``, slice by slice.

    ``work`` takes a list of UTF-8 texts and returns one list per field of ``out``.  Rows stay in place: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *out.fields])
    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            data = texts(batch.column(n_keep))
            for a, b in slices([len(x) for x in data], limit):
                made = work(data[a:b])
                kept = [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                new = [
                    x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n_keep + i).type)
                    for i, x in enumerate(made[f.name] for f in out.fields)
                ]
                cols = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(kept + new)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__text"))
    return picked.mapInArrow(run, schema)


def seeded(seed: int, *parts: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, *[p & 0xFFFFFFFFFFFFFFFF for p in parts]])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with column ``name``: the place of every row in ``order``, gapless from 0.

    Rows are dealt and sorted by ranges of ``order`` and written once; the number of a row is its place in its range plus the
    rows of the ranges before, one number for each range.  Rows that agree in ``order`` are numbered in any order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "numbered").withColumn("__range", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(before, "__range").withColumn(name, place).select(*[F.col(f"`{c}`") for c in df.columns], name)

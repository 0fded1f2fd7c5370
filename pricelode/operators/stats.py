"""Exact medians for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.session import materialize

# Buckets per doubling of a value.
_BUCKETS = 64


def _at(cells: Column, rank: Column) -> Column:
    """The cell of a sorted histogram that holds ``rank`` (from 0), with the ranks before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.element_at(cells, 1).alias("cell"))

    def step(found: Column, cell: Column) -> Column:
        passed = found.before + found.cell.m <= rank
        moved = F.struct((found.before + found.cell.m).alias("before"), cell.alias("cell"))
        return F.when(passed, moved).otherwise(found)

    return F.aggregate(F.slice(cells, 2, F.size(cells)), start, step)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, count: str) -> DataFrame:
    """Median and number of non-null values per key.

    The input is written once as (keys, value).  Values fall into buckets of
    nearly equal ratio; a rank histogram per key (count, least and greatest value
    of each bucket) combines map-side and spreads a hot key over its buckets.  It
    names the one or two buckets of the middle ranks.  Where such a bucket holds
    a single value the median is known; only the rows of the others are sorted.
    """
    rows = materialize(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), "median-input")
    number = F.col("_v").cast("double")
    bucket = F.signum(number) * F.floor(_BUCKETS * F.log2(1 + F.abs(number)))
    bucket = F.greatest(F.least(bucket, F.lit(1e6)), F.lit(-1e6)).cast("bigint")  # infinite values and NaN at the ends
    rows = rows.withColumn("_b", bucket)
    cells = rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("m"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )
    per_key = cells.groupBy(*keys).agg(
        F.sum("m").alias(count), F.sort_array(F.collect_list(F.struct(F.col("_b").alias("b"), "m", "least", "most"))).alias("_cells")
    )
    n = F.col(count)
    places = {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    per_key = per_key.withColumns({side: _at(F.col("_cells"), rank) for side, rank in places.items()}).drop("_cells")
    single = lambda side: F.col(f"{side}.cell.least") == F.col(f"{side}.cell.most")
    known = materialize(per_key, "median-buckets")

    wanted = known.filter(~single("_low") | ~single("_high"))
    wanted = wanted.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}.cell.b").alias("_b"), (rank - F.col(f"{side}.before")).alias("rank"))
        for side, rank in places.items()
    ])).alias("w")).select(*keys, "w.*")
    buckets = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    counted = rows.join(buckets, same, "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    named = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_v", "_c", "_upto")
    holds = (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c"))
    sorted_out = wanted.join(named, [*same, holds]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == side, F.col("_v"))).alias(f"{side}_v") for side in places]
    ).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"{side}_v" for side in places])
    values = [F.coalesce(F.col(f"{side}_v"), F.col(f"{side}.cell.least")) for side in places]
    return known.join(sorted_out, same[:-1], "left").select(*keys, ((values[0] + values[1]) / 2).alias(out), count)

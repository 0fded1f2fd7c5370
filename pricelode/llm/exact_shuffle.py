"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition permutes its rows.  How many of its rows go to each shard is drawn from the multivariate hypergeometric
law, so that all counts add up to the wanted shard sizes (at most one row apart): the matrix of a uniformly random permutation.
The first rows of a permuted partition go to shard 0, the next to shard 1 and so on; rows of a shard are permuted again, by
random blocks and random keys, and numbered.

Rows are tagged once with their input partition and a number, in a written table, so that lost executors and other split
sizes cannot change a later step.  The matrix is drawn in two levels: the driver draws for groups of ``GROUP`` partitions, tasks
draw for the partitions of a group.  No step puts a shard into one task: ranks are within an input partition or within a block
of about ``BLOCK_ROWS`` rows, and offsets are sums of block counts.

Null texts count as empty; repeated rows are rows of their own; an empty table gives empty shards; further columns pass
through whatever their names, but for ``shard`` and ``slot``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import materialize, seeded

GROUP = 1024
BLOCK_ROWS = 65_536
#: numpy draws exactly below this population.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items in a sample without replacement, for populations of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good + bad else 0
    low, high = max(0, sample - bad), min(good, sample)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    top = math.exp(log(good, mode) + log(bad, sample - mode) - log(good + bad, sample))
    u = rng.random() - top
    up = down = mode
    p_up = p_down = top
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def draw_row(rng: np.random.Generator, left: list[int], rows: int) -> list[int]:
    """How many of ``rows`` rows go to each shard with ``left`` free places; takes the places."""
    out, rest = [], sum(left)
    for j, free in enumerate(left):
        k = hypergeometric(rng, free, rest - free, rows)
        out.append(k)
        rest -= free
        rows -= k
        left[j] -= k
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(__pid, cuts): cumulative counts to shards 0, 1, ... of every partition of ``sizes`` (__pid, rows); and all rows."""
    spark = sizes.sparkSession
    grouped = sizes.withColumn("grp", F.floor(F.col("__pid") / GROUP))
    totals = sorted((r["grp"], r["rows"]) for r in grouped.groupBy("grp").agg(F.sum("rows").alias("rows")).collect())
    n = sum(rows for _, rows in totals)
    left, rng = shard_sizes(n, shards), seeded(seed, 1)
    drawn = [(int(g), draw_row(rng, left, int(rows))) for g, rows in totals]
    groups = spark.createDataFrame(drawn, "grp long, places array<long>")

    def inside(key, frame):
        frame = frame.sort_values("__pid")
        places, own = [int(x) for x in frame["places"].iloc[0]], seeded(seed, 2, int(key[0]))
        cuts = [np.cumsum(draw_row(own, places, int(m))).tolist() for m in frame["rows"]]
        return pd.DataFrame({"__pid": frame["__pid"], "cuts": cuts})

    return grouped.join(groups, "grp").groupBy("grp").applyInPandas(inside, "__pid long, cuts array<long>"), n


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (position in the shard, gapless from 0); input columns of these names are replaced."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).alias("none"))
    rows = materialize(df.select(whole.alias("__whole"), F.monotonically_increasing_id().alias("__row")), "shuffle-rows")
    rows = rows.withColumn("__pid", F.shiftright("__row", 33))  # the input partition
    matrix, n = communication_matrix(rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("rows")), shards, seed)
    matrix = materialize(matrix, "shuffle-matrix")
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(F.xxhash64(F.lit(seed), "__row"), "__row"))
    sent = rows.withColumn("__rank", local).join(matrix, "__pid")
    blocks = max(1, -(-n // (shards * BLOCK_ROWS)))
    key = F.xxhash64(F.lit(seed + 1), "__row")
    placed = sent.withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("__rank")))).withColumn("__block", F.pmod(key, F.lit(blocks)))
    placed = materialize(placed.drop("cuts", "__rank", "__pid"), "shuffle-placed")
    counts = placed.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("__block")) - F.col("rows")
    offsets = counts.select("shard", "__block", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("shard", "__block").orderBy(key, "__row"))
    numbered = placed.withColumn("__rank", rank).join(offsets, ["shard", "__block"])
    return numbered.select(*[F.col(f"__whole.`{c}`") for c in kept], "shard", (F.col("__before") + F.col("__rank") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 11) -> None:
    """The shuffled rows as Parquet folders shard=0, 1, ..., in the order of their slots within a file."""
    out = shuffle_into_shards(df, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shards_query(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(rows)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

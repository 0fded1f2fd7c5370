"""Mixing sources to target weights by hash thresholds.

Every source has a target size: its weight's share of all sizes, at most ``CEILING`` times its own size; what a source cannot use is shared
among the others by weight.  A source repeats all its rows as often as the target allows in full, and the rest of the target, its budget,
is met by the rows whose hash lies below a threshold.  Thresholds are nested: a larger budget takes the same rows and more.

1. Sizes are added by source, sources are numbered in code point order, and the level of the targets is found by rounds of sums over
   the sources.
2. A histogram adds sizes by (source, ``STEP`` bits of the hash).  The bucket in which the running sum passes the budget is the
   boundary; only its rows are read in the next round, by their next bits, until the whole hash is spent.  Nothing is sorted.
3. Rows are filtered by their source's threshold.  Of the rows with the boundary hash itself, all or none are taken, whichever is nearer.

A source misses its target by half of one row at most (of all rows of one key, where keys repeat).  The driver receives sums over all sources
only.  A null source is a source of its own and the last; a null or empty text has size 0 and is taken as often as its hash says, at no size;
a null key counts as an empty string; repeated rows have equal hashes and are taken alike.  An empty table gives an empty result.  Further
columns pass through ``mixture`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import materialize, numbered

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
HASH_BITS, STEP = 60, 15


def row_hash(key: Column) -> Column:
    """The first ``HASH_BITS`` bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, number, source_size, target) of every source of ``rows`` (source, size)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    known = numbered(sizes, [F.col("source").asc_nulls_last()], "number").withColumn("weight", weight)
    most = (F.col("source_size") * ceiling).cast("double")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:  # the level rises and fills more sources each round, until no further one is full
        is_full = F.lit(False) if level is None else most <= F.lit(level) * F.col("weight")
        found = known.agg(
            F.count(F.when(is_full, 1)).alias("n"), F.sum(F.when(is_full, most)).alias("taken"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")
        ).first()
        if found["n"] == full or not found["open"]:
            break
        full, level = found["n"], (total - (found["taken"] or 0.0)) / found["open"]
    target = F.least(most, F.lit(level or 0.0) * F.col("weight"))
    return known.select("source", "number", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(number, copies, last): rows of a source are taken ``copies`` times, and once more where hash <= last.

    ``rows`` has (number, size, hash); ``targets`` has (number, source_size, target).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select("number", whole.alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    plan = materialize(plan, "mix-plan")
    bound = plan.filter("budget > 0").select("number", "budget", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        if shift + STEP < HASH_BITS:  # rows of the boundary bucket only
            known = bound.select(F.col("number").alias("__n"), "prefix")
            here = (F.col("number") == F.col("__n")) & (F.shiftright("hash", shift + STEP) == F.col("prefix"))
            rows = materialize(rows.join(known, here).select("number", "size", "hash"), "mix-boundary")
        histogram = rows.groupBy("number", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("number").orderBy("bucket"))
        summed = histogram.withColumn("upto", upto).join(bound.select("number", "budget"), "number")
        passed = summed.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("size") <= F.col("budget")))
        passed = passed.select("number", "bucket", "size", (F.col("budget") - (F.col("upto") - F.col("size"))).alias("budget"))
        passed = materialize(passed, "mix-histogram")
        bound = passed.select("number", "budget", F.col("bucket").alias("prefix"))
    nearer = F.col("size") - F.col("budget") < F.col("budget")
    last = passed.select("number", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("last"))
    return plan.select("number", "copies").join(last, "number", "left").withColumn("last", F.coalesce("last", F.lit(-1)))


def mixture(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(row, size, source_size, target, copies) of every row; ``row`` is a struct of all columns of ``df``."""
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{source}`").alias("source"), size.cast("long").alias("size"), row_hash(F.col(f"`{key}`")).alias("hash"))
    narrow = materialize(named.select("source", "size", "hash"), "mix-rows")
    targets = materialize(source_targets(narrow, weights, ceiling), "mix-targets")
    by_name = targets.select(F.col("source").alias("__source"), "number", "source_size", "target")
    own = narrow.join(by_name.select("__source", "number"), F.col("source").eqNullSafe(F.col("__source"))).select("number", "size", "hash")
    plan = materialize(by_name.join(thresholds(own, targets), "number"), "mix-thresholds")
    copies = F.col("copies") + (F.col("hash") <= F.col("last")).cast("long")
    placed = named.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as the mix takes it."""
    return mixture(df, size, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_query(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    found = mixture(rows, F.col("n_words"))
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("row.source").alias("source"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    (3 * source_size)::DOUBLE AS most
  FROM s),
steps AS (  -- sources from the first to be full on: the level if all before it are full
  SELECT *, row_number() OVER o AS step, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
t AS (
  SELECT w.source, w.source_size, least(w.most, w.weight * (SELECT level FROM steps WHERE level * weight < most OR step = (SELECT max(step) FROM steps) ORDER BY step LIMIT 1)) AS target
  FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
h AS (  -- keys that hash alike are taken alike
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (
  SELECT p.source, max(CASE WHEN h.size - (p.target - p.copies * p.source_size - (h.upto - h.size)) < p.target - p.copies * p.source_size - (h.upto - h.size) THEN h.h ELSE h.h - 1 END) AS last
  FROM p JOIN h ON h.source IS NOT DISTINCT FROM p.source
  WHERE h.upto > p.target - p.copies * p.source_size AND h.upto - h.size <= p.target - p.copies * p.source_size AND p.target - p.copies * p.source_size > 0
  GROUP BY p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.copies + (d.h <= coalesce(b.last, -1))::BIGINT) AS taken, d.source
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
"""

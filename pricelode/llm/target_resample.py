"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to ``MOST`` words, joined by a space; each falls into one of ``buckets`` buckets by the crc32 of its bytes.
The gain of a bucket is the logarithm of its share among the target's features over its share among all raw features; a text's
weight is the sum of gains over its features.  Adding Gumbel noise to the weights and taking the highest draws without replacement in
proportion to the importance of the texts.

Within a task, a block of words at a time is interned: all occurrences of n-grams meet in an open-addressed table (``gram_table``), whose
slots hold the bucket and the count of each distinct n-gram.  The counting pass adds the count slots by bucket; the weighing pass
gathers gains by the slot ids of the occurrences.  Both passes read the texts in place; only bucket sums (bounded by ``buckets``) and one narrow
row per text are shuffled.  Ranks come from a range sort, numbered partition by partition.

Null and empty texts, and texts without a word, have no features and weight 0.  A null id counts as an empty string in the noise.  Rows are ranked one by one, so
repeated rows have neighbouring ranks; ties go to the smaller id.  An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import materialize, numbered, rowwise, slices, texts
from pricelode.llm.gram_table import Ranges, join_crc32

MOST = 3
BUCKETS = 10_000
SMOOTHING = 1
SCALE = 1000
#: Words that are interned at a time.
BLOCK = 1 << 16
SLICE = 1 << 20
_WORD = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 for b in range(256)])


class Words:
    """The words of some texts, in lower case (A to Z only), joined by a space in ``buffer``."""

    def __init__(self, data: list[bytes]):
        raw = np.frombuffer(b"\n".join(data).lower() + b"\n", np.uint8)
        word = _WORD[raw]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        behind = np.zeros(len(raw), bool)
        behind[1:] = word[:-1]
        keep = word | behind
        self.buffer = np.where(word, raw, np.uint8(32))[keep]
        sizes = edge[1::2] - edge[::2]
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.text = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), edge[::2], side="right")


def interned(words: Words, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: text and slot of every occurrence, bucket and count of every slot (slots that hold nothing count 0)."""
    for low in range(0, len(words.start), BLOCK):
        n = min(BLOCK, len(words.start) - low)
        here = slice(low, low + n + MOST - 1)  # n-grams that start in the block end behind it
        base = int(words.start[low])
        start, end, text = words.start[here] - base, words.end[here] - base, words.text[here]
        ranges = Ranges(words.buffer[base : base + int(end[-1])])
        first = [np.arange(min(n, len(text) - k)) for k in range(MOST)]
        first = [at[text[at] == text[at + k]] for k, at in enumerate(first)]
        spare = np.arange(n, len(text))
        size = np.concatenate([*(end[at + k] - start[at] for k, at in enumerate(first)), (end - start)[spare]])
        slots, holder = ranges.intern(np.concatenate([start[at] for at in (*first, spare)]), size)
        word = np.concatenate([slots[:n], slots[len(slots) - len(spare) :]])
        crc = np.concatenate(_crcs(ranges, start, end, word, first))
        bucket = np.zeros(len(holder), np.int64)
        bucket[slots[: len(crc)]] = crc.astype(np.int64) % buckets
        slots = slots[: len(crc)]
        yield np.concatenate([text[at] for at in first]), slots, bucket, np.bincount(slots, minlength=len(holder))


def _crcs(ranges: Ranges, start: np.ndarray, end: np.ndarray, word: np.ndarray, first: list[np.ndarray]) -> list[np.ndarray]:
    """crc32 of the n-grams from ``first[n - 1]`` on; bytes are read once for each slot ``word`` of a word."""
    size = end - start
    _, one, own_of = np.unique(word, return_index=True, return_inverse=True)
    own = ranges.crc32(start[one], size[one])[own_of]
    space = np.full(len(own), crc32(b" "), np.uint32)
    behind = join_crc32(space, own, size)  # the word with a space ahead
    out, crc = [], own
    for k, at in enumerate(first):
        if k:
            crc = join_crc32(crc[:-1], behind[k:], size[k:] + 1)
        out.append(crc[at])
    return out


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; the driver receives ``buckets`` numbers at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data = texts(batch.column(0))
            for a, b in slices([len(x) for x in data], SLICE):
                for _, _, bucket, count in interned(Words(data[a:b]), buckets):
                    total += np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    counted = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole gains in units of 1 / ``scale``, with ``SMOOTHING`` more features in every bucket."""
    n = len(raw) * SMOOTHING
    over, under = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(scale * math.log((t + SMOOTHING) * over / ((s + SMOOTHING) * under))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, n_features and weight of every row."""
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])

    def work(data):
        n, words = len(data), Words(data)
        found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for text_of, slots, bucket, _ in interned(words, len(gains)):
            found += np.bincount(text_of, minlength=n)
            weight += np.bincount(text_of, weights=gains[bucket[slots]], minlength=n).astype(np.int64)
        return {"n_words": np.bincount(words.text, minlength=n), "n_features": found, "weight": weight}

    return rowwise(df, text, out, work, keep, SLICE)


def gumbel(key: str, seed: int, scale: int = SCALE):
    """Whole Gumbel noise of a key, alike in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row; ``percent`` of the rows with ``min_words`` or more words have a rank."""
    gains = bucket_gains(bucket_counts(df, text, buckets), bucket_counts(target, "text", buckets))
    weighed = weigh(df, gains, [key], text).withColumn("score", F.col("weight") + gumbel(key, seed))
    weighed = materialize(weighed, "resample-weights")
    able = F.col("n_words") >= min_words
    n = weighed.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col(f"`{key}`").asc(), F.col("n_features").asc()]
    ranked = numbered(weighed.filter(able), order, "place").withColumn("rank", F.when(F.col("place") < n, F.col("place") + 1))
    rest = weighed.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place").unionByName(rest)


def drawn(df: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose key has a rank; all rows of a repeated key go together."""
    keys = resample(df, target, key, **options).filter("rank is not null").select(F.col(f"`{key}`").alias("__drawn"))
    return df.join(keys, F.col(f"`{key}`").eqNullSafe(F.col("__drawn")), "left_semi")


def resample_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


# crc32 is linear: each byte's share, carried over the bytes behind it, is looked up and added up by XOR; ``carry`` with b = 256 is the start value.
RESAMPLE_SQL = """
WITH RECURSIVE words AS (
  SELECT 0 AS src, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
cut AS (
  SELECT src, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM words),
counts AS (
  SELECT src, doc_id, f, count(*) AS n
  FROM (SELECT src, doc_id, array_to_string(w[i:i + k - 1], ' ') AS f
        FROM (SELECT src, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3)) v(k)))
  GROUP BY ALL),
feats AS (SELECT f, hex(f) AS h, strlen(f) AS size FROM (SELECT DISTINCT f FROM counts)),
tab AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(b)),
carry AS (
  SELECT b, 0::BIGINT AS k, c FROM tab UNION ALL SELECT 256, 0, 4294967295
  UNION ALL
  SELECT y.b, y.k + 1, xor(y.c >> 8, t.c) FROM carry y JOIN tab t ON t.b = y.c & 255 WHERE y.k < (SELECT max(size) FROM feats)),
shares AS (
  SELECT f, size, bit_xor(c) AS x
  FROM (SELECT f, size, i, ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT AS b FROM (SELECT f, size, h, unnest(range(size)) AS i FROM feats)) s
    JOIN carry ON carry.b = s.b AND carry.k = size - 1 - i
  GROUP BY f, size),
hashed AS (SELECT f, xor(4294967295, xor(x, carry.c)) % 10000 AS bucket FROM shares JOIN carry ON carry.b = 256 AND carry.k = size),
held AS (SELECT bucket, coalesce(sum(n) FILTER (src = 0), 0) AS s, coalesce(sum(n) FILTER (src = 1), 0) AS t FROM counts JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM held),
gains AS (
  SELECT bucket, floor(1000 * ln((held.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((held.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM held, total),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counts JOIN hashed USING (f) JOIN gains USING (bucket) WHERE src = 0 GROUP BY doc_id),
scored AS (
  SELECT c.doc_id, len(c.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || c.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut c LEFT JOIN weights w ON w.doc_id = c.doc_id WHERE c.src = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, r.rank
FROM scored s LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) FROM ranked) * 5 // 100) r ON r.doc_id = s.doc_id
"""

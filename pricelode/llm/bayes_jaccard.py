"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word shingles (five words; a shorter text is one shingle of all its words).  Documents of equal sets
are one class, represented by one of them.  Classes that share a band of MinHash values are candidates.  For every candidate
pair the MinHash values are compared step by step; a pair is dropped once the posterior probability that its similarity reaches
the threshold, given the agreements so far and a uniform prior, falls below a tolerance.  What is left is verified on the
sets.

A pair belongs to the first band that its classes share, so every pair is looked at once and no list of distinct pairs is
needed.  Pairs are never rows: a bucket's classes are dealt into blocks of ``BLOCK`` classes, each pair of blocks is a group
of a task, and a task returns a row per class (links found, and a root of the classes that hang together in the group).  So copies
cost nothing, and a hot bucket is many small groups.  Roots are joined to components by label rounds over written tables.

Texts without a word have no class and no links.  Null texts and ids are allowed; equal rows are documents of their own; ties
for the representative go to the smaller hash; further columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import materialize, rowwise
from pricelode.llm.word_hash import hash_words, mix, windows

SHINGLE = 5
THRESHOLD = 0.8
VALUES, ROWS = 128, 4  # MinHash values, and those of a band
BANDS = VALUES // ROWS
STEP = 16
TOLERANCE = 1e-9
BLOCK = 512

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, VALUES, np.uint64)


def shingles(data: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = hash_words(data)
    hashes, starts = windows(words, tuple(range(size)))
    edges = np.searchsorted(starts, words.first)
    out = []
    for i in range(len(data)):
        own = hashes[edges[i] : edges[i + 1]]
        short = words.of(i)
        if not len(own) and len(short):
            own = mix((short * (np.arange(len(short), dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(keepdims=True, dtype=np.uint64))
        out.append(np.unique(own))
    return out


def min_hash(found: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 8192):
        part = ((found[at : at + 8192, None] * MULTIPLY + ADD) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(0))
    return least


def digest(found: np.ndarray) -> bytes:
    """128 bits of a set."""
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of the bands of signatures."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.full(parts.shape[:2], 7, np.uint64)
    for r in range(ROWS):
        key = mix(key ^ (parts[:, :, r] + np.uint64(r << 33)))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Least agreements after STEP, 2 STEP, ... values at which a pair stays.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pairs_within(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """All pairs (i < j) of rows of a group; of two blocks (side 0 and 1) only the pairs across.  ``group`` is sorted."""
    found, rows, d = [], np.arange(len(group)), 1
    while len(rows):
        rows = rows[rows + d < len(group)]
        rows = rows[group[rows + d] == group[rows]]
        found.append(np.stack([rows, rows + d]))
        d += 1
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return out[:, (side[out[0]] == 2) | (side[out[0]] != side[out[1]])]


def surviving(pairs: np.ndarray, signatures: np.ndarray, keys: np.ndarray, band: np.ndarray, least: list[int]) -> np.ndarray:
    """Pairs that share no band before the group's own, and that no comparison of values drops."""
    for b in range(BANDS - 1):
        later = band[pairs[0]] > b
        if not later.any():
            break
        pairs = pairs[:, ~later | (keys[pairs[0], b] != keys[pairs[1], b])]
    same = np.zeros(pairs.shape[1], np.int32)
    for step, m in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        same = same + (signatures[pairs[0], part] == signatures[pairs[1], part]).sum(1, dtype=np.int32)
        stay = same >= m
        pairs, same = pairs[:, stay], same[stay]
    return pairs


def whole_groups(batches, n_keys: int, limit: int):
    """Arrow tables of about ``limit`` rows that end at a group's end; the input is sorted by its first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < limit:
            continue
        table = pa.Table.from_batches(held)
        cut = count
        last = [table.column(k)[count - 1].as_py() for k in range(n_keys)]
        same = np.ones(count, bool)
        for k in range(n_keys):
            same &= table.column(k).to_numpy() == last[k]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held)


GROUP_KEYS = ["bucket", "left", "right"]


def _read_groups(table: pa.Table):
    bucket, left, right = (table.column(k).to_numpy() for k in range(3))
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    own = table.column("block").to_numpy()
    side = np.where(left == right, 2, (own == right).astype(np.int64))
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
    return np.cumsum(new), side, signatures, band_keys(signatures), table.column("band").to_numpy()


def candidates_of(least: list[int]):
    """Marks the rows of groups that have a surviving pair."""

    def run(batches):
        for table in whole_groups(batches, 3, 4000):
            group, side, signatures, keys, band = _read_groups(table)
            pairs = surviving(pairs_within(group, side), signatures, keys, band, least)
            rows = np.unique(pairs)
            if len(rows):
                picked = table.select([*GROUP_KEYS, "band", "block", "class"]).take(pa.array(rows))
                yield from picked.combine_chunks().to_batches()

    return run


def links_of(least: list[int], threshold: float):
    """Per group and class: documents linked to it, classes linked to it, and the root of what hangs together."""

    def run(batches):
        schema = pa.schema([("class", pa.binary()), ("root", pa.binary()), ("linked_docs", pa.int64()), ("linked_classes", pa.int64())])
        for table in whole_groups(batches, 3, 1500):
            group, side, signatures, keys, band = _read_groups(table)
            pairs = surviving(pairs_within(group, side), signatures, keys, band, least)
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            shared = common(sets, group, pairs)
            linked = shared >= threshold * (sizes[pairs[0]] + sizes[pairs[1]] - shared) - 1e-9
            pairs = pairs[:, linked]
            if not pairs.shape[1]:
                continue
            n = table.num_rows
            members = table.column("members").to_numpy()
            docs = np.bincount(pairs[0], members[pairs[1]], n) + np.bincount(pairs[1], members[pairs[0]], n)
            classes = np.bincount(pairs.ravel(), minlength=n)
            root = np.arange(n)
            while True:
                before = root.copy()
                least_root = np.minimum(root[pairs[0]], root[pairs[1]])
                np.minimum.at(root, pairs[0], least_root)
                np.minimum.at(root, pairs[1], least_root)
                root = root[root]
                if (root == before).all():
                    break
            rows = np.flatnonzero(classes)
            names = table.column("class").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in rows], pa.binary()), pa.array([names[i] for i in root[rows]], pa.binary()),
                    pa.array(docs[rows].astype(np.int64)), pa.array(classes[rows].astype(np.int64)),
                ],
                schema=schema,
            )

    return run


def common(sets: list[np.ndarray], group: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Shared elements of every pair.  Pairs of a large group come from products of its incidence matrix, by slices of columns."""
    out = np.zeros(pairs.shape[1], np.int64)
    if not len(out):
        return out
    of = group[pairs[0]]
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        rows = np.unique(pairs[:, own])
        if len(own) <= 3:
            for p in own:
                out[p] = len(np.intersect1d(sets[pairs[0, p]], sets[pairs[1, p]], assume_unique=True))
            continue
        everything = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
        columns, counts = np.unique(everything, return_inverse=True, return_counts=True)[1:]
        often = counts[columns] > 1
        number = np.cumsum(counts > 1) - 1
        columns, owner = number[columns[often]], owner[often]
        total = np.zeros((len(rows), len(rows)), np.float32)
        width = max(1, 4_000_000 // len(rows))
        by = np.argsort(columns, kind="stable")
        columns, owner = columns[by], owner[by]
        for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
            i, j = np.searchsorted(columns, [at, at + width])
            m = np.zeros((len(rows), width), np.float32)
            m[owner[i:j], columns[i:j] - at] = 1
            total += m @ m.T
        out[own] = np.rint(total[np.searchsorted(rows, pairs[0, own]), np.searchsorted(rows, pairs[1, own])]).astype(np.int64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(class, label): the least class that each class of ``edges`` (class, root) hangs together with."""
    both = materialize(edges.select("class", "root").union(edges.select("root", "class")).filter("class <> root").distinct(), "near-edges")
    labels = materialize(both.groupBy("class").agg(F.least("class", F.min("root")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("root"), "label"), "root").groupBy("class").agg(F.min("label").alias("near"))
        lower = labels.join(near, "class").select("class", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("class").alias("label"), F.col("label").alias("further"))
        after = materialize(lower.join(jump, "label", "left").select("class", F.coalesce("further", "label").alias("label"), "old"), "near-labels")
        if not after.filter("label <> old").limit(1).count():
            return after.select("class", "label")
        labels = after.select("class", "label")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: (id, k1, k2, class_id, copy_id, n_copies, n_links).

    k1, k2: hashes of id and text; class_id: least id of the documents that links and equal sets hang together; copy_id: least
    id of the documents of equal set; n_copies: those documents; n_links: documents of other sets at the threshold or above.
    """
    least = least_matches(threshold, tolerance)
    key = [F.xxhash64("id", "text"), F.xxhash64(F.lit(1), "text", "id")]
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumns({"k1": key[0], "k2": key[1]})
    out = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("signature", T.BinaryType())])

    def sign(data):
        found = shingles(data)
        return {
            "class": [digest(s) if len(s) else None for s in found],
            "signature": [min_hash(s).tobytes() if len(s) else None for s in found],
        }

    signed = materialize(rowwise(rows, "text", out, sign, ["id", "k1", "k2"]), "near-signed")
    rep = F.min(F.struct("k1", "k2", "signature"))
    classes = signed.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("copy_id"), rep.alias("rep"))
    classes = materialize(classes.select("class", "members", "copy_id", "rep.*"), "near-classes")

    def spread_bands(batches):
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            keys = band_keys(signatures).astype(np.int64)
            which = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), batch.column(0).take(pa.array(which))],
                names=["bucket", "band", "class"],
            )

    bands = classes.select("class", "signature").mapInArrow(spread_bands, "bucket long, band int, class binary")
    blocks = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = materialize(bands.join(blocks, "bucket"), "near-buckets")
    placed = shared.withColumn("block", F.pmod(F.xxhash64("class", "bucket"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other).select(
        "bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "band", "block", "class"
    )
    ready = dealt.join(classes.select("class", "signature"), "class").select(*GROUP_KEYS, "band", "block", "class", "signature")
    grouped = ready.repartition(*GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS)
    kind = "bucket long, left int, right int, band int, block int, class binary"
    hopeful = materialize(grouped.mapInArrow(candidates_of(least), kind), "near-candidates")

    wanted = hopeful.select("class").distinct().join(classes, "class").select("class", "members", "signature", F.col("k1"), F.col("k2"))
    sets = T.StructType([T.StructField("shingles", T.BinaryType())])
    texts = rows.join(wanted, ["k1", "k2"]).select("class", "members", "signature", "text")
    wanted_sets = rowwise(texts, "text", sets, lambda data: {"shingles": [s.tobytes() for s in shingles(data)]}, ["class", "members", "signature"])
    wanted_sets = materialize(wanted_sets, "near-sets").dropDuplicates(["class"])
    full = hopeful.join(wanted_sets, "class").select(*GROUP_KEYS, "band", "block", "class", "signature", "members", "shingles")
    full = full.repartition(*GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS)
    links = materialize(full.mapInArrow(links_of(least, threshold), "class binary, root binary, linked_docs long, linked_classes long"), "near-links")

    totals = links.groupBy("class").agg(F.sum("linked_docs").alias("n_links"))
    labels = components(links)
    of_class = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    ids = of_class.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    known = of_class.join(ids, "label").join(totals, "class", "left").select("class", "class_id", "copy_id", "members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = materialize(known, "near-known")
    return signed.select("id", "k1", "k2", "class").join(known, "class", "left").select(
        "id", "k1", "k2", "class_id", "copy_id", F.col("members").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("class").isNotNull().alias("has_class"),
    )


def join_query(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "copy_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of every class the document of least id (ties: least hash), once; documents without a word are one
    group for each text."""
    found = materialize(near_duplicates(docs), "near-found")
    first = found.filter("has_class").groupBy("class_id").agg(F.min(F.struct("id", "k1", "k2")).alias("kept"), F.count(F.lit(1)).alias("n"))
    keep = materialize(first.select("kept.k1", "kept.k2"), "near-kept")
    keyed = docs.withColumns({"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    mine = (F.col("__k1") == keep["k1"]) & (F.col("__k2") == keep["k2"])
    chosen = keyed.join(keep, mine, "left_semi")
    repeated = materialize(
        found.join(keep, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2"), "near-repeated"
    )
    again = (F.col("__k1") == repeated["k1"]) & (F.col("__k2") == repeated["k2"])
    once = chosen.join(repeated, again, "left_anti").union(chosen.join(repeated, again, "left_semi").dropDuplicates(["__k1", "__k2"]))
    wordless = found.filter("not has_class").select("k1", "k2").distinct()
    none = keyed.join(wordless, (F.col("__k1") == wordless["k1"]) & (F.col("__k2") == wordless["k2"]), "left_semi")
    none = none.withColumn("__text", F.sha2(F.col("text").cast("binary"), 256))
    least = none.groupBy("__text").agg(F.min(F.struct(*[F.col(c) for c in ("doc_id", "__k1", "__k2")])).alias("__least")).select("__least.*")
    none = none.drop("__text").join(least.select("__k1", "__k2"), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return once.select(*docs.columns).union(none.select(*docs.columns))

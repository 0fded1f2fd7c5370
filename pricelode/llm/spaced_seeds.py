"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over a few consecutive tokens; the tokens at its gaps are ignored, so a seed still matches where some
tokens have been replaced.  The seeds of the benchmark items form a sorted array; every document's seeds are looked up in it
(through a small bit table first), and each hit is verified: along the hit's diagonal item and document are compared token by
token, and the best-scoring run counts if it is long enough and enough of its tokens are equal, or else the longest such window.

Masks are made so that no overlap is missed.  A long enough window halves until it has under twice the least length; its mismatches
leave a run of equal tokens, or runs of one length with single gaps, that a mask of few tokens meets.  A shorter item is divided into parts, more
than it may have mismatches; each mask compares as many of the parts as are sure to be equal.

The benchmark is a stated query set: it is worked off in blocks of at most about ``BLOCK_TOKENS`` tokens, one pass over the
documents each, so what is shipped to the tasks has a fixed bound and documents are never shuffled.

Tokens are runs of ASCII letters and digits and of non-ASCII characters, in lower case.  An overlap has at least
``min_tokens`` tokens (or the whole item, if that is shorter) of which ``min_share`` are equal;
items of fewer than ``MIN_ITEM`` tokens, empty and null ones match nothing.  Null and empty documents have no overlaps; equal
items are reported each; repeated documents give repeated results; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import rowwise
from pricelode.llm.word_hash import Words, hash_words, windows

MIN_ITEM = 5
#: Tokens that a mask of a short item compares at least, where it can.
WEIGHT = 4
BLOCK_TOKENS = 1 << 20
TABLE_BITS = 20


def tolerated(n: int, min_share: float) -> int:
    """Tokens of ``n`` that may differ."""
    return max(k for k in range(n + 1) if n - k >= min_share * n or not k)


def long_masks(min_tokens: int, min_share: float) -> list[tuple[int, ...]]:
    """Masks of which one at least fits into every window of ``min_tokens`` or more with a share of ``min_share``."""
    cases = [(n, tolerated(n, min_share)) for n in range(min_tokens, 2 * min_tokens)]
    run = max(1, min(-(-(n - k) // (k + 1)) for n, k in cases))
    short = [(n, k) for n, k in cases if -(-(n - k) // (k + 1)) <= run]
    if all(k and n - k == run * (k + 1) for n, k in short):  # a longer run, or all runs are equal with one token between them
        return [tuple(range(run + 1)), tuple(i for i in range(2 * run + 1) if i != run)]
    return [tuple(range(run))]


def short_masks(n: int, min_share: float) -> list[tuple[int, ...]]:
    """Masks of which one at least fits onto a whole item of ``n`` tokens with a share of ``min_share``."""
    k = tolerated(n, min_share)
    for equal in range(1, max(1, n - k) + 1):
        parts = [p.tolist() for p in np.array_split(np.arange(n), min(n, k + equal))]
        if sum(sorted(map(len, parts))[:equal]) >= min(WEIGHT, n - k):
            break
    return [tuple(sum(chosen, [])) for chosen in combinations(parts, equal)]


@dataclass
class Seeds:
    """Sorted seed hashes of a mask with the item and token position of each, and a bit table over their leading bits."""

    where: tuple[int, ...]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    known: np.ndarray


@dataclass
class Block:
    seeds: list[Seeds]
    items: Words


def index_items(texts: list[bytes], min_tokens: int = 13, min_share: float = 0.8) -> Block:
    items = hash_words(texts)
    sizes = np.diff(items.first)
    long = (sizes >= min_tokens) & (sizes >= MIN_ITEM)
    short = sorted({int(n) for n in sizes if MIN_ITEM <= n < min_tokens})
    masks = [(m, long, False) for m in long_masks(min_tokens, min_share)]
    out = []
    for where, chosen, whole in [*masks, *((m, sizes == n, True) for n in short for m in short_masks(n, min_share))]:
        hashes, starts = windows(items, where)
        item = np.searchsorted(items.first, starts, side="right") - 1
        ok = chosen[item] & ((starts == items.first[item]) | (not whole))
        hashes, starts, item = hashes[ok], starts[ok], item[ok]
        order = np.argsort(hashes, kind="stable")
        known = np.zeros(1 << TABLE_BITS, bool)
        known[hashes >> np.uint64(64 - TABLE_BITS)] = True
        out.append(Seeds(where, hashes[order], item[order], (starts - items.first[item])[order], known))
    return Block(out, items)


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """The run of the highest score, a match counting 1 and a mismatch -2."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.flatnonzero(total[:end] == low[end - 1])[0])
    return start, end


def longest_window(equal: np.ndarray, least: int, min_share: float) -> tuple[int, int] | None:
    """The first longest window of ``least`` or more with the share, without unequal ends that it can spare."""
    total = np.concatenate([[0], np.cumsum(equal)])
    size = len(equal)
    enough = lambda n: np.flatnonzero(total[n:] - total[:-n] >= min_share * n)
    if size < least or total[-1] < min_share * least or not any(len(enough(n)) for n in range(least, min(size + 1, 2 * least))):
        return None
    n = next(n for n in range(size, least - 1, -1) if len(enough(n)))
    i = int(enough(n)[0])
    j = i + n
    while j - i > least and not (equal[i] and equal[j - 1]):
        i, j = (i, j - 1) if not equal[j - 1] else (i + 1, j)
    return i, j


def find_overlaps(data: list[bytes], block: Block, min_tokens: int, min_share: float) -> list[list[tuple[int, int, int, int, int]]]:
    """(item, document token, item token, tokens, equal tokens) of each text."""
    docs = hash_words(data)
    out: list[list] = [[] for _ in data]
    diagonals: set[tuple[int, int, int]] = set()
    for seeds in block.seeds:
        if not len(seeds.hashes):
            continue
        hashes, starts = windows(docs, seeds.where)
        maybe = np.flatnonzero(seeds.known[hashes >> np.uint64(64 - TABLE_BITS)])
        low = np.searchsorted(seeds.hashes, hashes[maybe])
        hit = (low < len(seeds.hashes)) & (seeds.hashes[np.minimum(low, len(seeds.hashes) - 1)] == hashes[maybe])
        maybe, low = maybe[hit], low[hit]
        high = np.searchsorted(seeds.hashes, hashes[maybe], side="right")
        many = high - low
        rows = np.repeat(starts[maybe], many)
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc = np.searchsorted(docs.first, rows, side="right") - 1
        shift = rows - docs.first[doc] - seeds.at[which]
        diagonals.update(zip(doc.tolist(), seeds.item[which].tolist(), shift.tolist()))
    for doc, item, shift in sorted(diagonals):
        a, b = docs.of(doc), block.items.of(item)
        start, stop = max(0, -shift), min(len(b), len(a) - shift)
        equal = a[start + shift : stop + shift] == b[start:stop]
        i, j = best_run(equal)
        least = min(min_tokens, len(b))
        if j - i < least or equal[i:j].sum() < min_share * (j - i):
            window = longest_window(equal, least, min_share)
            if not window:
                continue
            i, j = window
        out[doc].append((item, start + shift + i, start + i, j - i, int(equal[i:j].sum())))
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int, min_tokens: int = 13, min_share: float = 0.8):
    """(item ids, Block) for each block of the benchmark; a block is all that is ever on the driver."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * limit)))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if part:
            yield [r["id"] for r in part], index_items([r["text"].encode() for r in part], min_tokens, min_share)


def mark_overlaps(df: DataFrame, benchmark: DataFrame, keep: list[str], **options) -> DataFrame:
    """``keep`` columns plus ``overlaps``: array of (item_id, doc_at, item_at, n_tokens, n_equal)."""
    return _marked(df, benchmark, keep, **options).select("__row.*", "overlaps")


def _marked(
    df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_tokens: int = 13, min_share: float = 0.8, limit: int = BLOCK_TOKENS,
) -> DataFrame:
    kind = benchmark.schema[item_id].dataType
    fields = [T.StructField(c, T.LongType()) for c in ("doc_at", "item_at", "n_tokens", "n_equal")]
    item = T.ArrayType(T.StructType([T.StructField("item_id", kind), *fields]))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{text}`").alias("__body"))
    out = out.withColumn("__found", F.lit(None).cast(item))
    for ids, block in blocks(benchmark, item_id, item_text, limit, min_tokens, min_share):

        def work(data, ids=ids, block=block):
            found = find_overlaps(data, block, min_tokens, min_share)
            names = ("item_id", "doc_at", "item_at", "n_tokens", "n_equal")
            return {"__more": [[dict(zip(names, (ids[o[0]], *o[1:]))) for o in row] for row in found]}

        more = rowwise(out, "__body", T.StructType([T.StructField("__more", item)]), work, ["__row", "__body", "__found"])
        found = F.concat(F.coalesce("__found", F.array().cast(item)), F.col("__more"))
        out = more.select("__row", "__body", found.alias("__found"))
    return out.select("__row", F.coalesce("__found", F.array().cast(item)).alias("overlaps"))


def overlap_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: the longest overlap and the number of overlaps."""
    found = mark_overlaps(documents, benchmark, ["doc_id"]).filter(F.size("overlaps") > 0)
    each = found.select("doc_id", "overlaps", F.explode(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"]))).alias("item_id"))
    mine = F.filter("overlaps", lambda o: o["item_id"].eqNullSafe(F.col("item_id")))
    longest = F.array_max(F.transform(mine, lambda o: F.struct(o["n_equal"].alias("e"), o["n_tokens"].alias("n"), (-o["doc_at"]).alias("p"))))
    return each.select(
        "doc_id", "item_id", F.size(mine).cast("long").alias("n_overlaps"), longest["n"].alias("n_tokens"), longest["e"].alias("n_equal"),
        (-longest["p"]).alias("doc_at"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents without an overlap, unchanged."""
    return _marked(docs, benchmark, docs.columns).filter(F.size("overlaps") == 0).select("__row.*")

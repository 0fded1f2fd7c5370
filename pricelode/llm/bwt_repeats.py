"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of ``LENGTH`` (400) bytes covers it that also starts anywhere else, in the same text or another.
Strings are judged on the input; they never cross texts.

1. Anchors.  Every 400-byte string is assigned the position of the least hash among the first ``WINDOW`` positions in it, so
   equal strings have equal anchors at equal offsets.  A string with offset o consists of o bytes left of its anchor, the
   ``CORE`` bytes from the anchor on, which all strings of the anchor share, and ``WINDOW - 1 - o`` bytes behind the core.  Only anchors whose core
   occurs twice can have repeated strings; equal cores with equal surroundings repeat wholly.
2. Merge.  The remaining surroundings are suffixes (behind the core, and reversed before it) of one collection per core.  They
   are dealt into shards; each shard keeps, for every depth, the symbols of its suffixes in its own sorted order: the columns
   of its transform.  The merge holds one interleave vector (which shard the next suffix comes from) and refines it
   depth by depth: symbols are drawn from the shards' columns in interleave order and stably sorted within blocks of equal prefix.
   Suffixes themselves are never compared again.  The depth at which a block splits is the common prefix of its parts; blocks are the
   intervals of repeated prefixes.  A string of offset o repeats if its anchor shares the left block of depth o and the right block of depth
   WINDOW - 1 - o with another.
3. Hot cores.  The surroundings of a core that stands more than ``HOT`` times are not gathered: every string of theirs is
   counted by (core, offset, hash), summed before the shuffle, and a string that stands once names its surroundings.
4. Covered ranges go back to their texts, which are cut in place.

Tasks hold one slice of text, or the surroundings of some cores, at most ``HOT`` of each; repeated surroundings are counted
before they are shuffled, so copies collapse.  Null
texts are empty; texts under 400 bytes are kept; repeated rows remove each other; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.bayes_jaccard import whole_groups
from pricelode.llm.common import materialize, rowwise, slices, texts
from pricelode.llm.word_hash import BASE, INVERSE, mix, powers

LENGTH, WINDOW, GRAM = 400, 128, 16
CORE = LENGTH - WINDOW + 1
SIDE = WINDOW - 1
SHARDS = 4
SLICE = 1 << 20
PLACE_BITS = 24
HOT = 4000
OUTSIDE = 256  # symbol beyond the end of a text


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(data: bytes) -> dict[str, np.ndarray]:
    """Anchors of one text: place, least and greatest offset of its strings, hashes of the core and of all that its strings cover."""
    none = {k: np.zeros(0, np.int64) for k in ("place", "near", "far", "core", "around")}
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        end = min(len(data), at + SLICE + LENGTH - 1)
        parts.append(_anchors(data, at, end))
    if not parts:
        return none
    found = {k: np.concatenate([p[k] for p in parts]) for k in none}
    new = np.flatnonzero(np.diff(found["place"], prepend=-1))  # slices next to each other can share an anchor; places ascend
    ends = {"near": np.minimum.reduceat(found["near"], new), "far": np.maximum.reduceat(found["far"], new)}
    return {k: ends[k] if k in ends else found[k][new] for k in none}


def _anchors(data: bytes, start: int, end: int) -> dict[str, np.ndarray]:
    """Anchors of the strings that start in ``data[start : end - LENGTH + 1]``."""
    low, high = max(0, start - SIDE), min(len(data), end + LENGTH)
    buffer = np.frombuffer(data, np.uint8)[low:high]
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buffer)), out=total[1:])
    back = powers(INVERSE, len(buffer) + 1)
    first, last = start - low, end - low - LENGTH  # strings start here
    grams = np.arange(first, last + WINDOW)
    hashes = mix((total[grams + GRAM] - total[grams]) * back[grams])
    keep = np.uint64((1 << PLACE_BITS) - 1)
    value = (hashes & ~keep) | (keep - (grams - first).astype(np.uint64))  # the last of equal ones
    chosen = (keep - (sliding_least(value, WINDOW) & keep)).astype(np.int64) + first
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    place, starts = chosen[new], new + first
    ends = np.append(new[1:], len(chosen)) - 1 + first
    left, right = np.maximum(place - SIDE, 0), np.minimum(place + LENGTH, len(buffer))
    core = mix((total[place + CORE] - total[place]) * back[place])
    around = mix(mix((total[right] - total[left]) * back[left]) ^ ((place - left) * 1000 + right - place).astype(np.uint64))
    return {"place": place + low, "near": place - ends, "far": place - starts, "core": core.view(np.int64), "around": around.view(np.int64)}


def shard_columns(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes (rows of symbols, by ascending group): the symbols of every depth in sorted order, and the rows in that order."""
    n, depth = symbols.shape
    columns, orders = np.empty((depth, n), np.int64), np.empty((depth + 1, n), np.int64)
    order, block = np.arange(n), group
    orders[0] = order
    for d in range(depth):
        columns[d] = symbols[order, d]
        key = block * (OUTSIDE + 1) + columns[d]
        turn = np.argsort(key, kind="stable")
        order, block = order[turn], _blocks(key[turn])
        orders[d + 1] = order
    return columns, orders


def _blocks(key: np.ndarray) -> np.ndarray:
    return np.cumsum(np.diff(key, prepend=key[:1]) != 0)


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]], groups: list[np.ndarray], depth: int) -> np.ndarray:
    """Block of every suffix at depths 0 to ``depth``: (depth + 1, all rows), rows numbered shard after shard."""
    base = np.cumsum([0, *(len(g) for g in groups)])
    joined = np.concatenate(groups)
    turn = np.argsort(joined, kind="stable")
    interleave = np.repeat(np.arange(len(groups)), np.diff(base))[turn]
    block = _blocks(joined[turn])
    out = np.empty((depth + 1, base[-1]), np.int64)
    symbol, row = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
    for d in range(depth + 1):
        if d:
            for s, (columns, _) in enumerate(shards):
                symbol[interleave == s] = columns[d - 1]
            key = block * (OUTSIDE + 1) + symbol
            turn = np.argsort(key, kind="stable")
            interleave, block = interleave[turn], _blocks(key[turn])
        for s, (_, orders) in enumerate(shards):
            row[interleave == s] = orders[d] + base[s]
        out[d, row] = block
    return out


def repeated_offsets(core: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """(rows, WINDOW): whether the string of an offset has an equal one in another row of the same core; rows are in core order."""
    group = _blocks(core)
    shard = np.arange(len(core)) % SHARDS
    rows = [np.flatnonzero(shard == s) for s in range(SHARDS)]
    blocks = []
    for symbols in (left, right):
        parts = [shard_columns(symbols[r], group[r]) for r in rows]
        blocks.append(merge_shards(parts, [group[r] for r in rows], SIDE))
    order = np.concatenate(rows)
    out = np.zeros((len(core), WINDOW), bool)
    for o in range(WINDOW):
        key = blocks[0][o] * len(core) + blocks[1][SIDE - o]
        turn = np.argsort(key, kind="stable")
        same = np.diff(key[turn]) == 0
        twice = np.zeros(len(core), bool)
        twice[turn[1:][same]] = True
        twice[turn[:-1][same]] = True
        out[order, o] = twice & (near[order] <= o) & (o <= far[order])
    return out


def surroundings(data: bytes, places: list[int]) -> tuple[list[bytes], list[bytes]]:
    """Bytes before each anchor, reversed, and behind its core."""
    left = [data[max(0, p - SIDE) : p][::-1] for p in places]
    return left, [data[p + CORE : p + CORE + SIDE] for p in places]


def _symbols(parts: list[bytes]) -> np.ndarray:
    out = np.full((len(parts), SIDE), OUTSIDE, np.int64)
    sizes = np.array([len(p) for p in parts])
    out[np.arange(SIDE) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return out


def offset_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(rows, WINDOW): hash of what the string of each offset has around its core."""
    zero = np.zeros((len(left), 1), np.uint64)
    weights = powers(BASE, SIDE)
    ahead, behind = (np.hstack([zero, np.cumsum((x.astype(np.uint64) + np.uint64(1)) * weights, axis=1)]) for x in (left, right))
    return mix(mix(ahead) ^ (behind[:, ::-1] * INVERSE))


def offset_rows(batches):
    """Rows (core, around, n, near, far, left, right) to one row (core, around, offset, string) for each string."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            core, around, near, far = (part.column(k).to_numpy() for k in ("core", "around", "near", "far"))
            strings = offset_hashes(_symbols(part.column("left").to_pylist()), _symbols(part.column("right").to_pylist()))
            offsets = np.arange(WINDOW, dtype=np.int32)
            row, offset = np.nonzero((near[:, None] <= offsets) & (offsets <= far[:, None]))
            arrays = [core[row], around[row], offset.astype(np.int32), strings[row, offset].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["core", "around", "offset", "string"])


def _ranges(core: np.ndarray, around: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """(core, around, low, high): ranges covered by the found offsets, from the anchor."""
    kinds = pa.schema([("core", pa.int64()), ("around", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])
    edges = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    low, high = [], []
    for row in range(len(core)):
        a, b = np.flatnonzero(edges[row] == 1), np.flatnonzero(edges[row] == -1) - 1
        low.append((-b).tolist())
        high.append((LENGTH - a).tolist())
    return pa.RecordBatch.from_arrays([pa.array(core), pa.array(around), pa.array(low, kinds.field(2).type), pa.array(high, kinds.field(3).type)], schema=kinds)


def merge_groups(batches):
    """Rows (core, around, n, near, far, left, right), sorted by core, to (core, around, low, high): covered ranges from the anchor."""
    for table in whole_groups(batches, 1, 8000):
        core, around, n, near, far = (table.column(k).to_numpy() for k in ("core", "around", "n", "near", "far"))
        found = repeated_offsets(core, _symbols(table.column("left").to_pylist()), _symbols(table.column("right").to_pylist()), near, far)
        offsets = np.arange(WINDOW)
        found |= (n > 1)[:, None] & (near[:, None] <= offsets) & (offsets <= far[:, None])
        yield _ranges(core, around, found)


def without_single(batches):
    """Rows (core, around, n, near, far, single) to (core, around, low, high): all offsets but the ``single`` ones, or all if n > 1."""
    for batch in batches:
        core, around, n, near, far = (batch.column(k).to_numpy() for k in range(5))
        offsets = np.arange(WINDOW)
        found = (near[:, None] <= offsets) & (offsets <= far[:, None])
        for row, single in enumerate(batch.column(5).to_pylist()):
            if single and n[row] == 1:
                found[row, single] = False
        yield _ranges(core, around, found)


def cut(data: bytes, low: list[int], high: list[int]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the runs removed."""
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, np.array(low, np.int64), 1)
    np.add.at(step, np.array(high, np.int64), -1)
    removed = np.cumsum(step[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
    return kept, int(removed.sum()), int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())


def covered_ranges(rows: DataFrame) -> DataFrame:
    """(k1, k2, low, high): ranges of repeated strings of every text of ``rows`` (k1, k2, text) that has any."""
    kinds = [("place", T.IntegerType()), ("near", T.IntegerType()), ("far", T.IntegerType()), ("core", T.LongType()), ("around", T.LongType())]
    out = T.StructType([T.StructField(k, T.ArrayType(t)) for k, t in kinds])

    def work(data):
        found = [find_anchors(x) for x in data]
        edges = pa.array(np.cumsum([0, *(len(x["place"]) for x in found)]).astype(np.int32))
        kind = {T.IntegerType: np.int32, T.LongType: np.int64}
        return {k: pa.ListArray.from_arrays(edges, pa.array(np.concatenate([x[k] for x in found]).astype(kind[type(t)]))) for k, t in kinds}

    by_text = materialize(rowwise(rows.filter(F.octet_length("text") >= LENGTH), "text", out, work, ["k1", "k2"]), "repeat-anchors")
    anchors = by_text.select("k1", "k2", F.explode(F.arrays_zip(*[k for k, _ in kinds])).alias("a")).select("k1", "k2", "a.*")
    often = anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).filter("n > 1")
    differ = F.col("a") != F.col("b")
    often = materialize(often.select("core", differ.alias("differ"), (differ & (F.col("n") > HOT)).alias("hot")), "repeat-cores")  # so that a hot core can be split in the join
    shared = materialize(anchors.join(often, "core"), "repeat-shared")
    distinct = shared.groupBy("core", "around", "differ", "hot").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place", "near", "far")).alias("rep"))
    distinct = materialize(distinct.select("core", "around", "differ", "hot", "n", "rep.*"), "repeat-distinct")
    wanted = distinct.filter("differ").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "core", "around", "hot", "n", "near", "far")).alias("wanted"))
    columns = "core long, around long, hot boolean, n long, near int, far int, left binary, right binary"

    def fetch(batches):
        for batch in batches:
            data = texts(batch.column(0))
            for a, b in slices([len(x) for x in data], SLICE):
                wanted_rows = batch.column(1).slice(a, b - a).to_pylist()
                left, right, rest = [], [], []
                for x, picked in zip(data[a:b], wanted_rows):
                    more = surroundings(x, [p["place"] for p in picked])
                    left += more[0]
                    right += more[1]
                    rest += picked
                if rest:
                    cols = [[p[k] for p in rest] for k in ("core", "around", "hot", "n", "near", "far")]
                    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
                    arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["core", "around", "hot", "n", "near", "far", "left", "right"])

    taken = rows.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(fetch, columns).dropDuplicates(["core", "around"])
    taken = materialize(taken, "repeat-taken")
    covered = "core long, around long, low array<int>, high array<int>"
    merged = taken.filter("not hot").repartition("core").sortWithinPartitions("core").mapInArrow(merge_groups, covered)
    merged = materialize(merged.filter(F.size("low") > 0), "repeat-merged")
    strings = taken.filter("hot").mapInArrow(offset_rows, "core long, around long, offset int, string long")
    single = strings.groupBy("core", "offset", "string").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("around")).filter("n = 1")
    single = single.groupBy("core", "around").agg(F.collect_list("offset").alias("single"))
    hot = distinct.filter("hot").select("core", "around", "n", "near", "far").join(single, ["core", "around"], "left")
    hot = materialize(hot.mapInArrow(without_single, covered).filter(F.size("low") > 0), "repeat-hot")
    whole = distinct.filter("not differ").select(
        "core", "around", F.array((-F.col("far")).cast("int")).alias("low"), F.array((LENGTH - F.col("near")).cast("int")).alias("high")
    )
    ranges = shared.join(merged.union(hot).union(whole), ["core", "around"]).select("k1", "k2", "place", F.explode(F.arrays_zip("low", "high")).alias("r"))
    ranges = ranges.select("k1", "k2", (F.col("place") + F.col("r.low")).alias("low"), (F.col("place") + F.col("r.high")).alias("high")).distinct()
    pair = F.collect_list(F.struct("low", "high"))
    return materialize(ranges.groupBy("k1", "k2").agg(pair.alias("ranges")), "repeat-ranges")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: (id, kept, n_bytes, n_removed, n_spans); kept holds the remaining bytes."""
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "text", "id")})
    marked = rows.join(covered_ranges(rows), ["k1", "k2"], "left").select("id", "ranges", "text")
    out = T.StructType([T.StructField("id", df.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            data = texts(batch.column(2))
            for a, b in slices([len(x) for x in data], SLICE):
                ranges = batch.column(1).slice(a, b - a).to_pylist()
                made = [cut(x, [p["low"] for p in r], [p["high"] for p in r]) if r else (x, 0, 0) for x, r in zip(data[a:b], ranges)]
                sizes, removed, spans = [len(x) for x in data[a:b]], [m[1] for m in made], [m[2] for m in made]
                arrays = [batch.column(0).slice(a, b - a), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)], pa.array([m[0] for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, out)


def repeats_query(documents: DataFrame) -> DataFrame:
    cut_rows = remove_repeats(documents)
    # Cuts fall between bytes: in ``text`` the rest of a cut character is a replacement sign.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut_rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def brute_force(data: list[bytes], length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """The same by a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for x in data:
        for p in range(len(x) - length + 1):
            key = hashlib.blake2b(x[p : p + length], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for x in data:
        low = [p for p in range(len(x) - length + 1) if seen[hashlib.blake2b(x[p : p + length], digest_size=16).digest()] > 1]
        out.append(cut(x, low, [p + length for p in low]) if low else (x, 0, 0))
    return out

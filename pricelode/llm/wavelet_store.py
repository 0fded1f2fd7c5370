"""Token ids in wavelet-matrix files.

A shard holds consecutive documents in one compressed file: a header, the document ids and starts, and one bit-plane per id
bit.  In a wavelet matrix every plane is stably sorted by the bit of the plane before it, so rank on the planes gives any token
(``access``), the number of a token in a prefix (``rank``) and the place of its k-th occurrence (``select``) without unpacking.

On Spark, documents are dealt by ranges of their id and sorted in a partition; the task that tokenises them builds the shard
files, as rows (part, seq, payload) of a table in the shared folder.  A shard ends when it has ``SHARD_TOKENS`` tokens, so a task
holds one shard and one batch of texts.  Starts over all documents are shard totals summed by part, then over parts.

Null and empty texts have the end token only; equal ids are ordered by a hash of the text; null ids come first; further columns
are not read.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import materialize, slices, texts
from pricelode.llm.latin_words import HashedWords, strange
from pricelode.llm.word_codes import WordCodes

MAGIC = b"WMX1"
SHARD_TOKENS = 2_000_000
SLICE = 1 << 20
END = 0
SAMPLE = 512  # bits between rank samples


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        """``planes``: packed bits (little end first), the highest bit's plane first; ``zeros``: zero bits of each."""
        self.n, self.zeros, self.planes = n, zeros, planes
        self._samples: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = now[~one]
            zeros.append(len(low))
            now = np.concatenate([low, now[one]])
        return cls(len(ids), zeros, planes)

    def all(self) -> np.ndarray:
        """Every token, from the planes alone: each plane, from the last to the first, undoes its sort."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (z, plane) in enumerate(zip(self.zeros[::-1], self.planes[::-1])):
            one = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[~one] = now[:z]
            before[one] = now[z:] | now.dtype.type(1 << b)
            now = before
        return now

    def access(self, i: int) -> int:
        token = 0
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, i)
            token = token << 1 | bit
            ones = self._ones(level, i)
            i = z + ones if bit else i - ones
        return token

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs before position ``end``."""
        a, b = self._interval(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        a, b = self._interval(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            z = self.zeros[level]
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            i = self._find(level, i - z if one else i, one)
        return i

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        a, b = 0, end
        for level, z in enumerate(self.zeros):
            low, high = self._ones(level, a), self._ones(level, b)
            one = token >> (len(self.planes) - 1 - level) & 1
            a, b = (z + low, z + high) if one else (a - low, b - high)
        return a, b

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """One bits before ``i``."""
        block = i // SAMPLE
        rest = np.unpackbits(self.planes[level][block * SAMPLE // 8 : (i + 7) // 8], bitorder="little")
        return int(self._rank_samples()[level][block]) + int(rest[: i - block * SAMPLE].sum())

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th one (or zero) bit of a plane."""
        samples = self._rank_samples()[level]
        before = samples if one else np.arange(len(samples)) * SAMPLE - samples
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * SAMPLE // 8 : (block + 1) * SAMPLE // 8], bitorder="little")
        return block * SAMPLE + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def _rank_samples(self) -> list[np.ndarray]:
        if self._samples is None:
            self._samples = []
            for plane in self.planes:
                padded = np.concatenate([plane, np.zeros(-len(plane) % (SAMPLE // 8), np.uint8)])
                ones = np.unpackbits(padded).reshape(-1, SAMPLE).sum(1)
                self._samples.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._samples

    def to_bytes(self) -> bytes:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        out = [struct.pack("<QB", self.n, len(self.planes))]
        for z, plane in zip(self.zeros, self.planes):
            packed = packer.compress(plane.tobytes())
            out += [struct.pack("<QQ", z, len(packed)), packed]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        n, bits = struct.unpack_from("<QB", data)
        at, zeros, planes = 9, [], []
        for _ in range(bits):
            z, size = struct.unpack_from("<QQ", data, at)
            at += 16
            planes.append(np.frombuffer(unpacker.decompress(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8))
            zeros.append(z)
            at += size
        return cls(n, zeros, planes)


def write_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file: documents with their sizes, and the matrix of all their tokens."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], np.int64)
    head = MAGIC + struct.pack("<Q", len(doc_ids))
    return head + known.tobytes() + numbers.tobytes() + sizes.astype("<i8").tobytes() + WaveletMatrix.build(ids).to_bytes()


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    (n,) = struct.unpack_from("<Q", data, 4)
    known = np.frombuffer(data, np.uint8, n, 12)
    numbers = np.frombuffer(data, "<i8", n, 12 + n)
    sizes = np.frombuffer(data, "<i8", n, 12 + 9 * n)
    docs = [int(x) if k else None for x, k in zip(numbers, known)]
    return docs, sizes, WaveletMatrix.from_bytes(memoryview(data)[12 + 17 * n :])


#: A space and letters, which the tokenizer keeps together and cuts off before the next space.
SPACED_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
KEPT_WORDS = 1_500_000


class Encoder:
    """Ids by the tokenizers library.  Its splitter cuts texts into words that are encoded on their own, so each distinct word is
    encoded once; a text with a special token's string goes to the library whole.

    Words of a space and letters are given to the library in runs, which it cuts at the spaces again; the ids whose token begins
    with a space tell where each word starts.
    """

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_any = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.latin, self.words = HashedWords(self._encode, KEPT_WORDS), WordCodes(self._encode)

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One encoder per Python worker, so that words met in earlier tasks are known; tasks give equal ids with or without it."""
        held = sys.modules.setdefault("_pricelode_held", types.ModuleType("_pricelode_held")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([SPACED_WORD(w) is not None for w in words], bool)
        runs = [w for w, p in zip(words, plain) if p]
        runs = ["".join(runs[i : i + 2000]) for i in range(0, len(runs), 2000)]
        rest = [w for w, p in zip(words, plain) if not p]
        found = self.tokenizer.encode_batch_fast(runs + rest, add_special_tokens=False)
        flat = [np.array(e.ids, np.uint32) for e in found]
        joined = np.concatenate(flat[: len(runs)]) if runs else np.zeros(0, np.uint32)
        starts = np.flatnonzero(self.opens[joined])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(np.append(starts, len(joined)))
        sizes[~plain] = [len(x) for x in flat[len(runs) :]]
        first = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for chosen, ids in ((plain, joined), (~plain, np.concatenate([np.zeros(0, np.uint32), *flat[len(runs) :]]))):
            own = sizes[chosen]
            out[np.repeat(first[chosen] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, sizes

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end token behind every text, and the number of ids of each."""
        special = [any(x in t for x in self.special) for t in data]
        latin = [not p and not strange(t) for t, p in zip(data, special)]
        found = self.latin.codes([t for t, a in zip(data, latin) if a]) if any(latin) else None
        if found is None:  # no such text, or words that array hashes cannot tell apart
            latin = [False] * len(data)
        general = [not p and not a for p, a in zip(special, latin)]
        parts = [iter(_split(*found)) if found else iter(())]
        parts.append(iter(_split(*self.words.codes([self.split_any(t.decode("utf-8", "replace")) for t, g in zip(data, general) if g]))) if any(general) else iter(()))
        if all(latin):
            ids, sizes = found
            return np.insert(ids, np.cumsum(sizes), END), sizes + 1
        out = []
        for t, a, g in zip(data, latin, general):
            ids = next(parts[0]) if a else next(parts[1]) if g else self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
            out.append(np.append(np.array(ids, np.uint32), np.uint32(END)))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _split(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


def write_store(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shard files of all documents in ascending id order: (part, seq, n_docs, n_tokens, payload), written to the shared folder."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, Encoder.of_process(tokenizer)
        ids, sizes, codes, held = [], [], [], 0

        def shard():
            row = [[part], [seq], [len(ids)], [held], [write_shard(ids, np.concatenate(sizes), np.concatenate(codes))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64()), pa.array(row[4], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "payload"],
            )

        for batch in batches:
            data = texts(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in slices([len(x) for x in data], SLICE):
                code, size = encoder.encode(data[a:b])
                ids += names[a:b]
                sizes.append(size)
                codes.append(code)
                held += len(code)
                if held >= shard_tokens:
                    yield shard()
                    ids, sizes, codes, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    return materialize(dealt.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, payload binary"), "wavelet")


def read_store(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shard files."""

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, sizes, matrix = read_shard(data)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(sizes.tolist(), ends.tolist())]
                cols = [[part] * len(docs), [seq] * len(docs), docs, ends - sizes, sizes, crc]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                )

    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    by_part = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    offsets = store.select("part", "seq", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("shard_start")).join(by_part, "part")
    found = store.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def store_query(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return read_store(write_store(documents, public_tokenizers.path("byte_bpe_50k.json")))

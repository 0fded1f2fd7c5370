"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is normalised as the model file says (a leading space, spaces as U+2581) and cut into words in front of every run of
U+2581, which no piece crosses.  Each distinct word of a task is encoded once.  Words of equal length advance together: at each
end position the hashes of all substrings that end there probe the sorted piece keys, the best score is a vectorised maximum over
the possible lengths (the longest piece wins a tie), and the winner's length is the backpointer.  A character without a piece
becomes its UTF-8 bytes (byte fallback).

Scores follow the model type, and the ids are the library's:

- unigram: the sum of piece scores; a character without a piece costs the model's unknown score.
- BPE: a path scores 0 if it is what merging yields, else minus infinity.  Merging yields a sequence of pieces exactly if each
  piece is reached by merges and no two neighbours would merge across their border; so the search keeps, for each prefix, the one
  last piece that goes with its predecessor.  Whether two pieces do is found by replaying their merges side by side, for many
  pairs at once, and is remembered in a table of fixed size.

Null and empty texts have no ids.  Decoding gives back the text exactly; only U+2581 itself comes back as a space.  Further
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import rowwise
from pricelode.llm.word_codes import WordCodes
from pricelode.llm.word_hash import BASE, INVERSE, mix, powers

SPACE = "▁"
UNKNOWN = 1 << 30  # codes from here on are characters without a piece
SLICE = 4 << 20
CELLS = 21  # bits of the pair table's size
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    """Arrays of a model file, by ascending piece hash; they are what tasks get."""

    kind: int
    keys: np.ndarray
    raw: np.ndarray  # hashes before mixing, which can be joined
    sizes: np.ndarray  # characters of a piece
    ids: np.ndarray
    scores: np.ndarray
    unknown_score: float
    byte_ids: np.ndarray
    spelling: list[bytes]  # of every id
    splitter: str
    reached: np.ndarray | None = None  # BPE: merging the piece's characters gives the piece
    merge_rank: np.ndarray | None = None  # BPE: rank of the next merge inside a piece after 0, 1, ... merges
    first: np.ndarray | None = None  # BPE: first and last symbol of a piece after 0, 1, ... merges
    last: np.ndarray | None = None
    _cells: list = field(default_factory=list)

    @classmethod
    def load(cls, path: str, kind: int | None = None) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only texts as they are, with a leading space, are supported")
        spelling, normal, byte_ids = [], [], np.full(256, proto.trainer_spec.unk_id, np.uint32)
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                spelling.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                spelling.append(p.piece.encode())
                normal.append(i)
            else:
                spelling.append(b"")
        pieces = [proto.pieces[i].piece for i in normal]
        inner = {c for p in pieces if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or not inner <= set(pieces):
            raise ValueError("pieces across words, or of characters that are no piece, are not supported")
        raw = np.array([raw_hash(p) for p in pieces], np.uint64)
        keys = mix(raw)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        order = np.argsort(keys)
        scores = np.array([proto.pieces[i].score for i in normal])[order]
        lone = "" if "\n" in inner else "\n"
        splitter = (f"{lone}|" if lone else "") + f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+"
        model = cls(
            kind or proto.trainer_spec.model_type, keys[order], raw[order], np.array([len(p) for p in pieces])[order],
            np.array(normal, np.uint32)[order], scores, float(scores.min()) - 10, byte_ids, spelling, splitter,
        )
        if model.kind == BPE:
            model._merges([pieces[i] for i in order])
        elif model.kind != UNIGRAM:
            raise ValueError("the model must be of type unigram or BPE")
        return model

    def _merges(self, pieces: list[str]) -> None:
        """How merging builds each piece from its characters."""
        rank = dict(zip(pieces, -self.scores))
        number = {p: i for i, p in enumerate(pieces)}
        longest = int(self.sizes.max())
        self.merge_rank = np.full((len(pieces), longest), np.inf, np.float32)
        self.first = np.zeros((len(pieces), longest), np.int32)
        self.last = np.zeros((len(pieces), longest), np.int32)
        self.reached = np.zeros(len(pieces), bool)
        for i, piece in enumerate(pieces):
            symbols, n = list(piece), 0
            while True:
                self.first[i, n], self.last[i, n] = number[symbols[0]], number[symbols[-1]]
                possible = [(rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
                if not possible:
                    break
                self.merge_rank[i, n], k = min(possible)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                n += 1
            self.reached[i] = len(symbols) == 1

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces ``a`` and ``b`` next to each other; replays the merges of both, leftmost first on ties."""
        x, y = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        good, rows, step = np.ones(len(a), bool), np.arange(len(a)), powers(BASE, int(self.sizes.max()) + 1)
        while len(rows):
            left, right = self.merge_rank[a[rows], x[rows]], self.merge_rank[b[rows], y[rows]]
            l, r = self.last[a[rows], x[rows]], self.first[b[rows], y[rows]]
            joined = mix(self.raw[l] + self.raw[r] * step[self.sizes[l]])
            at = np.minimum(np.searchsorted(self.keys, joined), len(self.keys) - 1)
            across = np.where(self.keys[at] == joined, -self.scores[at], np.inf).astype(np.float32)
            on_left = (left <= across) & (left <= right) & (left < np.inf)
            crossed = ~on_left & (across <= right) & (across < np.inf)
            on_right = ~on_left & ~crossed & (right < np.inf)
            good[rows[crossed]] = False
            x[rows[on_left]] += 1
            y[rows[on_right]] += 1
            rows = rows[on_left | on_right]
        return good

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self._cells:
            self._cells += [np.full(1 << CELLS, -1, np.int64), np.zeros(1 << CELLS, bool)]
        known, value = self._cells
        pair = a.astype(np.int64) * len(self.keys) + b
        cell = (mix(pair.astype(np.uint64)) >> np.uint64(64 - CELLS)).astype(np.int64)
        out, miss = value[cell], np.flatnonzero(known[cell] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            good = self.neighbours(new // len(self.keys), new % len(self.keys))
            out[miss] = good[back]
            known[cell[miss]], value[cell[miss]] = -1, False
            slots = (mix(new.astype(np.uint64)) >> np.uint64(64 - CELLS)).astype(np.int64)
            one = np.unique(slots, return_index=True)[1]
            known[slots[one]], value[slots[one]] = new[one], good[one]
        return out

    def words(self, text: str) -> list[str]:
        return re.findall(self.splitter, SPACE + text.replace(" ", SPACE)) if text else []

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and the number of ids of each."""
        lengths = np.array([len(w) for w in words])
        found, sizes = [None] * len(words), np.zeros(len(words), np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for part in np.array_split(rows, -(-len(rows) * int(n) // 400_000) or 1):
                points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)
                flat, counts = self._expand(*self.viterbi(points.astype(np.uint64)))
                for i, piece in zip(part, np.split(flat, np.cumsum(counts)[:-1])):
                    found[i] = piece
                sizes[part] = counts
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), sizes

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of equally long words (rows of code points), and their number by word."""
        n, length = points.shape
        total = np.zeros((length + 1, n), np.uint64)
        np.cumsum((points.T + np.uint64(1)) * powers(BASE, length)[:, None], axis=0, out=total[1:])
        back, longest, rows = powers(INVERSE, length), int(self.sizes.max()), np.arange(n)
        best, last = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -1, np.int32)
        best[0] = 0
        size, code = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.uint32)
        for end in range(1, length + 1):
            spans = np.arange(min(longest, end), 0, -1)
            starts = end - spans
            hashes = mix((total[end] - total[starts]) * back[starts][:, None])
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            lone = ~known[-1]
            if self.kind == UNIGRAM:
                score = np.where(known, self.scores[at], -np.inf)
            else:
                known &= self.reached[at]
                i, j = np.nonzero(known & (last[starts] >= 0))
                known[i, j] = self._neighbours(last[starts[i], j], at[i, j])
                score = np.where(known, 0.0, -np.inf)
            codes = self.ids[at]
            score[-1, lone] = self.unknown_score
            codes[-1, lone] = UNKNOWN + points[lone, end - 1]
            score += best[starts]
            pick = np.argmax(score, axis=0)
            best[end], code[end], size[end] = score[pick, rows], codes[pick, rows], spans[pick]
            last[end] = np.where(code[end] >= UNKNOWN, -1, at[pick, rows])
        steps, at = [], np.full(n, length)
        while at.any():
            steps.append(np.where(at > 0, code[at, rows].astype(np.int64), -1))
            at = at - size[at, rows]
        path = np.stack(steps[::-1], axis=1)
        return path[path >= 0].astype(np.uint32), (path >= 0).sum(1)

    def _expand(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes for the characters without a piece."""
        strange = codes >= UNKNOWN
        if not strange.any():
            return codes, counts
        spelled = {int(c): self.byte_ids[np.frombuffer(chr(int(c) - UNKNOWN).encode("utf-8", "replace"), np.uint8)] for c in np.unique(codes[strange])}
        sizes = np.array([len(spelled[c]) if c >= UNKNOWN else 1 for c in codes.tolist()])
        flat = np.concatenate([spelled[c] if c >= UNKNOWN else [c] for c in codes.tolist()]).astype(np.uint32)
        edges = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[edges])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def raw_hash(text: str) -> np.uint64:
    """The hash that ``viterbi`` takes from prefix sums, before mixing."""
    points = np.array([ord(c) for c in text], np.uint64) + np.uint64(1)
    return (points * powers(BASE, len(points))).sum(dtype=np.uint64)


def encode(df: DataFrame, keep: list[str], model: PieceModel, text: str = "text") -> DataFrame:
    """``keep`` columns plus ``ids``."""
    state: dict = {}  # filled in the task

    def work(data):
        if not state:
            state["words"] = WordCodes(model.encode_words)
        ids, sizes = state["words"].codes([model.words(x.decode("utf-8", "replace")) for x in data])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))}

    return rowwise(df, text, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), work, keep, SLICE)


def decode(df: DataFrame, keep: list[str], model: PieceModel, ids: str = "ids") -> DataFrame:
    """``keep`` columns plus ``decoded``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            values, edges = column.values.to_numpy(), column.offsets.to_numpy()
            out = [model.decode(values[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`")).mapInArrow(run, schema)


def default_model() -> PieceModel:
    import public_tokenizers

    return PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))


def codec_query(documents: DataFrame) -> DataFrame:
    """Ids of every text, decoded again: counts, a hash of the ids, a digest of the decoded text, and whether it is the text."""
    model = default_model()
    named = documents.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("__row"), "text")
    coded = encode(named, ["__row"], model).withColumn("__row", F.struct("__row.*", F.size("ids").alias("n"), F.hash("ids").alias("h")))
    back = decode(coded, ["__row"], model)
    decoded = F.sha2("decoded", 256)
    return back.select(
        F.col("__row.doc_id").alias("doc_id"), F.col("__row.n").cast("long").alias("n_tokens"), F.col("__row.h").alias("ids_hash"),
        decoded.alias("decoded_sha256"), (decoded == F.col("__row.sha")).alias("round_trip"),
    )


def encode_corpus(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents as ids."""
    return encode(docs, ["doc_id", "lang", "source"], default_model()).withColumn("n_tokens", F.size("ids").cast("long"))

"""Vectorised word hashes: all words of a slice of texts at once, alike in every process."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_LETTER = np.array([chr(b).isalnum() if b < 128 else b != 0xFF for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """``hashes`` of all words; those of text i are ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def fold(data: bytes) -> bytes:
    """Lower case; ASCII texts take the short way."""
    return data.lower() if data.isascii() else data.decode("utf-8", "replace").lower().encode("utf-8")


def hash_words(data: list[bytes]) -> Words:
    """Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case."""
    folded = [fold(x) for x in data]
    buffer = np.frombuffer(b"\xff".join(folded) + b"\xff", np.uint8)
    letter = _LETTER[buffer]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buffer)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(INVERSE, len(buffer))[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(x) + 1 for x in folded])
    return Words(hashes, np.concatenate([[0], np.searchsorted(starts, text_ends)]))


def windows(words: Words, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``offsets`` behind every start that keeps inside its text, and those starts."""
    span = offsets[-1] + 1
    n = len(words.hashes)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(words.first)
    usable = np.maximum(lengths - span + 1, 0)
    has = usable > 0
    np.add.at(inside, words.first[:-1][has], 1)
    np.add.at(inside, (words.first[:-1] + usable)[has], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    total = np.zeros(n - span + 1, np.uint64)
    for o, m in zip(offsets, powers(BASE, len(offsets) + 1)[1:]):
        total += words.hashes[o : n - span + 1 + o] * m
    return mix(total[starts]), starts

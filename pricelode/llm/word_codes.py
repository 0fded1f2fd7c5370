"""Codes of words, kept for the words that a task meets again."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words that are kept before the table starts afresh: a bound on memory, not on results.
KEPT_WORDS = 250_000


class Numbering(dict):
    """Numbers words in order of first sight and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordCodes:
    """Turns lists of words into flat codes.  ``encode`` gives the codes of many distinct words: (flat codes, codes per word)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = KEPT_WORDS):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.number = Numbering()
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def codes(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All codes in order, and the number of codes of every text."""
        if len(self.number) > self.limit:
            self._clear()
        per_text = np.array([len(t) for t in texts], np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(per_text.sum()))
        if self.number.new:
            flat, sizes = self.encode(self.number.new)
            self.number.new = []
            self.flat, self.sizes = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.sizes, sizes])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        first = np.cumsum(self.sizes) - self.sizes
        out = self.flat[np.repeat(first[at] - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(edges)

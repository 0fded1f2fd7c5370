"""Words of Latin texts as a byte-level tokenizer cuts them, found and numbered by array operations.

For texts of ASCII and common Latin letters the cut ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|blanks`` follows from runs of
byte classes: a run of letters, digits or other signs takes one space before it; of the blanks before it the last one stands
alone unless it is that space; an apostrophe on its own takes a contraction's letters from the run behind it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pricelode.llm.word_hash import BASE, INVERSE, mix, powers

OTHER, LETTER, DIGIT, BLANK, BREAK = range(5)
#: Bytes of texts that this module cuts: no control characters, and of other characters U+00C0 to U+00FF but for two signs.
_PLAIN = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])


def strange(text: bytes) -> bool:
    """Whether a text needs the general way."""
    return bool(text.translate(None, _PLAIN)) or b"\xc3\x97" in text or b"\xc3\xb7" in text


_CLASS = np.array(
    [BLANK if b in b" \t\n\r" else DIGIT if chr(b) in "0123456789" and b < 128 else LETTER if b >= 0x80 and b != 0xFF or b < 128 and chr(b).isalpha()
     else BREAK if b == 0xFF else OTHER for b in range(256)], np.uint8
)
_OTHER_BASE = np.uint64(0xD1B54A32D192ED03 | 1)
_OTHER_INVERSE = np.uint64(pow(int(_OTHER_BASE), -1, 1 << 64))


def cut_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of a buffer of texts, each ended by 0xFF."""
    kind = _CLASS[buffer]
    start = np.flatnonzero(np.diff(kind, prepend=255))
    end = np.append(start[1:], len(buffer))
    kind = kind[start]
    blank = kind == BLANK
    after_space = np.zeros(len(start), bool)  # the run takes the space before it
    after_space[1:] = blank[:-1] & (buffer[start[1:] - 1] == 0x20)
    text = (kind != BLANK) & (kind != BREAK)
    word_start, word_end = start - after_space, end.copy()
    ticks = np.flatnonzero((kind == OTHER) & (end - start == 1) & (buffer[start] == 0x27) & ~after_space)
    ticks = ticks[ticks + 1 < len(kind)]
    ticks = ticks[kind[ticks + 1] == LETTER]
    if len(ticks):
        a, b = buffer[end[ticks]], buffer[np.minimum(end[ticks] + 1, len(buffer) - 1)]
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re, ve, ll
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s, t, m, d
        taken = np.where(one, 1, np.where(two, 2, 0))
        word_end[ticks] += taken
        word_start[ticks + 1] += taken
    starts, ends = [word_start[text]], [word_end[text]]
    follows = np.zeros(len(start), bool)
    follows[:-1] = kind[1:] != BREAK
    whole = blank & ~follows
    starts.append(start[whole])
    ends.append(end[whole])
    many = blank & follows & (end - start > 1)
    starts.append(start[many])
    ends.append(end[many] - 1)
    last = blank & follows & (buffer[end - 1] != 0x20)
    starts.append(end[last] - 1)
    ends.append(end[last])
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    real = ends > starts
    return starts[real], ends[real]


#: Powers of each base, kept for slices of up to ``KEPT_POWERS`` bytes; longer texts make their own.
KEPT_POWERS = 5 << 18
_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if n > KEPT_POWERS:
        return powers(base, n)
    if len(_kept.get(int(base), ())) < n:
        _kept[int(base)] = powers(base, (n + (1 << 17) - 1) >> 17 << 17)
    return _kept[int(base)][:n]


def _hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(base, len(buffer)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(inverse, len(buffer) + 1)[starts])


class HashedWords:
    """Codes of words by 128-bit hashes in an open-addressed table; ``encode`` gives the codes of new words: (flat codes, codes per word).

    With more than ``limit`` words the table starts afresh, which bounds memory and not results.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self._clear(max(16, limit * 4 // 3))

    def _clear(self, slots: int) -> None:
        capacity = 1 << (slots - 1).bit_length()
        self.key, self.check = np.zeros(capacity, np.uint64), np.zeros(capacity, np.uint64)
        self.first, self.sizes = np.zeros(capacity, np.int64), np.zeros(capacity, np.int32)  # size 0: a free slot
        self.known, self.flat = 0, np.zeros(0, np.uint32)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of every word, -1 where it is not known."""
        mask = np.uint64(len(self.key) - 1)
        at, out, left = (key & mask).astype(np.int64), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            here = at[left]
            used = self.sizes[here] > 0
            same = used & (self.key[here] == key[left]) & (self.check[here] == check[left])
            out[left[same]] = here[same]
            left = left[used & ~same]
            at[left] = (at[left] + 1) & int(mask)
        return out

    def _add(self, key: np.ndarray, check: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of words that are not in the table; all keys differ."""
        if (self.known + len(key)) * 4 > len(self.key) * 3:
            used, flat = np.flatnonzero(self.sizes), self.flat
            old = self.key[used], self.check[used], self.first[used], self.sizes[used]
            self._clear(2 * (self.known + len(key)) + len(self.key))
            self.flat = flat
            self._add(*old)
        mask = len(self.key) - 1
        at, left = (key & np.uint64(mask)).astype(np.int64), np.arange(len(key))
        while len(left):
            here = at[left]
            free = self.sizes[here] == 0
            self.key[here[free]] = key[left[free]]  # one of the words that claim a slot has it
            won = free & (self.key[here] == key[left])
            self.check[here[won]], self.first[here[won]], self.sizes[here[won]] = check[left[won]], first[left[won]], sizes[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & mask
        self.known += len(key)
        return at

    def codes(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """All codes in order and the number of codes of every text; None if two words share half a hash."""
        if self.known > self.limit:
            self._clear(max(16, self.limit * 4 // 3))
        joined = b"\xff".join(data) + b"\xff"
        buffer = np.frombuffer(joined, np.uint8)
        starts, ends = cut_words(buffer)
        key = _hash(buffer, starts, ends, BASE, INVERSE)
        check = _hash(buffer, starts, ends, _OTHER_BASE, _OTHER_INVERSE)
        slots = self._find(key, check)
        new = np.flatnonzero(slots < 0)
        if len(new):
            distinct, index, back = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[index]
            if not (check[one][back] == check[new]).all():
                return None
            words = [joined[a:b].decode("utf-8") for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            flat, sizes = self.encode(words)
            first = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            known = len(self.key)
            placed = self._add(distinct, check[one], first, sizes)
            if len(self.key) != known:  # a larger table: all slots are new
                slots = self._find(key, check)
            else:
                slots[new] = placed[back]
        sizes = self.sizes[slots].astype(np.int64)
        word_end = np.cumsum(sizes)
        total = int(word_end[-1]) if len(word_end) else 0
        out = self.flat[np.repeat(self.first[slots] - (word_end - sizes), sizes) + np.arange(total)]
        edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in data)]))
        return out, np.diff(np.concatenate([[0], word_end])[edges])

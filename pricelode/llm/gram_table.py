"""Distinct byte strings of a batch under open addressing in NumPy arrays.

A table holds one slot for each distinct range of a buffer.  The home of a range is its xxhash64; ranges that meet in a slot
are told apart by their hash and then by their bytes, so equal hashes of different strings never share a slot.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: Ranges from this size on are hashed, and compared behind it, by the library.
LONG = 32


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _zero_byte_tables() -> list[np.ndarray]:
    """Tables (4, 256) that carry a crc32 over 1, 2, 4, ... zero bytes, up to 2^31."""
    one = np.zeros(32, np.uint64)  # image of every bit under one zero byte, from the polynomial of crc32
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[bit] = c
    tables, byte, bits = [], np.arange(256), one.astype(np.uint32)
    for _ in range(32):
        table = np.zeros((4, 256), np.uint32)
        for part in range(4):
            for bit in range(8):
                table[part, byte >> bit & 1 == 1] ^= bits[8 * part + bit]
        tables.append(table)
        bits = _carry(bits, table)
    return tables


def _carry(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_TABLES = _zero_byte_tables()


def join_crc32(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings together, from theirs and the size of the right one."""
    out, bit = left.copy(), 0
    while len(size) and int(size.max()) >> bit:
        rows = np.flatnonzero(size >> bit & 1)
        out[rows] = _carry(out[rows], _TABLES[bit])
        bit += 1
    return out ^ right


class Ranges:
    """A buffer and ranges (start, size) of it."""

    def __init__(self, buffer: np.ndarray):
        self.buffer = np.ascontiguousarray(buffer)
        padded = np.concatenate([self.buffer, np.zeros(8, np.uint8)])
        # the eight bytes from every place on, as one little-endian number
        self.lanes = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()

    def xxhash64(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """xxhash64 with seed 0 of every range."""
        h = _P5 + size.astype(np.uint64)
        for lane in range(0, LONG, 8):
            rows = np.flatnonzero(size >= lane + 8)
            if not len(rows):
                break
            word = _turn(self.lanes[start[rows] + lane] * _P2, 31) * _P1
            h[rows] = _turn(h[rows] ^ word, 27) * _P1 + _P4
        rows = np.flatnonzero(size & 4)
        at = start[rows] + (size[rows] & ~7)
        h[rows] = _turn(h[rows] ^ ((self.lanes[at] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        for byte in range(3):
            rows = np.flatnonzero((size & 3) > byte)
            at = start[rows] + (size[rows] & ~3) + byte
            h[rows] = _turn(h[rows] ^ (self.buffer[at].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
        rows = np.flatnonzero(size >= LONG)
        if len(rows):
            view = memoryview(self.buffer)
            h[rows] = np.fromiter((xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(start[rows].tolist(), size[rows].tolist())), np.uint64, len(rows))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges of equal size from ``a`` and ``b`` on have the same bytes."""
        out = np.ones(len(a), bool)
        for lane in range(0, LONG, 8):
            rows = np.flatnonzero(out & (size > lane))
            if not len(rows):
                return out
            spare = np.maximum(lane + 8 - size[rows], 0).astype(np.uint64) * np.uint64(8)
            out[rows] = ((self.lanes[a[rows] + lane] ^ self.lanes[b[rows] + lane]) << spare) == 0
        view = memoryview(self.buffer)
        for r in np.flatnonzero(out & (size > LONG)).tolist():
            x, y, n = int(a[r]), int(b[r]), int(size[r])
            out[r] = x == y or view[x + LONG : x + n] == view[y + LONG : y + n]
        return out

    def crc32(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """crc32 of every range."""
        view = self.buffer.tobytes()
        return np.array([crc32(view[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())], np.uint32)

    def intern(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of every range, range that holds each slot or -1)."""
        keys = self.xxhash64(start, size)
        capacity = 1 << max(4, (2 * len(start)).bit_length())
        holder = np.full(capacity, -1, np.int64)
        slots = np.empty(len(start), np.int64)
        at = (keys & np.uint64(capacity - 1)).astype(np.int64)
        left = np.arange(len(start))
        while len(left):
            here = at[left]
            free = holder[here] < 0
            holder[here[free]] = left[free]  # one of those that claim a slot has it
            held = holder[here]
            same = (keys[held] == keys[left]) & (size[held] == size[left])
            check = np.flatnonzero(same & (held != left))
            same[check] = self.equal(start[held[check]], start[left[check]], size[left[check]])
            slots[left[same]] = here[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (capacity - 1)
        return slots, holder

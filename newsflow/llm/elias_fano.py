"""Elias-Fano sequences: non-decreasing integers in a few bits each.

The low bits of every value stand in plain arrays; the high bits are unary in a
bitmap -- a one per value, a zero per step of the high part -- with a running
count per 64-bit word.  All queries work on arrays of queries.  The arrays may
be memory-mapped; nothing is unpacked.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
BYTES = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)
# place of the k-th one of a byte, at 256 * k + byte
PLACE = np.zeros((8, 256), np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        PLACE[_k, _byte] = _at
PLACE = PLACE.ravel()


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one of each 64-bit word: the byte by
    running counts of all eight at once, the bit by a table."""
    words = np.ascontiguousarray(words)
    k = k.astype(np.uint64)
    sums = np.bitwise_count(words.view(np.uint8)).view("<u8") * BYTES  # ones up to and with each byte
    skip = np.bitwise_count(((k * BYTES | TOPS) - sums) & TOPS).astype(np.uint64) << np.uint64(3)
    np.minimum(skip, np.uint64(56), out=skip)  # fewer ones than asked for: callers don't use these
    rest = k - ((sums << np.uint64(8)) >> skip & np.uint64(0xFF))
    byte = words >> skip & np.uint64(0xFF)
    return (skip + PLACE[(rest & np.uint64(7)) << np.uint64(8) | byte]).astype(np.int64)


class EliasFano:
    """``parts`` are the arrays to store; ``EliasFano(parts)`` opens them."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.n, self.bits = (int(x) for x in parts["shape"])
        # left as they are mapped: a task reads the pages it needs, not the whole sequence
        self.map, self.count, self.zeros = parts["map"], parts["count"], parts.get("zeros")
        self.wide, self.narrow = parts.get("wide"), parts.get("narrow")

    @classmethod
    def of(cls, values: np.ndarray, searched: bool = True) -> EliasFano:
        """``searched``: with the counts of zeros that ``search`` needs."""
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = next(b for b in (0, 8, 16, 32, 48) if top >> b <= 4 * n + 64 or b == 48)
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = (n + (int(high[-1]) if n else 0) + 2 + 63) // 64
        ones = np.zeros(size * 64, bool)
        ones[high + np.arange(n)] = True
        packed = np.packbits(ones, bitorder="little").view("<u8")
        count = np.zeros(size + 1, np.int64)
        np.cumsum(_ones(packed), out=count[1:])
        kind = np.uint32 if size * 64 < 1 << 32 else np.uint64
        parts = {"shape": np.array([n, bits], np.int64), "map": packed, "count": count.astype(kind)}
        if searched:
            parts["zeros"] = (np.arange(size + 1) * 64 - count).astype(kind)
        if bits == 48:
            parts["wide"] = (values >> np.uint64(16)).astype(np.uint32)
            parts["narrow"] = values.astype(np.uint16)
        elif bits == 32:
            parts["wide"] = values.astype(np.uint32)
        elif bits:
            parts["narrow"] = values.astype(np.uint16 if bits == 16 else np.uint8)
        return cls(parts)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(i), np.uint64)
        if self.bits == 48:
            return self.wide[i].astype(np.uint64) << np.uint64(16) | self.narrow[i].astype(np.uint64)
        return (self.wide if self.bits == 32 else self.narrow)[i].astype(np.uint64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.count, i.astype(self.count.dtype), "right") - 1  # of one kind, or all is copied
        bit = word * 64 + _select(self.map[word], i - self.count[word].astype(np.int64))
        return (bit - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        seek = np.flatnonzero(high > 0)
        k = high[seek] - 1  # the zero that ends the high part before
        zeros = self.zeros
        known = k < int(zeros[-1])
        word = np.searchsorted(zeros, np.minimum(k, int(zeros[-1])).astype(zeros.dtype), "right") - 1
        word = np.minimum(word, len(self.map) - 1)
        bit = word * 64 + _select(~self.map[word], np.where(known, k - zeros[word].astype(np.int64), 0))
        out[seek] = np.where(known, bit - k, self.n)
        return np.minimum(out, self.n)

    def search(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each value among the places low..high-1 of its query, -1 if
        it is not there: successor search by high part, then by low bits."""
        values = np.asarray(values, np.uint64)
        top = (values >> np.uint64(self.bits)).astype(np.int64)
        before = self._before(np.concatenate([top, top + 1]))
        first, last = np.maximum(before[: len(top)], low), np.minimum(before[len(top) :], high)
        rest = values & np.uint64((1 << self.bits) - 1)
        a, b = first.copy(), np.maximum(last, first)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < rest[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        found = a < last
        at = np.flatnonzero(found)
        found[at] = self._low(a[at]) == rest[at]
        return np.where(found, a, -1)

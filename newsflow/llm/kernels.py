"""Vectorised text kernels: words and their hashes of whole Arrow batches.

A batch of texts is one byte buffer; all functions work on the buffer at once
and never loop over words.  Hashes are 64 bits wide; two different words of a
corpus of ``n`` distinct ones share a hash with probability ``n**2 / 2**65``.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Words are split at these bytes; in UTF-8 they occur in no longer character.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK = 1 << 21  # bytes worked on at once
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse mod 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        if not _POWERS:  # a task's first call: what earlier tasks of this worker left hangs in cycles
            gc.collect()
        size = max(n, BLOCK) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base & _MASK, np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running sums from which the hash of every substring follows."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up, dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per document the index of its first
    word (n + 1 entries)."""
    blank = _IS_BLANK[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the first word of each document."""
    starts, ends, first = words(data, offsets)
    return span_hash(prefix_hash(data, _BYTE_LOWER), starts, ends), first


def run_lengths(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the first one of each document.

    A document with fewer words has one shingle, its whole word sequence; one
    without words has none.
    """
    n_words = np.diff(first)
    sums = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
        if len(sums):
            sums += hashes[k : k + len(sums)] * np.uint64(factor)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    start = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=start[1:])
    out = np.zeros(start[-1], np.uint64)
    full = n_words >= width
    at = np.repeat(first[:-1][full], counts[full]) + run_lengths(counts[full])
    to = np.repeat(start[:-1][full], counts[full]) + run_lengths(counts[full])
    out[to] = mix(sums[at])
    for i in np.flatnonzero((n_words > 0) & ~full):
        total = int(n_words[i])
        for h in hashes[first[i] : first[i + 1]].tolist():
            total = (total * 0xD6E8FEB86659FD93 + h) & _MASK
        out[start[i]] = mix(np.array([total], np.uint64))[0]
    return out, start

"""Run-length index: run-compressed Burrows-Wheeler transform of many short
texts, for marking their long matches.

The transform of repetitive texts has few runs of equal symbols.  Kept are one
entry per run -- its first row and the row its first symbol maps to -- and,
sampled where runs of equal beginnings end, the earliest text position of each
group of rows that share a long beginning.  The suffix array is only used while
building.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of all substrings of the
    lengths asked for, if the doubling came that far.

    Every suffix must differ from all others (unique end marks see to that).
    """
    n = len(symbols)
    bits = int(symbols.max(initial=0) + 1).bit_length()
    width = 1  # symbols that fit into the first key
    while bits * width * 2 <= 64 and width * 2 <= min(lengths):
        width *= 2
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)])
    for k in range(width):
        key = key << np.uint64(bits) | padded[k : k + n]
    kept = {}
    while True:
        order = np.argsort(key)  # ties have equal ranks in any order
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if width in lengths:
            kept[width] = rank
        if new.all():
            return order, kept
        shifted = np.zeros(n, np.uint64)
        shifted[: max(n - width, 0)] = rank[width:]
        key = rank * np.uint64(n + 1) + shifted
        width *= 2


class RunIndex:
    def __init__(self, texts: list[bytes], length: int):
        """Index ``texts``, which stand in the order that says what is earlier."""
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        m = len(texts)
        self.at = np.cumsum(self.sizes + 1) - self.sizes - 1
        symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + m
        symbols[self.at + self.sizes] = np.arange(m)  # unique end marks, the smallest symbols
        half = 1 << (length.bit_length() - 1)
        if half == length:
            half //= 2
        order, ranks = suffix_ranks(symbols, (half,))
        before = symbols[order - 1]
        new = np.ones(len(order), bool)
        new[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(new)
        sizes = np.diff(np.append(self.run, len(order)))
        by_symbol = np.argsort(before[self.run], kind="stable")
        self.maps_to = np.empty(len(self.run), np.int64)
        self.maps_to[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        # groups of rows that share their first `length` symbols
        self.group, self.group_end, self.earliest = (np.zeros(0, np.int64),) * 3
        if half in ranks:
            rank, rest = ranks[half], length - half
            head = rank[order]
            inside = order + rest < len(order)
            tail = np.where(inside, rank[np.minimum(order + rest, len(order) - 1)], 0)
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & inside[1:] & inside[:-1]
            self.group = np.flatnonzero(~same[:-1] & same[1:])
            self.group_end = np.flatnonzero(same[:-1] & ~same[1:]) + 1
            if len(self.group):
                cuts = np.stack([self.group, self.group_end], 1).ravel()
                lows = np.minimum.reduceat(np.append(order, 0), cuts)
                self.earliest = lows[::2]

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one symbol longer to the left."""
        run = np.searchsorted(self.run, rows, "right") - 1
        return self.maps_to[run] + rows - self.run[run]

    def long_matches(self) -> list[np.ndarray]:
        """For each text, the starts whose match with something earlier has at
        least ``length`` symbols.

        All texts are streamed through the index at the same time, from their
        last symbol to the first.  Of the matching statistics only that
        threshold is needed.
        """
        found_text, found_start = [], []
        order = np.argsort(-self.sizes, kind="stable")
        rows = order.copy()  # the end mark of text i is row i
        sizes = self.sizes[order]
        for done in range(1, int(sizes.max(initial=0)) + 1):
            alive = int(np.searchsorted(-sizes, -done, "right"))
            rows = self.step(rows[:alive])
            if done < self.length or not len(self.group):
                continue
            group = np.searchsorted(self.group, rows, "right") - 1
            start = sizes[:alive] - done
            hit = (group >= 0) & (rows < self.group_end[group])
            hit &= self.earliest[group] < self.at[order[:alive]] + start
            found_text.append(order[:alive][hit])
            found_start.append(start[hit])
        out = [np.zeros(0, np.int64)] * len(self.sizes)
        if found_text:
            text, start = np.concatenate(found_text), np.concatenate(found_start)
            by = np.lexsort((start, text))
            text, start = text[by], start[by]
            heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
            for head, own in zip(heads, np.split(start, heads[1:]) if len(text) else [], strict=True):
                out[text[head]] = own
        return out

"""Prefix tree over ordered sets, probed by many sets at once."""

from __future__ import annotations

import numpy as np

EDGE = 64  # most members on one edge: probes are dropped between edges
HELD = 32 << 20  # bytes of the table of members by probe


def least_overlap(a, b, percent: int):
    """Members two sets of sizes a and b must share: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Sets of ascending ranks in a trie; sets with a common beginning share it.

    Edges hold runs of members without a branch and lie in depth-first order.
    Each knows the first edge after its subtree and the sizes of the shortest
    and longest set that pass it.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: sets[i].tolist())
        shared, cuts, path = [], [], []  # path: sets whose own members lead to the present one
        before = np.zeros(0, np.int64)
        for place, i in enumerate(order):
            own, k = sets[i], min(len(before), len(sets[i]))
            differ = np.flatnonzero(before[:k] != own[:k])
            shared.append(int(differ[0]) if len(differ) else k)
            cuts.append({*range(shared[-1] + EDGE, len(own), EDGE), len(own)})
            while path and shared[path[-1]] >= shared[-1]:
                path.pop()
            if path and shared[-1]:
                cuts[path[-1]].add(shared[-1])
            path.append(place)
            before = own
        self.members, self.start, self.end, self.sets = [], [], [], []
        for place, i in enumerate(order):
            at = shared[place]
            for cut in sorted(c for c in cuts[place] if c > at):
                self.members.append(sets[i][at:cut])
                self.start.append(at)
                self.end.append(cut)
                self.sets.append([])
                at = cut
            if at == shared[place]:  # an equal set: it ends where the one before it does
                self.sets[-1].append(i)
            else:
                self.sets[-1] = [i]
        n = len(self.end)
        self.after, self.longest, self.shortest = [n] * n, self.end[:], [1 << 60] * n
        passed: list[int] = []
        for edge in range(n + 1):
            while passed and (edge == n or self.end[passed[-1]] > self.start[edge]):
                last = passed.pop()
                self.after[last] = edge
                if passed:
                    above = passed[-1]
                    self.longest[above] = max(self.longest[above], self.longest[last])
                    self.shortest[above] = min(self.shortest[above], self.shortest[last])
            if edge < n:
                if self.sets[edge]:
                    self.shortest[edge] = self.end[edge]
                passed.append(edge)

    def links(self, probes: list[np.ndarray], universe: int, percent: int) -> list[tuple[int, int]]:
        """(set, probe) index pairs that reach the similarity."""
        step = max(1, HELD // max(universe, 1))
        return [
            (i, j + first)
            for first in range(0, len(probes), step)
            for i, j in self._links(probes[first : first + step], universe, percent)
        ]

    def _links(self, probes, universe, percent):
        """All probes walk down together: overlaps at an edge are those above it
        plus its members that a probe holds.  A probe leaves a subtree when the
        members left in it, or its own that are left, cannot make up the overlap
        needed there; a subtree without probes is skipped.
        """
        sizes = np.array([len(p) for p in probes], np.int64)
        holds = np.zeros((universe, len(probes)), np.uint8)
        for j, p in enumerate(probes):
            holds[p, j] = 1
        above = [(0, np.zeros(len(probes), np.int64), sizes > 0)]
        found, edge = [], 0
        while edge < len(self.end):
            start, end = self.start[edge], self.end[edge]
            while above[-1][0] > start:
                above.pop()
            _, overlap, alive = above[-1]
            overlap = overlap + holds[self.members[edge]].sum(axis=0, dtype=np.int64)
            most = overlap + np.minimum(self.longest[edge] - end, sizes - overlap)
            alive = alive & (most >= least_overlap(self.shortest[edge], sizes, percent))
            if not alive.any():
                edge = self.after[edge]
                continue
            if self.sets[edge]:
                hit = np.flatnonzero(alive & (overlap >= least_overlap(end, sizes, percent)))
                found += [(i, j) for i in self.sets[edge] for j in hit.tolist()]
            above.append((end, overlap, alive))
            edge += 1
        return found

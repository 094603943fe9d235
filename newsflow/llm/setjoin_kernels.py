"""Set similarity kernels: segment signatures and the prefix tree.

A shingle set is kept as its hashes in ascending order; that order is the
global order of the join.
"""

from __future__ import annotations

import numpy as np

from newsflow.llm.kernels import mix

STEP = 1.5  # ratio of the bounds of a size class


class SizeClasses:
    """Size classes, and for each the number of segments its sets are cut into.

    ``percent`` is the least similarity: two sets are linked when
    ``100 * intersection >= percent * union``.  Then the union has at most
    ``partner(n)`` members and at most ``difference(n)`` of them are not shared.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        bounds = [1]
        while bounds[-1] <= self.partner(max(largest, 1)):
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * STEP)))
        self.bounds = np.array(bounds)
        spare = [self.difference(b - 1) for b in bounds[1:]]
        self.segments = np.array([d + 1 + d // 8 for d in spare] + [1])

    def partner(self, n):
        return n * 100 // self.percent

    def difference(self, n):
        return self.partner(n) * (100 - self.percent) // 100

    def of(self, n):
        return np.searchsorted(self.bounds, n, "right") - 1


def segment_signatures(
    tokens: np.ndarray, start: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) rows of which any two linked sets share at least one.

    The sets of a size class are cut at the same hash values into more segments
    than two linked sets can differ in members, so one segment is equal in both.
    Segments of less than two members say little; they are left out unless all
    equal segments of a set could be of that kind.
    """
    n = np.diff(start)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    classes = SizeClasses(percent, int(n.max()))
    own = classes.of(n)
    signatures, sets = [], []
    for step in (0, 1):  # as a set of its class, and as the smaller partner of the next one
        level = own + step
        use = n > 0
        if step:
            use &= classes.partner(n) >= classes.bounds[level.clip(0, len(classes.bounds) - 1)]
        chosen = np.flatnonzero(use)
        if not len(chosen):
            continue
        rows = np.repeat(chosen, n[chosen])
        sizes = n[chosen]
        at = np.repeat(start[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        values = tokens[at]
        parts = classes.segments[level]
        part = ((values >> np.uint64(32)) * parts[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        edge = np.ones(len(rows), bool)
        edge[1:] = (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(edge)
        members = np.diff(np.append(heads, len(rows)))
        owner, place = rows[heads], part[heads]
        strong = np.bincount(owner, members > 1, minlength=len(n)).astype(np.int64)
        # segments without strong ones (also the empty ones): can they be all that is shared?
        doubtful = parts - strong >= parts - classes.difference(n)
        sums = np.add.reduceat(mix(values), heads)
        label = level[owner].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64)
        keep = (members > 1) | doubtful[owner]
        signatures.append(mix(sums[keep] ^ mix(label[keep])))
        sets.append(owner[keep])
        # empty segments of doubtful sets
        for i in np.flatnonzero(doubtful & use):
            filled = place[np.searchsorted(owner, i, "left") : np.searchsorted(owner, i, "right")]
            empty = np.setdiff1d(np.arange(parts[i]), filled).astype(np.uint64)
            if len(empty) and parts[i] - len(filled) >= parts[i] - classes.difference(n[i]):
                signatures.append(mix(mix(np.uint64(level[i]) << np.uint64(40) | empty)))
                sets.append(np.full(len(empty), i))
    return np.concatenate(signatures), np.concatenate(sets)

"""BK-trees over bit codes, many at once in numpy: one tree for each group of rows."""

from __future__ import annotations

import numpy as np


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """codes: uint64 words, a row each; starts: the first row of each group, groups being contiguous.

    A row goes down its group's tree until a node has no child at its distance, and becomes that child; all rows go down together, a level at a time.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        self.codes, self.base = codes, 64 * codes.shape[1] + 1
        self.sizes = np.diff(np.r_[starts, n])
        self.root = np.repeat(starts, self.sizes)
        at, parent, edge = self.root.copy(), np.full(n, -1), np.zeros(n, np.int64)
        going = np.flatnonzero(at != np.arange(n))
        while going.size:
            d = distance(codes[going], codes[at[going]])
            _, first, of = np.unique(at[going] * self.base + d, return_index=True, return_inverse=True)
            child = going[first]
            parent[child], edge[child] = at[child], d[first]
            at[going] = child[of]
            going = going[at[going] != going]
        self.child = np.flatnonzero(parent >= 0)
        key = parent[self.child] * self.base + edge[self.child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = self.child[order], key[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) within the radius in the query's group, query > row; only edges within the radius are followed."""
        q, at, found = queries, self.root[queries], []
        while q.size:
            d = distance(self.codes[q], self.codes[at])
            hit = (d <= radius) & (at < q)
            found.append((q[hit], at[hit]))
            lo = np.searchsorted(self.key, at * self.base + np.maximum(0, d - radius))
            hi = np.searchsorted(self.key, at * self.base + np.minimum(self.base - 1, d + radius), "right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.child[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))]
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (queries[:0], queries[:0])


class Union:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            if not (m := x != y).any():
                return
            np.minimum.at(self.of, np.maximum(x, y)[m], np.minimum(x, y)[m])
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def links(codes: np.ndarray, starts: np.ndarray, radius: int, accept=None, pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group: rows and the smallest row each is joined to.

    accept(a, b): says which of the found pairs are links. Queries go in blocks that meet at most `pairs` rows (or one query's group).
    """
    forest, union = Forest(codes, starts), Union(len(codes))
    queries = np.flatnonzero(np.repeat(forest.sizes, forest.sizes) > 1)
    if not queries.size:
        return queries, queries
    work = np.cumsum(np.repeat(forest.sizes, forest.sizes)[queries])
    for block in np.split(queries, np.flatnonzero(np.diff(work // pairs)) + 1):
        a, b = forest.near(block, radius)
        if accept is None:
            union.join(a, b)
            continue
        order = np.argsort(distance(codes[a], codes[b]), kind="stable")
        a, b, at, size = a[order], b[order], 0, 32
        while at < len(a):  # only pairs that are still apart are looked at
            x, y = a[at : at + size], b[at : at + size]
            apart = union.of[x] != union.of[y]
            x, y = x[apart], y[apart]
            at, size = at + size, min(4096, size * 2) if len(x) < 16 else 32
            if x.size:
                ok = accept(x, y)
                union.join(x[ok], y[ok])
    moved = np.flatnonzero(union.of != np.arange(len(codes)))
    return moved, union.of[moved]

"""Nearest centres of a block by the triangle inequality.

Centres are grouped around pivots; of each group the least and the largest distance to its pivot are kept.
A sample measures the pivots first. Its distance to any member of a group is at least what its pivot distance
lies outside the group's range, so groups whose bound exceeds the sample's k-th best distance so far are skipped. The
k-th best comes from the group of the nearest pivot, or from the blocks before. What remains is measured as without an
index: a matrix product rules out, exact differences decide, ties go to the lower index. Bounds are widened by
the rounding error of the products they come from, so the result is the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

#: Centres from which on a block has an index, and the least number of members of a group.
LEAST_CENTRES, LEAST_MEMBERS = 256, 8
#: Bytes of the largest array over samples and centres.
PAIR_BYTES = 32 * 1024 * 1024
#: Share of pairs left open from which on a tile is measured without the index; the result is the same.
DENSE = 0.5

#: The k nearest without an index: (samples, centres, k) to indexes and distances.
Plain = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class Index(NamedTuple):
    """Plain arrays, as broadcast values are read back before any package code is."""

    pivots: np.ndarray  # one row per group
    members: np.ndarray  # indexes of centres, group by group
    at: np.ndarray  # group g has members[at[g]:at[g + 1]]
    least: np.ndarray  # range of the members' distances to the pivot
    most: np.ndarray


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and per row of x a bound on their rounding error."""
    xx, yy = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)[None, :]
    slack = 8.0 * np.finfo(np.float64).eps * (x.shape[1] + 4) * (xx + yy.max())
    return xx + yy - 2.0 * (x @ y.T), slack


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, PAIR_BYTES // (8 * len(pivots)))
    return np.concatenate([_squares(vectors[i : i + step], pivots)[0].argmin(axis=1) for i in range(0, len(vectors), step)])


def build(vectors: np.ndarray) -> Index | None:
    """None for a block that is not worth an index, or one that holds anything but numbers."""
    if len(vectors) < LEAST_CENTRES or not np.isfinite(vectors).all():
        return None
    wanted = int(np.sqrt(len(vectors)))
    # Far from each other at first, then the means of what is near them.
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < wanted:
        far = np.minimum(far, _squares(vectors, vectors[chosen[-1:]])[0][:, 0])
        far[chosen] = -1.0
        chosen.append(int(far.argmax()))
    pivots = vectors[chosen]
    for _ in range(3):
        group = _nearest_pivot(vectors, pivots)
        size = np.bincount(group, minlength=len(pivots))
        kept = np.flatnonzero(size >= min(LEAST_MEMBERS, size.max()))
        order = np.argsort(group, kind="stable")
        begins = np.cumsum(size) - size
        pivots = np.array([vectors[order[begins[g] : begins[g] + size[g]]].mean(axis=0) for g in kept])
    group = _nearest_pivot(vectors, pivots)
    used, group = np.unique(group, return_inverse=True)
    pivots = pivots[used]
    members = np.argsort(group, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(group))))
    away = np.sqrt(((vectors[members] - pivots[group[members]]) ** 2).sum(axis=1))
    return Index(pivots, members, at, np.minimum.reduceat(away, at[:-1]), np.maximum.reduceat(away, at[:-1]))


class _Best:
    """The k best pairs of every sample so far; pairs gather until they fill the bound, then are cut."""

    def __init__(self, n: int, k: int, limit: np.ndarray) -> None:
        self.n, self.k, self.limit = n, k, limit
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, cols: np.ndarray, squares: np.ndarray) -> None:
        self.parts.append((rows, cols, squares))
        self.held += len(rows)
        if self.held * 24 > max(PAIR_BYTES, 48 * self.n * self.k):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sample, centre, square, rank) of the best pairs; limits follow the k-th."""
        rows, cols, squares = (np.concatenate(p) for p in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((cols, squares, rows))
        rows, cols, squares = rows[order], cols[order], squares[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        rows, cols, squares, rank = rows[kept], cols[kept], squares[kept], rank[kept]
        full = rank == self.k - 1
        self.limit[rows[full]] = np.minimum(self.limit[rows[full]], squares[full])
        self.parts, self.held = [(rows, cols, squares)], len(rows)
        return rows, cols, squares, rank


def nearest(
    x: np.ndarray, centres: np.ndarray, index: Index, k: int, plain: Plain, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Indexes and distances of the k nearest centres, and how many pairs were measured.

    ``bound`` is a distance per sample beyond which centres do not matter; samples with fewer than k
    centres within it have index -1 and an infinite distance in the places left.
    """
    k = min(k, len(centres))
    found, dist = np.full((len(x), k), -1, dtype=np.int64), np.full((len(x), k), np.inf)
    sizes, measured = np.diff(index.at), 0
    step = max(1, PAIR_BYTES // (8 * max(len(index.pivots), int(sizes.max()))))
    for begin in range(0, len(x), step):
        tile = slice(begin, min(begin + step, len(x)))
        part = x[tile]
        limit = np.full(len(part), np.inf) if bound is None else bound[tile] ** 2
        best = _Best(len(part), k, limit)
        squares, slack = _squares(part, index.pivots)
        low, high = np.sqrt(np.maximum(squares - slack, 0.0)), np.sqrt(np.maximum(squares, 0.0) + slack)
        floor = np.maximum(low - index.most * (1 + 1e-12), index.least * (1 - 1e-12) - high)
        floor = np.maximum(floor, 0.0) ** 2 * (1 - 1e-12)
        own = squares.argmin(axis=1)

        def measure(g: int, rows: np.ndarray, part=part, best=best, limit=limit) -> int:
            cols = index.members[index.at[g] : index.at[g + 1]]
            rough, slack = _squares(part[rows], centres[cols])
            cut = limit[rows][:, None] + 2.0 * slack
            if len(cols) >= k:
                cut = np.minimum(cut, np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2.0 * slack)
            r, c = np.nonzero(rough <= cut)
            exact = np.empty(len(r))
            width = max(1, PAIR_BYTES // (8 * part.shape[1]))
            for i in range(0, len(r), width):
                few = slice(i, i + width)
                diff = part[rows[r[few]]] - centres[cols[c[few]]]
                exact[few] = np.einsum("ij,ij->i", diff, diff)
            best.add(rows[r], cols[c], exact)
            return rough.size

        for g in np.unique(own):
            measured += measure(g, np.flatnonzero(own == g))
        best.cut()
        open_ = int(((floor <= limit[:, None]) @ sizes).sum())
        if open_ > DENSE * len(part) * len(centres):
            found[tile], dist[tile] = plain(part, centres, k)
            measured += len(part) * len(centres)
            continue
        for g in range(len(index.pivots)):
            rows = np.flatnonzero((floor[:, g] <= limit) & (own != g))
            if len(rows):
                measured += measure(g, rows)
        rows, cols, squares, rank = best.cut()
        found[begin + rows, rank], dist[begin + rows, rank] = cols, np.sqrt(squares)
    return found, dist, measured

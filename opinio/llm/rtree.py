"""R-trees packed by sort-tile-recursive (STR) over integer vectors with a label.

A tree holds the points of one tile: its leaves are runs of points in STR order, its inner
nodes runs of ``FANOUT`` nodes.  Every node knows, for each coordinate and for the label, the
least and the greatest value below it.  With a query's coordinates these bounds give an
interval that holds the inner product of the query with every point below.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Points of a leaf, nodes below an inner node, axes that an STR order slices by.
LEAF, FANOUT, AXES = 128, 8, 3
#: Inner products under this size are exact in doubles.
EXACT = 1 << 53


def str_order(points: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """Order of the points in which runs of ``leaf`` of them are tiles of an STR packing."""
    def order(rows: np.ndarray, axes: list[int]) -> np.ndarray:
        rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
        tiles = -(-len(rows) // leaf)
        if len(axes) == 1 or tiles < 2:
            return rows
        slabs = round(tiles ** (1 / len(axes))) or 1
        size = -(-tiles // slabs) * leaf
        return np.concatenate([order(rows[i:i + size], axes[1:]) for i in range(0, len(rows), size)])
    return order(np.arange(len(points)), axes)


def slicing(sample: np.ndarray, tiles: int, axes: int = AXES) -> tuple:
    """Nested cuts ``(axis, borders, parts)`` of an STR packing into about ``tiles`` tiles.

    The first axis is column 0 (the label), the next the columns that vary most in the
    sample.  Borders are quantiles of the sample, each part is cut by the sample's share.
    """
    spread = sample[:, 1:].astype(np.float64).var(axis=0) if len(sample) else np.zeros(sample.shape[1] - 1)
    order = [0, *(1 + np.argsort(-spread, kind="stable")[:axes - 1]).tolist()]

    def cut(part: np.ndarray, tiles: int, order: list[int]) -> tuple | None:
        if tiles < 2 or not order or not len(part):
            return None
        slabs = tiles if len(order) == 1 else max(2, round(tiles ** (1 / len(order))))
        values = np.sort(part[:, order[0]])
        borders = np.unique(values[[len(values) * i // slabs for i in range(1, slabs)]])
        at = np.searchsorted(borders, part[:, order[0]], "right")
        parts = [part[at == i] for i in range(len(borders) + 1)]
        return order[0], borders, [cut(p, max(1, round(tiles * len(p) / len(part))), order[1:]) for p in parts]
    return cut(sample, tiles, order)


def tile_of(cuts: tuple | None, points: np.ndarray) -> np.ndarray:
    """The tile of each point, numbered along the nested cuts."""
    if cuts is None:
        return np.zeros(len(points), np.int64)
    axis, borders, parts = cuts
    at, out, first = np.searchsorted(borders, points[:, axis], "right"), np.zeros(len(points), np.int64), 0
    for i, part in enumerate(parts):
        rows = np.flatnonzero(at == i)
        out[rows] = first + tile_of(part, points[rows])
        first += count(part)
    return out


def count(cuts: tuple | None) -> int:
    return 1 if cuts is None else sum(count(p) for p in cuts[2])


class Tree:
    """``points`` (rows of coordinates), ``labels`` and ``rows`` (their numbers) in STR order."""

    def __init__(self, points: np.ndarray, labels: np.ndarray):
        every = np.column_stack([labels, points])
        axes = [0, *(1 + np.argsort(-points.astype(np.float64).var(axis=0), kind="stable")[:AXES - 1]).tolist()]
        self.rows = str_order(every, axes, LEAF)
        self.points, self.labels = points[self.rows], labels[self.rows]
        every = every[self.rows]
        starts = np.arange(0, len(every), LEAF)
        lo, hi = [np.minimum.reduceat(every, starts)], [np.maximum.reduceat(every, starts)]
        #: Of each node its children (or, of a leaf, its rows) as ``(first, end)``.
        self.leaves = len(starts)
        below = [(int(s), min(int(s) + LEAF, len(every))) for s in starts]
        first, width = 0, len(starts)
        while width > 1:
            starts = np.arange(0, width, FANOUT)
            below += [(first + int(s), first + min(int(s) + FANOUT, width)) for s in starts]
            lo.append(np.minimum.reduceat(lo[-1], starts))
            hi.append(np.maximum.reduceat(hi[-1], starts))
            first, width = first + width, len(starts)
        self.below = below
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        self.label_lo, self.label_hi, self.lo, self.hi = lo[:, 0], hi[:, 0], lo[:, 1:], hi[:, 1:]
        self.size = max(int(np.abs(self.lo).max(initial=0)), int(np.abs(self.hi).max(initial=0)))

    def intervals(self, queries: np.ndarray, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with points below each node."""
        most = int(np.abs(queries).max(initial=0)) * self.size * max(1, queries.shape[1])
        kind = np.float64 if most < EXACT else np.int64
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        lo, hi = self.lo[nodes].T.astype(kind), self.hi[nodes].T.astype(kind)
        return up @ lo + down @ hi, up @ hi + down @ lo

    def search(self, query: np.ndarray, points: np.ndarray, least: np.ndarray, greatest: np.ndarray,
               wanted: Callable[[int, int], bool], needs: Callable[[float, float], bool], leaf: Callable) -> None:
        """Best first: nodes by falling upper bound, until no bound is needed any more.

        ``wanted(label_lo, label_hi)`` says whether labels of that range are asked for,
        ``needs(lo, hi)`` whether an inner product in that interval can still be,
        ``leaf(scores, labels, rows)`` takes the points of a leaf.  ``points`` are the tree's, in
        the query's type.
        """
        root = len(self.below) - 1
        queue = [(-greatest[root], root)]
        while queue:
            _, node = heapq.heappop(queue)
            if not needs(least[node], greatest[node]):
                continue
            a, b = self.below[node]
            if node < self.leaves:
                leaf(points[a:b] @ query, self.labels[a:b], self.rows[a:b])
                continue
            for child in range(a, b):
                if needs(least[child], greatest[child]) and wanted(self.label_lo[child], self.label_hi[child]):
                    heapq.heappush(queue, (-greatest[child], child))

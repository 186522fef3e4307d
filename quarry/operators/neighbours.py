"""Exact nearest neighbours among points of a matrix, without comparing all pairs.

Points are cut at medians into leaves with bounding boxes; queries that lie together
are compared with the leaves that their nearest may lie in. No box's distance exceeds
that of a point in it, also when rounded, as both are summed in the same order. Of
equal points only the first few, as many as are asked for, can be among the nearest.
In few dimensions that is near linear; where boxes tell nothing apart it is all pairs.
"""

from __future__ import annotations

import numpy as np

LEAF, CELLS = 64, 2_000_000


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of a to each of b (euclidean ones squared)."""
    d = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = a[:, f, None] - b[None, :, f]
        d += gap * gap if metric == "euclidean" else np.abs(gap)
    return d


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest values of each row, the first of those that tie."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    near = d <= kth
    size = near.sum(axis=1)
    out = np.empty((len(d), k), np.int64)
    odd = size < k  # a distance is NaN
    tied = np.flatnonzero(size > k)
    if len(tied):
        at, level = d[tied], kth[tied]
        last = at == level
        near[tied] = (at < level) | (last & (np.cumsum(last, axis=1) <= k - (at < level).sum(axis=1)[:, None]))
    own = np.nonzero(near[~odd])[1].reshape(-1, k)
    out[~odd] = np.take_along_axis(own, np.argsort(np.take_along_axis(d[~odd], own, axis=1), axis=1, kind="stable"), axis=1)
    out[odd] = np.argsort(d[odd], axis=1, kind="stable")[:, :k]
    return out


def box_distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, metric: str) -> np.ndarray:
    """The least that a point between low and high can be away from one in each box; NaN where a bound is."""
    d = np.zeros(np.broadcast_shapes(low.shape[:-1], lows.shape[:-1]))
    for f in range(lows.shape[-1]):
        gap = np.maximum(np.maximum(lows[..., f] - high[..., f], low[..., f] - highs[..., f]), 0.0)
        d += gap * gap if metric == "euclidean" else gap
    return d


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts equal points together, by row within them; where a point differs from the one before."""
    order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    return order, new


def leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order of leaves of at most ``size`` rows, and where each leaf starts."""
    order, starts, stack = np.arange(len(x)), [], [(0, len(x))]
    x = x.T.copy()  # a feature's values side by side, in the order of leaves
    while stack:
        a, b = stack.pop()
        if b - a <= size:
            starts.append(a)
            continue
        own = x[:, a:b]
        f = int((own.max(axis=1) - own.min(axis=1)).argmax())
        middle = (b - a) // 2
        cut = np.argpartition(own[f], middle)
        order[a:b], x[:, a:b] = order[a:b][cut], own[:, cut]
        stack += [(a + middle, b), (a, a + middle)]  # the left one is next, so starts are in order
    return order, np.array(starts)


class Index:
    """Rows of ``x``; ties go to the first. ``k``: as many neighbours are asked for at most. ``groups``: what ``grouped`` returns."""

    def __init__(self, x: np.ndarray, metric: str, k: int, groups: tuple[np.ndarray, np.ndarray] | None = None):
        self.x, self.metric, self.n = np.ascontiguousarray(x, float) + 0.0, metric, len(x)
        self.plain = not (self.x.shape[1] and np.isfinite(self.x).all()) or self.n <= LEAF
        if self.plain:
            return
        order, new = groups or grouped(self.x)
        first = np.flatnonzero(new)
        turn = np.arange(self.n) - np.repeat(first, np.diff(np.append(first, self.n)))
        self.rows = np.sort(order[turn < k])
        self.x = self.x[self.rows]  # equal points beyond the first k are never among the nearest
        order, self.starts = leaves(self.x, LEAF)
        self.order, self.ends = order, np.append(self.starts[1:], len(order))
        self.lows, self.highs = (f.reduceat(self.x[order], self.starts, axis=0) for f in (np.minimum, np.maximum))
        # Leaves that follow each other lie together; boxes of LEAF of them are looked at first.
        self.first = np.arange(0, len(self.starts), LEAF)
        self.last = np.append(self.first[1:], len(self.starts))
        self.outer = tuple(f.reduceat(v, self.first, axis=0) for f, v in ((np.minimum, self.lows), (np.maximum, self.highs)))

    def nearest(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest (or all) of each point."""
        points = np.ascontiguousarray(points, float) + 0.0
        k = min(k, self.n)
        d, at = np.empty((len(points), k)), np.empty((len(points), k), np.int64)
        if self.plain:
            self._compare(points, np.arange(len(points)), None, k, d, at)
            return d, at
        odd = ~np.isfinite(points).all(axis=1)
        fine = np.flatnonzero(~odd)
        if odd.any():  # such a point has no place among boxes; all rows are compared, as many as there are
            self._compare(points, np.flatnonzero(odd), np.arange(len(self.x)), k, d, at)
        if not len(fine):
            return d, at
        order, new = grouped(points[fine])
        own = fine[order[new]]
        # Points share a leaf as long as they lie about as close as rows do there.
        meets = box_distances(points[own].min(axis=0), points[own].max(axis=0), self.lows, self.highs, self.metric) <= 0
        there = max(1, int((self.ends - self.starts)[meets].sum()))
        cut, starts = leaves(points[own], min(LEAF, max(8, 2 * LEAF * len(own) // there)))
        for a, b in zip(starts, np.append(starts[1:], len(cut))):
            rows = own[cut[a:b]]
            q = points[rows]
            low, high = q.min(axis=0), q.max(axis=0)
            outer = box_distances(low, high, *self.outer, self.metric)
            own_box = int(outer.argmin())
            inner = np.arange(self.first[own_box], self.last[own_box])
            bound = box_distances(low, high, self.lows[inner], self.highs[inner], self.metric)
            near = distances(q, self.x[self._members(inner[np.argsort(bound, kind="stable")[: 1 + 2 * k // LEAF]])], self.metric)
            most = np.partition(near, k - 1, axis=1)[:, k - 1].max() if near.shape[1] >= k else np.inf
            inner = np.concatenate([np.arange(self.first[i], self.last[i]) for i in np.flatnonzero(outer <= most).tolist()])
            bound = box_distances(low, high, self.lows[inner], self.highs[inner], self.metric)
            self._compare(points, rows, np.sort(self._members(inner[bound <= most])), k, d, at)
        d[fine[order]], at[fine[order]] = (v[own][np.cumsum(new) - 1] for v in (d, at))
        return d, at

    def _members(self, chosen: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[a:b] for a, b in zip(self.starts[chosen].tolist(), self.ends[chosen].tolist())])

    def _compare(self, points: np.ndarray, rows: np.ndarray, among: np.ndarray | None, k: int, d: np.ndarray, at: np.ndarray) -> None:
        """Fills d and at of the rows from the points ``among`` (None: all)."""
        x = self.x if among is None else self.x[among]
        for own in np.array_split(rows, len(rows) * len(x) // CELLS + 1):
            gaps = distances(points[own], x, self.metric)
            near = nearest(gaps, k)
            d[own] = np.take_along_axis(gaps, near, axis=1)
            at[own] = near if among is None else self.rows[among[near]]


class Others:
    """The ``k`` nearest of each row of finite ``x`` among all others; ties go to the first.

    Rows get places in which equal points, and points that lie together, follow each other.
    """

    def __init__(self, x: np.ndarray, metric: str, k: int):
        x = np.ascontiguousarray(x, float) + 0.0
        self.k, (order, new) = k, grouped(x)
        self.index = Index(x, metric, k + 1, (order, new))
        first = np.flatnonzero(new)
        point, self.at = np.arange(len(first)), order[first]
        if not self.index.plain:
            of_row = np.full(len(x), -1)
            of_row[order[first]] = point
            point = of_row[self.index.rows[self.index.order]]
            self.at, point = self.index.order[point >= 0], point[point >= 0]
        size = np.diff(np.append(first, len(x)))[point]
        self.ends = np.cumsum(size)
        self.rows = order[np.arange(len(x)) + np.repeat(first[point] - self.ends + size, size)]

    def nearest(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows at places a to b and the nearest (or all) others of each, in order."""
        rows, point = self.rows[a:b], np.searchsorted(self.ends, np.arange(a, b), "right")
        near = self.index.nearest(self.index.x[self.at[point[0] : point[-1] + 1]], self.k + 1)[1][point - point[0]]
        own, width = near == rows[:, None], near.shape[1] - 1
        # A row is one of the k + 1 nearest to its own place, or those are k + 1 others.
        out = np.where(own.any(axis=1), own.argmax(axis=1), width)
        return rows, np.take_along_axis(near, np.arange(width) + (np.arange(width) >= out[:, None]), axis=1)


def most_frequent(codes: np.ndarray) -> np.ndarray:
    """The most frequent code of each row, the smallest of those that tie; codes below 0 have no vote (-1: none has)."""
    best, most, run, codes = np.full(len(codes), -1), np.zeros(len(codes), int), np.zeros(len(codes), int), np.sort(codes, axis=1)
    for i in range(codes.shape[1]):
        run = np.where(codes[:, i] == codes[:, i - 1], run + 1, 1) if i else run + 1
        better = (codes[:, i] >= 0) & (run > most)
        best, most = np.where(better, codes[:, i], best), np.where(better, run, most)
    return best


class Planes:
    """A sample cut at medians into ``parts`` regions of space."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature (-1: a region), value, left, right
        self.regions = 0
        self._cut(sample, parts)

    def _cut(self, x: np.ndarray, parts: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, self.regions, 0))
        if parts > 1 and len(x) > 1:
            for f in np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable").tolist():
                value = float(np.partition(x[:, f], len(x) * (parts // 2) // parts)[len(x) * (parts // 2) // parts])
                side = x[:, f] < value
                if side.any() and not side.all():
                    left = self._cut(x[side], parts // 2)
                    right = self._cut(x[~side], parts - parts // 2)
                    self.nodes[me] = (f, value, left, right)
                    return me
        self.regions += 1
        return me

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The region of each point."""
        feature, value, left, right = (np.array(v) for v in zip(*self.nodes))
        at = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(feature[at] >= 0)):
            below = x[go, feature[at[go]]] < value[at[go]]
            at[go] = np.where(below, left[at[go]], right[at[go]])
        return left[at]

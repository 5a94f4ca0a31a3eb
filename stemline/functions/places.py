"""Array kernel for points in space: a grid of cubes in which to look around. Numpy only; callers bound the number of points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

from stemline.functions.sweep import expand


#: Places times points that are all compared, as a grid would cost more.
FEW = 1 << 16
#: The same for one of many groups: those that are compared together, and those that are compared by themselves.
TOGETHER, ALONE = 1 << 14, 1 << 18
#: The same for a group whose pairs are not all held where only the nearest ones are asked for.
WIDENED = 1 << 23


class Places:
    """Points, kept by the cube that they lie in."""

    def __init__(self, points: np.ndarray, width: float):
        self.points, self.width = points, width
        cube = np.floor(points / width).astype(np.int64)
        self.low = cube.min(axis=0) if len(cube) else np.zeros(3, np.int64)
        self.span = (cube.max(axis=0) - self.low + 1) if len(cube) else np.zeros(3, np.int64)
        code = self._code(cube - self.low)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]

    def _code(self, cube: np.ndarray) -> np.ndarray:
        return (cube[:, 0] * self.span[1] + cube[:, 1]) * self.span[2] + cube[:, 2]

    def around(self, at: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) of each place i and point j at most reach apart, in blocks of bounded size."""
        if not len(at) or not len(self.points):
            return
        if len(at) * len(self.points) <= FEW:
            d = np.sqrt(((at[:, None, :] - self.points[None, :, :]) ** 2).sum(axis=2))
            i, j = np.nonzero(d <= reach)
            yield i, j, d[i, j]
            return
        cube, k = np.floor(at / self.width).astype(np.int64) - self.low, int(np.ceil(reach / self.width))
        for step in product(range(-k, k + 1), repeat=3):
            there = cube + np.array(step)
            inside = np.flatnonzero(((there >= 0) & (there < self.span)).all(axis=1))
            code = self._code(there[inside])
            for i, j in expand(inside, np.searchsorted(self.code, code), np.searchsorted(self.code, code, side="right")):
                j = self.order[j]
                d = np.sqrt(((at[i] - self.points[j]) ** 2).sum(axis=1))
                ok = d <= reach
                yield i[ok], j[ok], d[ok]

    def pairs(self, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (i, j, distance), by i, then distance, then j."""
        blocks = list(self.around(at, reach))
        i, j, d = (np.concatenate([b[c] for b in blocks]) if blocks else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        o = np.lexsort((j, d, i))
        return i[o], j[o], d[o]

    def nearest(self, at: np.ndarray) -> np.ndarray:
        """The nearest point of each place (the first of equal ones): of the cubes around it, or else of all."""
        out = np.full(len(at), -1, np.int64)
        i, j, _ = self.pairs(at, self.width)
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        out[i[first]] = j[first]
        far = np.flatnonzero(out < 0)
        size = max(1, (1 << 20) // max(1, len(self.points)))
        for lo in range(0, len(far), size):
            part = far[lo : lo + size]
            out[part] = ((at[part][:, None, :] - self.points[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        return out


def group_pairs(of_at: np.ndarray, at: np.ndarray, of_point: np.ndarray, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j, distance) of places and points of one group at most reach apart, by i, then distance, then j; the groups ascend."""
    low, high = np.searchsorted(of_point, of_at), np.searchsorted(of_point, of_at, side="right")
    many = np.bincount(of_at)[of_at] * (high - low) > TOGETHER if len(of_at) else np.zeros(0, bool)
    few, blocks = np.flatnonzero(~many), []
    for i, j in expand(few, low[few], high[few]):
        x, y, z = ((at[i, c] - points[j, c]) ** 2 for c in range(3))
        d = np.sqrt(x + y + z)
        ok = d <= reach
        blocks.append((i[ok], j[ok], d[ok]))
    for g in np.unique(of_at[many]):
        (a, b), (p, q) = (np.searchsorted(x, [g, g + 1]) for x in (of_at, of_point))
        if (b - a) * (q - p) <= ALONE:
            x, y, z = ((at[a:b, None, c] - points[None, p:q, c]) ** 2 for c in range(3))
            d = np.sqrt(x + y + z)
            i, j = np.nonzero(d <= reach)
            blocks.append((i + a, j + p, d[i, j]))
        else:
            blocks += [(i + a, j + p, d) for i, j, d in Places(points[p:q], reach).around(at[a:b], reach)]
    i, j, d = (np.concatenate([b[c] for b in blocks]) if blocks else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
    o = np.lexsort((j, d, i))
    return i[o], j[o], d[o]


def group_nearest(of_at: np.ndarray, at: np.ndarray, of_point: np.ndarray, points: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each place of group_pairs(). In large groups the reach grows up to the given one, for places that are not settled."""
    sizes = np.searchsorted(of_point, of_at, side="right") - np.searchsorted(of_point, of_at)
    large = np.bincount(of_at)[of_at] * sizes > WIDENED if len(of_at) else np.zeros(0, bool)
    blocks = []
    for open_, radii in ((np.flatnonzero(~large), (reach,)), (np.flatnonzero(large), (reach / 3, reach / 1.6, reach))):
        for r in radii if len(open_) else ():
            i, j, d = group_pairs(of_at[open_], at[open_], of_point, points, r)
            settled = (np.bincount(i, minlength=len(open_)) >= k) | (r == reach)
            own = np.flatnonzero(settled[i] & first_of_groups(i, k))
            blocks.append((open_[i[own]], j[own], d[own]))
            open_ = open_[~settled]
    i, j, d = (np.concatenate([b[c] for b in blocks]) if blocks else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
    o = np.argsort(i, kind="stable")
    return i[o], j[o], d[o]


def fullest(points: np.ndarray, band: float) -> int:
    """The first of the points that have most others within the band. Callers bound how far the points lie apart, in bands.

    Counts of cubes bound those of points from below and above; distances are taken only of points that can still be the
    first, and only to cubes that are partly within the band.
    """
    left, most = np.arange(len(points)), 0
    for parts in (2, 6):
        width, k = band / parts, parts + 1
        cube = np.floor(points / width).astype(np.int64)
        cube += k - cube.min(axis=0)
        span = cube.max(axis=0) + k + 1
        code = (cube[:, 0] * span[1] + cube[:, 1]) * span[2] + cube[:, 2]
        count = np.bincount(code, minlength=int(span.prod()))
        there, of = np.unique(code[left], return_inverse=True)
        low, high, partly = np.zeros(len(there), np.int64), np.zeros(len(there), np.int64), []
        for step in product(range(-k, k + 1), repeat=3):
            away, by = np.abs(step), (step[0] * span[1] + step[1]) * span[2] + step[2]
            if width * np.sqrt((np.maximum(away - 1, 0) ** 2).sum()) > band * (1 + 1e-9):
                continue
            here = count[there + by]
            high += here
            if width * np.sqrt(((away + 1) ** 2).sum()) < band * (1 - 1e-9):
                low += here
            else:
                partly.append(by)
        most = max(most, int(low.max()))
        ok = high[of] >= most
        left, low, high = left[ok], low[of[ok]], high[of[ok]]
    order = np.argsort(code, kind="stable")
    stop = np.cumsum(count)
    best, o, size = len(points), np.argsort(-high, kind="stable"), 256
    while len(o):
        part, o, size = o[:size], o[size:], size * 4
        rows, got = left[part], low[part].copy()
        for by in partly:
            at = code[rows] + by
            for i, j in expand(np.arange(len(rows)), stop[at] - count[at], stop[at]):
                d = np.sqrt(((points[rows[i]] - points[order[j]]) ** 2).sum(axis=1))
                got += np.bincount(i[d <= band], minlength=len(rows))
        top = int(got.max())
        if top >= most:
            first = int(rows[got == top].min())
            best, most = (min(best, first) if top == most else first), top
        o = o[high[o] >= most]
    return best


def first_of_groups(i: np.ndarray, k: int) -> np.ndarray:
    """Of sorted group numbers, which rows are among the first k of their group."""
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return rank < k


def group_medians(n: int, i: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The median of each column of values for each of n groups of at most k rows, i ascending; NaN for empty ones."""
    count = np.bincount(i, minlength=n)
    rank = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.full((n, k, values.shape[1]), np.inf)
    padded[i, rank] = values
    padded.sort(axis=1)
    rows = np.arange(n)
    middle = (padded[rows, np.maximum(count - 1, 0) // 2] + padded[rows, np.minimum(count // 2, k - 1)]) / 2
    middle[count == 0] = np.nan
    return middle

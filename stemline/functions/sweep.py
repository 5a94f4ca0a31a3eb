"""Array kernels for sweeping sorted points. Numpy only; Spark partitions, shuffles and sorts their input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidate pairs held at once.
BLOCK = 2_000_000


def forward_pairs(group: np.ndarray, x: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of one group with x[j] - x[i] <= reach; group and x ascend together."""
    n = len(x)
    if n < 2:
        return
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    stop = np.empty(n, np.int64)
    for s, e in zip(starts, ends):  # one binary search per point, over its own group
        stop[s:e] = s + np.searchsorted(x[s:e], x[s:e] + reach, side="right")
    yield from expand(np.arange(n), np.arange(n) + 1, np.maximum(stop, np.arange(n) + 1))


def expand(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, k) for each k in [start, stop), in blocks of about BLOCK pairs."""
    size = stop - start
    done = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(done, done[at] + BLOCK, side="right")) - 1)
        part = size[at:upto]
        total = int(part.sum())
        if total:
            i = np.repeat(np.arange(at, upto), part)
            k = np.arange(total) - np.repeat(done[at:upto] - done[at], part) + start[i]
            yield owner[i], k
        at = upto

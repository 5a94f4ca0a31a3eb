"""Array kernel for one-to-one pairs at least cost, over the pairs that are allowed only. Callers bound the number of pairs.

A matching of most pairs, and of least cost among these, is found in each connected component: rows enter one by one, each
by a shortest path of changes, over reduced costs and with a heap. Memory follows the number of pairs.
"""

from __future__ import annotations

import heapq
from math import inf

import numpy as np


def component_labels(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of the component of each pair (i, j)."""
    label = np.arange((i.max() if len(i) else -1) + 1)
    while True:
        low = np.full((j.max() if len(j) else -1) + 1, len(label))
        np.minimum.at(low, j, label[i])
        new = label.copy()
        np.minimum.at(new, i, low[j])
        new = new[new]  # labels are rows of the component, and so is the label of a label
        if np.array_equal(new, label):
            return label[i]
        label = new


def _solve(options: list[list[tuple[int, float]]], columns: int, big: float) -> list[int]:
    """The column of each row, -1 for none; options: (column, cost >= 0) of each row; big: the cost of having none."""
    n = len(options)
    of_row, of_column, u, v = [-1] * n, [-1] * columns, [0.0] * n, [0.0] * columns
    for s in range(n):
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, d, seen, none = s, 0.0, [(s, 0.0)], (inf, -1)
        while True:
            for c, cost in options[row]:
                if c not in done and (new := d + cost - u[row] - v[c]) < dist.get(c, inf):
                    dist[c], via[c] = new, row
                    heapq.heappush(heap, (new, c))
            none = min(none, (d + big - u[row], row))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] > none[0]:
                d, c = none[0], -1
                break
            d, c = heapq.heappop(heap)
            done[c] = d
            row = of_column[c]
            if row < 0:
                break
            seen.append((row, d))
        for r, at in seen:
            u[r] += d - at
        for x, at in done.items():
            v[x] -= d - at
        if c < 0:  # the row at the end of the path stays without a column
            row, c = none[1], of_row[none[1]]
            of_row[row] = -1
            if row == s:
                continue
        while True:
            row = via[c]
            of_column[c], of_row[row], c = row, c, of_row[row]
            if row == s:
                break
    return of_row


def best_pairs(i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of the pairs (i, j, cost) that are taken; each pair is given once, rows and columns are small numbers."""
    if not len(i):
        return np.zeros(0, np.int64)
    alone = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
    taken, rest = [np.flatnonzero(alone)], np.flatnonzero(~alone)
    label = component_labels(i[rest], j[rest])
    at = np.lexsort((j[rest], i[rest], label))
    order, label = rest[at], label[at]
    if not len(order):
        return taken[0]
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    size = np.diff(np.r_[first, len(label)])
    price = cost[order] - np.repeat(np.minimum.reduceat(cost[order], first), size)  # the same for each pair: of most pairs, the least stays the least
    rank = lambda x: np.cumsum(np.r_[True, (x[1:] != x[:-1]) | (label[1:] != label[:-1])]) - 1
    row, by_column = rank(i[order]), np.lexsort((j[order], label))
    column = np.empty(len(order), np.int64)
    column[by_column] = rank(j[order][by_column])
    inner = lambda x: x - np.repeat(np.minimum.reduceat(x, first), size)
    row, column = inner(row), inner(column)
    rows, columns = (np.maximum.reduceat(x, first) + 1 for x in (row, column))
    r, c, p = row.tolist(), column.tolist(), price.tolist()
    won: list[int] = []
    for at, n, n_rows, n_columns in zip(first.tolist(), size.tolist(), rows.tolist(), columns.tolist()):
        options: list[list[tuple[int, float]]] = [[] for _ in range(n_rows)]
        for k in range(at, at + n):
            options[r[k]].append((c[k], p[k]))
        got = _solve(options, n_columns, 1.0 + 2.0 * float(price[at : at + n].sum()))
        won += [k for k in range(at, at + n) if got[r[k]] == c[k]]
    taken.append(order[np.array(won, np.int64)])
    return np.concatenate(taken)

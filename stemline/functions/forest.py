"""Array kernels on parent pointers. Numpy only; callers bound the length of the arrays."""

from __future__ import annotations

import numpy as np


def _double(par: np.ndarray, *lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Follow par to its end by pointer doubling; sums of the lengths on the way."""
    anc, sums = par.copy(), [x.copy() for x in lengths]
    for _ in range(max(1, int(len(par)).bit_length()) + 1):
        nxt = anc[anc]
        if np.array_equal(nxt, anc):
            break
        for s in sums:
            s += s[anc]
        anc = nxt
    return anc, sums


def break_cycles(par: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Nodes that no root leads to lie on or below a cycle: make the first node of each cycle a root. Gives those nodes."""
    anc, _ = _double(par)
    lost = local[anc]
    if not lost.any():
        return np.zeros(0, np.int64)
    on = np.unique(anc[lost])  # after that many steps only nodes of cycles are left
    least, step = np.arange(len(par)), par.copy()
    for _ in range(len(on).bit_length() + 1):
        least[on], step[on] = np.minimum(least[on], least[step[on]]), step[step[on]]
    cut = on[least[on] == on]
    par[cut], local[cut] = cut, False
    return cut


def measure(par: np.ndarray, local: np.ndarray, weight: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """(root, hops, size, position): sizes are summed upward, then each node gives its children ranges by prefix sums.

    par: index of the parent, of itself for roots; local: whether there is a parent; order: siblings ascend by it.
    """
    root, (hops,) = _double(par, local.astype(np.int64))
    size = weight.astype(np.int64).copy()
    down = np.argsort(hops, kind="stable")
    ends = np.r_[np.searchsorted(hops[down], np.arange(1, (hops[down[-1]] if len(down) else 0) + 2)), 0][:-1]
    for k in range(len(ends) - 1, 0, -1):
        at = down[ends[k - 1] : ends[k]]
        np.add.at(size, par[at], size[at])
    kids = np.flatnonzero(local)
    kids = kids[np.lexsort((order[kids], par[kids]))]
    before = np.cumsum(size[kids]) - size[kids]
    first = np.r_[True, par[kids][1:] != par[kids][:-1]] if len(kids) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(kids)), 0)) if len(kids) else np.zeros(0, np.int64)
    shift = np.zeros(len(par), np.int64)
    shift[kids] = 1 + before - before[start] if len(kids) else 0
    _, (position,) = _double(par, shift)
    return root, hops, size, position


def path_sums(par: np.ndarray, local: np.ndarray, *lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The root of each node and, for each array of lengths, their sum from the node up to the root."""
    return _double(par, *[np.where(local, x, 0).astype(np.int64) for x in lengths])


def strong_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The strong component of each of n nodes under edges a -> b (Tarjan, without recursion)."""
    order = np.argsort(a, kind="stable")
    b = b[order].tolist()
    first = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, low, comp, stack, count, found = [0] * n, [0] * n, [-1] * n, [], 0, 0
    for s in range(n):
        if at[s]:
            continue
        count += 1
        at[s] = low[s] = count
        stack.append(s)
        work = [(s, first[s])]
        while work:
            v, k = work.pop()
            if k < first[v + 1]:
                work.append((v, k + 1))
                w = b[k]
                if not at[w]:
                    count += 1
                    at[w] = low[w] = count
                    stack.append(w)
                    work.append((w, first[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], at[w])
                continue
            if low[v] == at[v]:
                while True:
                    w = stack.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return np.array(comp, np.int64)

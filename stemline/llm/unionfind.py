"""Union-find over the edges of one chunk, on arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node of the edges a - b; the root is the least node of its component. Any sortable keys."""
    codes, nodes = pd.factorize(np.concatenate([a, b]), sort=True)
    n = len(nodes)
    x, y = codes[: len(a)], codes[len(a) :]
    parent = np.arange(n)
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return nodes, nodes[parent]
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))  # link roots to lesser roots
        while True:  # halve paths until each node points at its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up

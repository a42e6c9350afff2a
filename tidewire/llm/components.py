"""Components within one task; those of a table of edges are in tidewire.operators.graph."""

from __future__ import annotations

import numpy as np

from tidewire.operators.graph import components

__all__ = ["components", "merge_roots"]


def merge_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, each index's smallest one in its component, with links (i, j) added."""
    a, b = root[i], root[j]
    while True:
        apart = a != b
        if not apart.any():
            return root
        edge = np.unique(np.minimum(a, b)[apart] * len(root) + np.maximum(a, b)[apart])
        a, b = edge // len(root), edge % len(root)
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]

"""Small helpers inside tasks: components (numpy) and short batches."""

from __future__ import annotations

import numpy as np


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union the components of ``labels`` (each entry names its root, roots name
    themselves) along the pairs ``u[i]``, ``v[i]``; roots are smallest positions."""
    while len(u):
        lu, lv = labels[u], labels[v]
        differ = lu != lv
        if not differ.any():
            break
        u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
        np.minimum.at(labels, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that a Python worker holds few long texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

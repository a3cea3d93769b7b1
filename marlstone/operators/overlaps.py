"""Sizes of intersections between the sets of a bounded block, for Arrow kernels."""

from __future__ import annotations

import numpy as np


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the pairwise intersections of sets of integers. Only values that two
    sets hold make a column; columns are multiplied a thousand at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)  # whole numbers below 2^24 are exact
    for a in range(0, len(shared), 1024):
        i, j = np.searchsorted(column, [a, a + 1024])
        grid = np.zeros((n, 1024), np.float32)
        grid[owner[i:j], column[i:j] - a] = 1
        out += grid @ grid.T
    return out

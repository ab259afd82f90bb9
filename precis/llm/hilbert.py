"""Hilbert curve keys of points on a grid, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer ``cells`` (points by axes, each in
    ``[0, 2**bits)``); axes times bits must stay below 64.

    Works from the top bit down: each bit's corner of the cube is the Gray code of its
    place on the curve, and fixes the reflection and turn of the cube below it.
    """
    n, axes = cells.shape
    x = [cells[:, k].astype(np.int64).copy() for k in range(axes)]
    # undo the reflections and exchanges of axes that lead to every smaller cube
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for k in range(axes):
            flip = (x[k] & top) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[k] ^= swap
    # Gray code across axes
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    carry = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = (key << 1) | (((x[k] ^ carry) >> level) & 1)
    return key

"""Bits that most of some hashes have."""

from __future__ import annotations

import numpy as np

LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run hashes[starts[i] : starts[i + 1]], the bits that are set in over half of it; empty runs: zero.

    Bits are counted in eight byte lanes of an integer at once, so at most 255 hashes go into one sum.
    """
    n = len(starts) - 1
    out = np.zeros(n, np.uint64)
    counts = np.diff(starts)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    first = np.repeat(starts[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = np.cumsum(pieces) - pieces
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, first)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        over = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(shift)
    return out

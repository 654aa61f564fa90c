"""Cutting texts into runs of windows that share their smallest inner hash.

Every ``length``-byte window has ``length - ANCHOR + 1`` inner strings of ``ANCHOR`` bytes; the
smallest of their hashes (the anchor) depends on the window's bytes alone. Neighbouring windows
mostly share it, so the windows of a text fall into few runs, and equal windows, wherever they
are, are in runs with equal anchors.
"""

from __future__ import annotations

import numpy as np

ANCHOR = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Mixed hashes of all ``size``-byte strings; ``size`` is a power of two."""
    h, factor, width = data.astype(np.uint64) + np.uint64(1), 0xD6E8FEB86659FD93, 1
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % 2**64
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width`` values: minima of prefixes and suffixes of blocks."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of every run of a text with at least ``length`` bytes.

    A run also ends where the anchor's leftmost place changes, so that windows that repeat in
    a periodic stretch are in different runs.
    """
    grams = gram_hashes(data)
    least = window_minimum(grams, length - ANCHOR + 1)
    passed = grams[: len(least) - 1] == least[:-1]
    first = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | passed) + 1])
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    return least[first].view(np.int64), first, last

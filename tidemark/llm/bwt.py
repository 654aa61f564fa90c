"""Common prefixes of bounded length in a Burrows-Wheeler transform, by interval expansion.

The intervals of all strings are walked breadth first by backward extension, one character more
per level. An interval of level k that ends where no common prefix is known yet fixes the value
there to k, so values appear in increasing order; the walk stops at the wanted length, and the
places that are still open are those where neighbours share at least that much.
"""

from __future__ import annotations

import numpy as np

from .superkmers import gram_hashes


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; symbols stay below 2**20, the last is unique."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(2, np.int64)])
    key, k = (padded[:n] << 40) | (padded[1 : n + 1] << 20) | padded[2 : n + 2], 3
    while True:
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(np.diff(key[order]) != 0, out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        if new[-1] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:]
        key, k = (rank << 32) | later, 2 * k


def long_matches(symbols: np.ndarray, length: int) -> np.ndarray:
    """Starts of the suffixes that share ``length`` symbols or more with another suffix.

    Symbols from 257 on are separators, each of which occurs once.
    """
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1].astype(np.int32)  # the transform
    step = np.empty(n, np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)  # where the suffix one symbol longer stands
    letter = np.minimum(before, 257).astype(np.uint16)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    for _ in range(length):
        # the intervals are disjoint and in order, so sorting their places by letter alone sorts the targets
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        source = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        places = np.arange(ends[-1], dtype=np.int32) + (low - (ends - sizes))[source].astype(np.int32)
        by = np.argsort(letter[places], kind="stable")
        places, source = places[by], source[by]
        to, symbol = step[places], before[places]
        starts = np.ones(len(to), bool)
        starts[1:] = (to[1:] != to[:-1] + 1) | (source[1:] != source[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(starts)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1]
        fresh = open_[high + 1]
        low, high = low[fresh], high[fresh]
        open_[high + 1] = False
        if not len(low):
            break
        again = np.argsort(low, kind="stable")  # only separators are out of order
        low, high = low[again], high[again]
    shared = np.flatnonzero(open_)
    return np.unique(np.concatenate([order[shared], order[shared - 1]]))


def _stretches(contents: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Parts (content, from, to) outside which no window can be repeated.

    A repeated window holds no shorter string that occurs only once; the longest power of two
    below two thirds of the window is looked at.
    """
    size = 1 << max(0, int(length / 1.5).bit_length() - 1)
    joined = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    ends = np.cumsum([len(c) + 1 for c in contents])
    if len(joined) < size:
        return []
    grams = gram_hashes(joined, size)
    breaks = np.concatenate([[0], np.cumsum(joined == 255)])
    whole = breaks[size:] == breaks[:-size]
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    bad = np.concatenate([[0], np.cumsum((count[inverse] < 2) | ~whole)])
    width = length - size + 1
    good = np.flatnonzero(bad[width:] == bad[:-width])
    if not len(good):
        return []
    cut = np.flatnonzero((np.diff(good) > 1))
    first, last = good[np.concatenate([[0], cut + 1])], good[np.append(cut, len(good) - 1)]
    which = np.searchsorted(ends, first, side="right")
    begin = ends[which] - np.array([len(c) + 1 for c in contents])[which]
    return list(zip(which.tolist(), (first - begin).tolist(), (last - begin + length).tolist(), strict=True))


def repeated_windows(contents: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs (content, first, last) of window starts whose window occurs elsewhere, too."""
    parts = _stretches(contents, length)
    if not parts:
        return []
    pieces, owners, offsets = [], [], []
    for i, (c, a, b) in enumerate(parts):
        pieces.append(np.append(np.frombuffer(contents[c], np.uint8)[a:b].astype(np.int64) + 1, 300 + i))
        owners.append(np.full(b - a + 1, c))
        offsets.append(np.arange(a, b + 1))
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    at = long_matches(np.concatenate(pieces), length)
    if not len(at):
        return []
    c, s = owner[at], offset[at]
    order = np.lexsort((s, c))
    c, s = c[order], s[order]
    cut = np.flatnonzero((np.diff(c) != 0) | (np.diff(s) > 1))
    first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(c) - 1)
    return list(zip(c[first].tolist(), s[first].tolist(), s[last].tolist(), strict=True))

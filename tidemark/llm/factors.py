"""Occurrences of a text's dyadic blocks: suffix ranges by doubling, and a wavelet matrix over the suffix array.

Texts are lists of symbols laid one after another; equal symbols of different texts count as
different, so that no range crosses texts.
"""

from __future__ import annotations

import numpy as np


def ranked_blocks(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and each repeated dyadic block's range in it.

    ``symbols`` are numbers that differ between texts; ``start`` and ``stop`` bound the text of
    each position. Returns the array and the columns (position, first slot, end slot, length)
    of the blocks of 2, 4, 8, ... symbols that begin at multiples of their length within
    their text, occur again in it and are at most half as long as it. Suffixes that are equal
    over half of their text stay in any order.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, symbols[order][1:] != symbols[order][:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    half = (stop - start) // 2
    active = np.flatnonzero(np.repeat(size > 1, size))
    active = active[half[order[active]] >= 2]
    length, found = 1, []
    while len(active):
        pos = order[active]
        after = pos + length
        second = np.where(after < stop[pos], rank[np.minimum(after, n - 1)], -1)
        key = rank[pos] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[active] = pos
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        slot, wide = np.repeat(active[first], size), np.repeat(size, size)
        rank[pos] = slot
        length *= 2
        again = wide > 1
        aligned = again & ((pos - start[pos]) % length == 0)
        found.append(np.stack([pos[aligned], slot[aligned], slot[aligned] + wide[aligned], np.full(aligned.sum(), length)]))
        # a group is of one text, so it stays or goes as a whole
        active = active[again & (half[pos] >= 2 * length)]
    return order, list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 4


class WaveletMatrix:
    """Bits of a list of numbers, highest first, each level parted stably by the bit."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in reversed(range(int(values.max(initial=0)).bit_length())):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in places low..high-1 are smaller than the value."""
        count = np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[low], ones[high]
            one = (value >> b) & 1 == 1
            count += np.where(one, (high - low) - (z - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + z, high - z)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number at this place of the sorted numbers in low..high-1."""
        value = np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[low], ones[high]
            small = (high - low) - (z - a)
            one = place >= small
            place = np.where(one, place - small, place)
            value |= one.astype(np.int64) << b
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + z, high - z)
        return value

    def neighbours(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next smaller and next larger number in low..high-1 of a number that is among them; itself where there is none."""
        place = self.below(low, high, value)
        before, after = value.copy(), value.copy()
        some = np.flatnonzero(place > 0)
        before[some] = self.nth(low[some], high[some], place[some] - 1)
        some = np.flatnonzero(place + 1 < high - low)
        after[some] = self.nth(low[some], high[some], place[some] + 1)
        return before, after

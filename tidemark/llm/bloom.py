"""Blocked Bloom filters over words of one length, and the words one edit away that they may hold.

Words are rows of letter numbers (0-255). Their hash is a sum over positions, so the hash of
an edited word costs one addition and the edited word is built only when its filter says yes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bits of a filter for each word.
BITS = 16
#: 64-bit cells of a block.
CELLS = 8

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = int(_RANDOM.integers(1, 1 << 62)) * 2 + 1
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each word; all words have the same length."""
    return _mixed((_LETTER[words] * _powers(words.shape[1])).sum(axis=1, dtype=np.uint64))


def _cells(h: np.ndarray, blocks: int) -> tuple[np.ndarray, ...]:
    """Two cells of the block of each hash, and three bits in each."""
    u, one = np.uint64, np.uint64(1)
    block = ((h >> u(32)) * u(blocks)) >> u(32)
    a = block * u(CELLS) + (h & u(7))
    b = block * u(CELLS) + ((h >> u(3)) & u(7))
    first = (one << ((h >> u(6)) & u(63))) | (one << ((h >> u(12)) & u(63))) | (one << ((h >> u(18)) & u(63)))
    again = h * u(0x9E3779B97F4A7C15)
    second = (one << (again >> u(58))) | (one << ((again >> u(52)) & u(63))) | (one << ((again >> u(46)) & u(63)))
    return a, first, b, second


def build(h: np.ndarray) -> np.ndarray:
    """Filter that holds these hashes."""
    blocks = max(1, -(-len(h) * BITS // (64 * CELLS)))
    cells = np.zeros(blocks * CELLS, np.uint64)
    a, first, b, second = _cells(h, blocks)
    np.bitwise_or.at(cells, a, first)
    np.bitwise_or.at(cells, b, second)
    return cells


def holds(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    blocks = len(cells) // CELLS
    u, one = np.uint64, np.uint64(1)
    block = ((h >> u(32)) * u(blocks)) >> u(32)
    first = (one << ((h >> u(6)) & u(63))) | (one << ((h >> u(12)) & u(63))) | (one << ((h >> u(18)) & u(63)))
    some = np.flatnonzero(cells[block * u(CELLS) + (h & u(7))] & first == first)
    _, _, b, second = _cells(h[some], blocks)
    return some[cells[b] & second == second]


def edits(words: np.ndarray, letters: np.ndarray, probe: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, edited words) of replacements by a larger letter and of deletions that the filters may hold.

    ``probe(length, hashes)`` gives the places of the hashes that may be words of that length.
    Each pair of words one edit apart is met from exactly one side.
    """
    m, n = words.shape
    power = _powers(n)
    part = _LETTER[words] * power
    total = part.sum(axis=1, dtype=np.uint64)
    before = np.zeros(m, np.uint64)
    for i in range(n):
        larger = letters[None, :] > words[:, i, None]
        row, to = np.nonzero(larger)
        h = (total - part[:, i])[row] + (_LETTER[letters] * power[i])[to]
        at = probe(n, _mixed(h))
        if len(at):
            out = words[row[at]]
            out[:, i] = letters[to[at]]
            yield row[at], out
        if n > 1:
            # in a stretch of one letter only the first place is deleted
            row = np.flatnonzero(words[:, i] != words[:, i - 1]) if i else np.arange(m)
            h = before[row] + (total - before - part[:, i])[row] * _BACK
            at = probe(n - 1, _mixed(h))
            if len(at):
                yield row[at], np.delete(words[row[at]], i, axis=1)
        before = before + part[:, i]

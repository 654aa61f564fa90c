"""Periodic runs of words, by internal pattern matching.

A run with smallest period q and at least four periods holds a block of B words, q <= B < 2q,
that begins at a multiple of B (B a power of two), and that block occurs again exactly q words
before or after. So each block asks the wavelet matrix over the suffix array for its nearest
occurrence in the window of B words on either side. Block and occurrence overlap or touch, so
all occurrences there form a progression, whose difference is the only candidate period. The
candidates are extended to maximal stretches, and those long enough are the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factors import WaveletMatrix, ranked_blocks

#: Words whose texts are searched in one go; a longer text is searched alone.
CHUNK_WORDS = 1 << 17
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _candidates(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, period, stretch) of stretches of at least two periods, by period and position."""
    order, (pos, low, high, length) = ranked_blocks(symbols, start, stop)
    if not len(pos):
        return pos, pos, pos
    matrix = WaveletMatrix(order - start[order])
    local = pos - start[pos]
    before, after = matrix.neighbours(low, high, local)
    back, on = local - before, after - local
    left, right = (back > 0) & (back <= length), (on > 0) & (on <= length)
    at = np.concatenate([pos[left] - back[left], pos[right]])
    period = np.concatenate([back[left], on[right]])
    stretch = period + np.concatenate([length[left], length[right]])
    by = np.lexsort((-stretch, at, period))
    return at[by], period[by], stretch[by]


def _reach(symbols: np.ndarray, at: int, period: int, stop: int) -> int:
    """First position from ``at`` whose symbol is not the one a period later; at most ``stop`` - period."""
    end, step = stop - period, 64
    while at < end:
        to = min(end, at + step)
        off = np.flatnonzero(symbols[at:to] != symbols[at + period : to + period])
        if len(off):
            return at + int(off[0])
        at, step = to, step * 4
    return max(at, end)


def _back(symbols: np.ndarray, at: int, period: int, start: int) -> int:
    """Smallest position from which all symbols up to ``at`` equal those a period later."""
    step = 64
    while at > start:
        to = max(start, at - step)
        off = np.flatnonzero(symbols[to:at] != symbols[to + period : at + period])
        if len(off):
            return to + int(off[-1]) + 1
        at, step = to, step * 4
    return at


def runs_of(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, shortest: int = 6, periods: int = 4) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, under the position at which the text begins, in that order."""
    found: dict[int, set[tuple[int, int, int]]] = {}
    last, low, high = 0, 0, 0
    for at, period, stretch in zip(*(c.tolist() for c in _candidates(symbols, start, stop)), strict=True):
        if period == last and low <= at and at + stretch <= high:
            continue
        begin, end = int(start[at]), int(stop[at])
        low, high, last = _back(symbols, at, period, begin), _reach(symbols, at, period, end) + period, period
        if high - low >= max(shortest, periods * period):
            found.setdefault(begin, set()).add((low - begin, high - low, period))
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in found.items()}


def _search(words: list[list[bytes]], shortest: int, periods: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text of a chunk."""
    sizes = np.array([len(w) for w in words])
    total = int(sizes.sum())
    if not total:
        return [[] for _ in words]
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(words)), sizes)
    names = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    symbols = text * len(names.dictionary) + names.indices.to_numpy()
    found = runs_of(symbols, begin[text], (begin + sizes)[text], shortest, periods)
    return [found.get(int(b), []) if n else [] for b, n in zip(begin, sizes, strict=True)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for at, length, period in runs:
        keep[at + period : at + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _finder(shortest: int, periods: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                # texts of like length together keep the levels of the matrix few
                words, n, stop = [], 0, at
                while stop < len(order) and (stop == at or n < CHUNK_WORDS):
                    words.append((texts[int(order[stop])].as_py() or b"").split())
                    n += len(words[-1])
                    stop += 1
                runs = _search(words, shortest, periods)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(order[at:stop])),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[{"start": s, "length": m, "period": p} for s, m, p in r] for r in runs], _RUN),
                        pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                at = stop

    return find


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = 6, periods: int = 4) -> DataFrame:
    """Runs of words of each text, and the text with each run cut to its first period.

    A run is a stretch of words (between white space) with smallest period q, at least
    ``shortest`` words and ``periods`` (four or more) times q long, that no neighbouring word
    extends. Returns doc_id, n_words, runs (start, length, period; by start, then period) and
    collapsed (the kept words joined by one blank), a row per row of ``docs``: repeated rows
    and null ids are rows of their own, a null or empty text has no words and no runs, an
    empty table gives no rows, other columns are not read.
    """
    if periods < 4:
        raise ValueError("blocks are sure to find runs of four periods or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_finder(shortest, periods), RUNS)

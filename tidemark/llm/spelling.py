"""Groups of spelling variants, by Bloom-guided neighbourhoods.

Filters over the vocabulary, one for each word length (split where a length has very many
words), are broadcast in waves of bounded size. Every word generates its replacements and
deletions and probes the filters; only edits that a filter may hold are shuffled, and the join
with the vocabulary removes those that are no words. Insertions are the deletions of the
longer word, so each pair is generated once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import staged

#: Bytes of filters that are broadcast at once.
WAVE_BYTES = 32 << 20
#: Most words of one filter; a length with more has several.
SLICE_WORDS = 1 << 20
#: Words of at least this length share their filters.
LONG = 64
#: Edited words that are probed in one go.
PROBES = 1 << 19


def _matrices(batch: pa.RecordBatch, letters: int) -> Iterator[np.ndarray]:
    """Latin-1 words of a batch as arrays of equal length."""
    words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    words.sort(key=len)
    at = 0
    while at < len(words):
        n, to = len(words[at]), at
        while to < len(words) and len(words[to]) == n and to - at < max(1, PROBES // letters):
            to += 1
        yield np.frombuffer(b"".join(words[at:to]), np.uint8).reshape(to - at, n)
        at = to


def _slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(slices)


def _hasher(slices: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _matrices(batch, 1):
                h = bloom.hashes(words)
                length = min(words.shape[1], LONG)
                part = _slice_of(h, slices[length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length), pa.int32()), pa.array(part.astype("int32")), pa.array(h.view("int64"))], ["length", "slice", "hash"]
                )

    return run


def _build(group: pa.Table) -> pa.Table:
    cells = bloom.build(group["hash"].to_numpy().view("uint64"))
    return pa.table({"length": group["length"][:1], "slice": group["slice"][:1], "cells": pa.array([cells.tobytes()], pa.binary())})


def _prober(filters, slices: dict[int, int], letters: str):
    """Edits of words that a broadcast filter may hold: (word, near)."""
    alphabet = np.frombuffer(letters.encode("latin-1"), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {k: np.frombuffer(v, np.uint64) for k, v in filters.value.items()}

        def probe(length: int, h: np.ndarray) -> np.ndarray:
            length = min(length, LONG)
            count = slices.get(length, 0)
            if count == 1:
                return bloom.holds(cells[length, 0], h) if (length, 0) in cells else h[:0].astype("int64")
            out = [np.zeros(0, "int64")]
            if count:
                part = _slice_of(h, count)
                for s in range(count):
                    if (length, s) in cells:
                        some = np.flatnonzero(part == s)
                        out.append(some[bloom.holds(cells[length, s], h[some])])
            return np.concatenate(out)

        for batch in batches:
            for words in _matrices(batch, len(alphabet)):
                for row, near in bloom.edits(words, alphabet, probe):
                    columns = [[w.tobytes().decode("latin-1") for w in ws] for ws in (words[row], near)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["word", "near"])

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of words one inserted, deleted or replaced letter apart, each pair once.

    ``vocabulary`` has distinct words of letters up to U+00FF and their counts n.
    """
    spark = vocabulary.sparkSession
    size = F.least(F.length("word"), F.lit(LONG))
    counts = {r[0]: r[1] for r in vocabulary.groupBy(size.alias("length")).count().collect()}  # at most LONG rows
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most 255 rows
    alphabet = "".join(sorted(r.c for r in letters if r.c))
    slices = {k: -(-n // SLICE_WORDS) for k, n in counts.items()}
    words = vocabulary.select("word")
    filters = staged(
        words.mapInArrow(_hasher(slices), "length int, slice int, hash long").groupBy("length", "slice")
        .applyInArrow(_build, "length int, slice int, cells binary"), "spelling-filters",
    )
    waves, room = [[]], WAVE_BYTES
    for k, n in sorted(counts.items()):
        for s in range(slices[k]):
            need = -(-n // slices[k]) * bloom.BITS // 8
            if need > room and waves[-1]:
                waves.append([])
                room = WAVE_BYTES
            waves[-1].append((k, s))
            room -= need
    found = None
    for level, wave in enumerate(waves):
        # a wave's filters have at most WAVE_BYTES, or one slice of SLICE_WORDS words
        wanted = F.concat_ws("-", "length", "slice").isin([f"{k}-{i}" for k, i in wave])
        cells = spark.sparkContext.broadcast({(r.length, r.slice): bytes(r.cells) for r in filters.where(wanted).collect()})
        part = staged(words.mapInArrow(_prober(cells, slices, alphabet), "word string, near string"), f"spelling-edits-{level}")
        cells.destroy()
        found = part if found is None else found.unionByName(part)
    other = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(other, "near").join(vocabulary, "word").select("word", "n", "near", "near_n")


def group_variants(vocabulary: DataFrame, *, factor: int = 2) -> DataFrame:
    """Each word's form, the most frequent near word, and the root that forms lead to.

    ``vocabulary`` has distinct words and counts n. Near words differ by exactly one inserted,
    deleted or replaced letter. A word's form is its near word of largest n (of equal ones the
    first in code-point order) if that n is at least ``factor`` times (more than one) the
    word's, else null. Returns word, n, n_near, form, form_n and root (the word itself without
    a form), a row per word; an empty vocabulary gives none.
    """
    vocabulary = staged(vocabulary.select("word", F.col("n").cast("long").alias("n")).sortWithinPartitions(F.length("word")), "spelling-words")
    pairs = near_words(vocabulary)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    top = -F.col("best.less")
    has = top >= F.col("n") * factor
    joined = vocabulary.join(best, "word", "left")
    table = staged(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, top).alias("form_n")
    ), "spelling-forms")
    return table.join(_roots(table), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(table: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers jump until they stand on words without a form."""
    steps, level = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"), F.lit(False).alias("done")), 0
    while not steps.where(~F.col("done")).isEmpty():
        # n grows by the factor along forms, so chains are short and their rest halves in each round
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("ahead"), F.col("done").alias("ended"))
        moved = steps.where(~F.col("done")).join(ahead, "to", "left").select(
            "word", F.coalesce("ahead", "to").alias("to"), F.coalesce("ended", F.lit(True)).alias("done")
        )
        steps, level = staged(steps.where("done").unionByName(moved), f"spelling-roots-{level}"), level + 1
    return steps.select("word", F.col("to").alias("root"))

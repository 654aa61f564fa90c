"""Spelling variants against a direct search."""

import random

import numpy as np
import pytest

from tidemark.llm import bloom, queries, spelling
from tidemark.llm.spelling import group_variants, near_words

SCHEMA = "word string, n long"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def direct(counts, factor=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        top = min(xs, key=lambda x: (-counts[x], x), default=None)
        if top is not None and counts[top] >= factor * counts[w]:
            form[w] = top
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=str)


def grouped(df):
    return sorted((tuple(r) for r in group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def words_of(seed, size):
    rng, counts = random.Random(seed), {}
    for _ in range(size):
        w = "".join(rng.choice("abÿé") for _ in range(rng.randint(1, 6)))
        counts[w] = rng.choice([3, 3, 4, 6, 8, 16, 40])
    return counts


@pytest.mark.parametrize("limits", [(32 << 20, 1 << 20), (64, 16)])
def test_groups_equal_a_direct_search(spark, monkeypatch, limits):
    """With the usual bounds, and with many waves of many slices."""
    monkeypatch.setattr(spelling, "WAVE_BYTES", limits[0])
    monkeypatch.setattr(spelling, "SLICE_WORDS", limits[1])
    counts = words_of(3, 260 if limits[0] > 64 else 70)
    assert grouped(spark.createDataFrame(list(counts.items()), SCHEMA)) == direct(counts)


def test_forms_lead_to_the_last_root(spark):
    counts = {"aaaaa"[:5 - i] + "bbbbb"[:i]: 3 * 2**i for i in range(6)}
    got = grouped(spark.createDataFrame(list(counts.items()), SCHEMA))
    assert {r[2] for r in got} == {"bbbbb"} and got == direct(counts)


def test_ties_go_to_the_first_word_and_long_words_share_filters(spark):
    long = "x" * 90
    counts = {"house": 3, "mouse": 9, "louse": 9, long: 5, long + "y": 50, "x" * 70: 4}
    got = {r[0]: r for r in grouped(spark.createDataFrame(list(counts.items()), SCHEMA))}
    assert got["house"][1:3] == ("louse", "louse") and got["louse"][1] is None and got[long][1] == long + "y"


def test_pairs_come_once(spark):
    counts = words_of(8, 120)
    got = [tuple(sorted((r.word, r.near))) for r in near_words(spark.createDataFrame(list(counts.items()), SCHEMA)).collect()]
    assert len(got) == len(set(got)) == sum(one_edit(a, b) for a in counts for b in counts) // 2


def test_edits_are_probed_with_the_hash_of_the_edited_word():
    words = np.frombuffer(b"abcaaadda", np.uint8).reshape(3, 3)
    seen = []

    def probe(length, h):
        seen.append((length, h))
        return np.arange(len(h))

    for (row, near), (length, h) in zip(bloom.edits(words, np.frombuffer(b"abcd", np.uint8), probe), seen, strict=False):
        assert near.shape == (len(row), length) and (bloom.hashes(near) == h).all()


def test_filter_holds_its_words_and_few_others():
    rng = np.random.default_rng(1)
    words = rng.integers(97, 123, (20_000, 9)).astype(np.uint8)
    cells = bloom.build(bloom.hashes(words))
    assert len(bloom.holds(cells, bloom.hashes(words))) == len(words)
    assert len(bloom.holds(cells, bloom.hashes(rng.integers(97, 123, (20_000, 9)).astype(np.uint8)))) < 400


def test_awkward_rows(spark, awkward, nothing):
    assert grouped(spark.createDataFrame([], SCHEMA)) == [] and group_variants(queries.misspelt_words(nothing)).count() == 0
    words = {r.word: r.n for r in queries.misspelt_words(awkward, least=1, shortest=4).collect()}
    assert words["words"] >= 1 and words["aaaa"] >= 250 and "漢字" not in words
    assert group_variants(queries.misspelt_words(awkward)).where("word <> root and form is null").isEmpty()

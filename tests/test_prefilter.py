"""The filter of word patterns leaves out no pattern that can match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import topics as T
from tidemark.functions.prefilter import Prefilter, first_letters, parted


def test_first_letters():
    assert first_letters(r"\bmamas?\b") == {"mam"}
    assert first_letters(r"\bm[ao]o\b|\brins?\b") == {"mao", "moo", "rin"}
    assert first_letters(r"\bp[ee]\b") == {"pe"} and first_letters(r"\bq(?:se|sd)\b") == {"qse", "qsd"}
    assert first_letters(r"\bultra(?:s)?x") == {"ult"} and first_letters(r"\bbi\s*rads") == {"bi"} and first_letters(r"\ba(?:s)?b") == {"asb", "ab"}
    with pytest.raises(ValueError):
        first_letters(r"\b\w+")


LISTS = [
    [T._lower(p) for part in T.TOPIC_PARTS for p in part], [p for ps in T.SCREENING for p in ps],
    [T.term_pattern(t) for t in (*T.PROCEDURE_STRONG, *T.PROCEDURE_BASE, *T.RECOMMENDATION)],
]


def texts(patterns, seed, n):
    rng = random.Random(seed)
    parts = [w for p in patterns for w in re.findall(r"[a-z]{2,}", re.sub(r"\\.", " ", p))] + ["bi", "rads", "-", "\n", ".", "xmama", "c", "pe", "mao", ":"]
    return ["".join(rng.choice(parts) + rng.choice([" ", " ", "-", "\n", "", ", "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("patterns", LISTS)
def test_no_match_is_left_out(patterns):
    keys, seen = Prefilter(patterns), 0
    rx = re.compile(keys.regex, re.ASCII)
    for text in texts(patterns, 1, 1500):
        found = set(rx.findall(text))
        for p, k in zip(patterns, keys.keys, strict=True):
            if re.search(p, text, re.ASCII):
                seen += 1
                assert found & set(k), (p, text)
    assert seen > 1000


def test_total_equals_all_counts(spark):
    patterns = LISTS[1]
    df = spark.createDataFrame([(t,) for t in texts(patterns, 2, 200)], "t string")
    keys = Prefilter(patterns)
    every = sum((F.regexp_count("t", F.lit(p)) for p in patterns), F.lit(0))
    df = df.withColumn("k", keys.found(F.col("t")))
    assert df.where(T._total(F.col("t"), patterns, F.col("k"), keys, 0) != every).count() == 0 and df.agg(F.sum(every)).first()[0] > 200


def test_parted_alternatives_match_alike():
    whole, grouped = re.compile("|".join(T.SURGICAL_TERMS)), re.compile(parted(T.SURGICAL_TERMS))
    for text in texts(T.SURGICAL_TERMS, 3, 800):
        assert [m.span() for m in whole.finditer(text)] == [m.span() for m in grouped.finditer(text)]

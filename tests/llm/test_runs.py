"""Periodic runs of words against a direct search."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.runs import _search, periodic_runs

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def direct_runs(words, shortest=6, periods=4):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, periods * q) and j > i:
                if not any(all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def direct_row(doc_id, text):
    words = re.findall(WORD, text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = direct_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(" ".join(kept)))


def test_blocks_find_all_runs():
    rng, seen = random.Random(5), 0
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 9)):
            letters = rng.randint(1, 4)
            words = [b"%d" % rng.randint(0, letters) for _ in range(rng.randint(0, 80))]
            for _ in range(rng.randint(0, 3)):
                root = [b"%d" % rng.randint(0, letters) for _ in range(rng.randint(1, 9))]
                at = rng.randint(0, len(words))
                words[at:at] = (root * 60)[: rng.randint(4, 60)]
            texts.append(words)
        for words, runs in zip(texts, _search(texts, 6, 4), strict=True):
            assert runs == direct_runs(words)
            seen += len(runs)
    assert seen > 1000


def test_texts_do_not_share_runs(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a b a b"), (2, "a b a b"), (3, "x " * 6)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect())
    assert got == [(1, 4, [], "a b a b"), (2, 4, [], "a b a b"), (2, 4, [], "a b a b"), (3, 6, [(0, 6, 1)], "x")]


def test_fewer_than_four_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(spark.range(0).selectExpr("id doc_id", "'' text"), periods=3)


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.collect()
    got = {r.doc_id: r for r in periodic_runs(awkward).collect()}
    assert periodic_runs(awkward).count() == len(rows) and periodic_runs(nothing).count() == 0
    assert [tuple(r) for r in got[11].runs] == [(0, 300, 1)] and got[11].collapsed == "aaaa"
    assert got[4].n_words == got[5].n_words == got[6].n_words == 0 and got[6].collapsed == ""
    assert got[7].n_words == 24_000 and got[10].collapsed == "éàü ß 漢字 👍"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_query_equals_direct_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 800]
    got = {r[0]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == 200 and sum(r[1] > 0 for r in got.values()) > 10
    for doc_id, text in docs:
        assert got[doc_id] == direct_row(doc_id, text)


def test_planted_words_keep_other_rows(spark):
    df = spark.createDataFrame([(None, "a  b"), (1, None), (2, " c\td ")], "doc_id long, text string")
    got = queries.planted_words(df).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    assert all((r.doc_id, r.text) in {(None, "a  b"), (1, None), (2, " c\td ")} for r in got)

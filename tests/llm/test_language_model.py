"""The language model: gradients, causality, proper shares, counts against a direct sum, held-out gain."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import attention as A
from tidemark.llm import language_model as M
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def small_model(seed=0, symbols=9, classes=5):
    rng = np.random.default_rng(seed)
    p = {k: v.astype("f8") for k, v in A.start_params(symbols, classes).items()}
    p["distance"] = rng.normal(0, 0.3, 2 * A.BLOCK)
    lengths = np.array([50, 3, 1, 70])
    return rng, p, np.log(rng.dirichlet(np.ones(classes), symbols)), rng.integers(2, symbols, lengths.sum()), lengths


def test_gradients_equal_differences():
    rng, p, prior, symbols, lengths = small_model()
    x, place = A.stream(symbols, lengths)
    goal = np.full(len(x), -1)
    goal[place] = rng.integers(0, 5, len(place))
    blocks = np.flatnonzero((goal.reshape(-1, A.BLOCK) >= 0).any(axis=1))
    loss = lambda: A.gradients(p, prior, x, blocks, goal.reshape(-1, A.BLOCK)[blocks].reshape(-1))
    g, _ = loss()
    for k in p:
        for _ in range(3):
            i, e = tuple(rng.integers(0, n) for n in p[k].shape), 1e-5
            old = p[k][i]
            p[k][i] = old + e
            up = loss()[1]
            p[k][i] = old - e
            down = loss()[1]
            p[k][i] = old
            assert abs((up - down) / 2 / e - g[k][i]) < 1e-6


def shares(p, prior, x, cls):
    return A.Scorer({k: v.astype("f4") for k, v in p.items()}, prior.astype("f4"), 2)(x, np.full(len(x), cls))


def test_shares_sum_to_one_and_follow_the_exact_exponential():
    _, p, prior, symbols, lengths = small_model()
    x, place = A.stream(symbols, lengths)
    every = np.stack([shares(p, prior, x, c)[0][place] for c in range(5)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    assert np.allclose(shares(p, prior, x, 0)[1][place], np.log(np.exp(every[:2]).sum(axis=0)), atol=1e-4)
    w = A._window(p, x, np.unique(place // A.BLOCK))
    logits = w["hidden"] @ p["out"] + prior[w["own"].reshape(-1)]
    exact = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    at = (np.unique(place // A.BLOCK)[:, None] * A.BLOCK + np.arange(A.BLOCK)).reshape(-1)
    assert np.abs(exact.T[:, np.isin(at, place)] - every).max() < 0.15


def test_attention_looks_back_only_and_within_its_text():
    _, p, prior, symbols, lengths = small_model()
    x, place = A.stream(symbols, lengths)
    before = shares(p, prior, x, 1)[0][place]
    other = symbols.copy()
    other[30] = 2 + (other[30] - 1) % 7
    after = shares(p, prior, A.stream(other, lengths)[0], 1)[0][place]
    changed = np.flatnonzero(before != after)
    assert changed.min() == 30 and changed.max() < 50


def test_training_learns_a_copied_symbol():
    """The class is that of the symbol four places back, which no count of single symbols foresees."""
    rng = np.random.default_rng(4)
    symbols = rng.integers(2, 6, 6000)
    goal = np.r_[[0] * 3, symbols[:-3] - 2]
    prior = np.full((6, 4), np.log(0.25), "f4")
    _, losses = A.train(prior, 4, symbols, goal, np.full(60, 100), steps=300, batch=32)
    assert losses[0] > 1.3 and np.mean(losses[-20:]) < 1.0


def test_words_are_cut_as_if_alone(spark):
    sub = M.Subwords(M.default_tokenizer())
    texts = ["the", "haus", "é ", " ", "x y", "漢字", "<|endoftext|>", "'s", "|", "a" * 500]
    words = [t.encode() for t in texts]
    for some in (words, words[:2], words):
        got = sub.find(some)
        for n, t in zip(got, [w.decode() for w in some], strict=True):
            assert sub.laid_out(np.array([n])).tolist() == sub.encoding.encode_ordinary(" " + t)


def test_words_are_split_at_ascii_white_space():
    texts = ["  A\tb\x0bÉ \x0cd ", "", None, " \n", "x Y", "z\x1cZ"]
    words, text = M.split_words(pa.array(texts))
    want = [(i, w.lower() if w.isascii() else w.replace("Y", "y")) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(text.tolist(), words.to_pylist(), strict=True)) == want


def tokens(text):
    return ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def check_counts(rows, got):
    train = Counter(t for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 or r.doc_id is None for t in tokens(r.text))
    n, v = sum(train.values()), len(train)
    base = lambda t: math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((len(w), sum(train[t] > 0 for t in w), n, round(sum(map(base, w)), 6)) for w in (tokens(r.text) for r in rows))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_query(spark, monkeypatch):
    """Counts and base equal a direct sum whatever is broadcast; scores are log-probabilities that do not depend on it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op11_lm_score(spark, SF).collect()
    check_counts(rows, got)
    assert all(r.score < 0 and r.attention_score < 0 for r in got) and len(got) == len(rows)
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 1}
    monkeypatch.setattr(M, "FREQUENT_WORDS", 50)
    again = {r.doc_id: r.score for r in queries.op11_lm_score(spark, SF).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 + 1e-5 * abs(r.score) for r in got)


def test_held_out_texts_gain_from_context(spark):
    """Two kinds of text with their own words: the model foresees the kind, the counts do not."""
    rng = np.random.default_rng(2)
    kinds = [[f"{a}{b}" for a in s for b in ("ta", "ro", "lin")] for s in (("ka", "mu", "so"), ("ve", "ni", "pol"))]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.fit_language_model(df.where("doc_id < 300"), steps=150)
    held = M.score_texts(df.where("doc_id >= 300"), model).collect()
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in held])
    assert gain > 0.15 and all(r.score > r.base_score for r in held)


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.collect()
    model = M.fit_language_model(awkward, steps=5)
    got = M.score_texts(awkward, model).collect()
    assert len(got) == len(rows) and M.score_texts(nothing, model).count() == 0
    empty = [r for r in got if r.doc_id in (4, 5, 6)]
    assert all(r.n_tokens == r.n_known == 1 and math.isfinite(r.score) for r in empty)
    assert [r.n_tokens for r in got if r.doc_id == 7] == [24_001]
    bare = M.score_texts(awkward, M.fit_language_model(nothing, steps=5)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.base_score == 0 for r in bare)

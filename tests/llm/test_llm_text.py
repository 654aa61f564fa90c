"""Operators on texts and vectors against brute force, and on awkward rows."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.bwt import long_matches, repeated_windows
from tidemark.llm.language import fit_languages, identify_languages
from tidemark.llm.near_dedup import components, keep_one_of_each, near_duplicates
from tidemark.llm.neighbours import nearest_neighbours
from tidemark.llm.packing import cut, default_tokenizer, pack_documents, token_bytes
from tidemark.llm.quality import CONFIDENT, CONTENT, META, Pool, View, content_view, fit_quality, metadata_view, score_quality
from tidemark.llm.repeats import repeated_spans
from tidemark.llm.toxicity import Scorer, fit_toxicity, score_toxicity, PATTERNS

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[k:] for k in range(n)), strict=False))
    return out


def classes(rows, n, percent):
    sets, parent = sets_of(rows, n), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100}


@tables
def test_near_duplicates_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected, n = classes(rows, 3, 85)
    got = near_duplicates(docs, words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == n


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one text with one to three words changed: links need not include the smallest id."""
    rng = np.random.default_rng(1)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 150, i % 4):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    expected, _ = classes(rows, 5, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == expected


def test_near_duplicates_awkward(awkward, nothing):
    got = near_duplicates(awkward).toPandas()
    assert len(got) == awkward.count()
    comp = dict(zip(got["doc_id"], got["component_id"], strict=True))
    assert comp[2] == comp[3] == 1 and comp[9] == 8 and comp[4] == 4 and comp[5] == 5 and comp[6] == 6
    assert got[got["doc_id"].isna()]["kept"].all()
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id IN (2, 3, 9)").count() == 0
    assert near_duplicates(nothing).count() == 0


def test_long_matches():
    rng = np.random.default_rng(0)
    for _ in range(20):
        text = rng.integers(1, 3, 200)
        symbols = np.append(text, 300)
        for length in (1, 4, 9):
            seen = collections.Counter(tuple(text[i : i + length]) for i in range(200 - length + 1))
            expected = [i for i in range(200 - length + 1) if seen[tuple(text[i : i + length])] > 1]
            assert long_matches(symbols, length).tolist() == expected


def test_repeated_windows():
    a, b = os.urandom(300).replace(b"\xff", b"a"), os.urandom(200).replace(b"\xff", b"b")
    assert repeated_windows([a + b, b + a[:150]], 150) == [(0, 0, 0), (0, 300, 350), (1, 0, 50), (1, 200, 200)]
    assert repeated_windows([a, b], 150) == []


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [16_384, 1])
def test_repeated_spans(spark, awkward, nothing, group):
    docs = awkward
    if os.path.isdir(SF):
        docs = awkward.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(60))
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id <> 7 OR doc_id IS NULL").collect()]
    got = repeated_spans(docs.where("doc_id <> 7 OR doc_id IS NULL"), group_contents=group).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed(rows, 400)
    assert repeated_spans(nothing).count() == 0


def test_cut():
    for n in (*range(1, 700), 4095, 4096, 4097, 9001):
        pieces = cut(n)
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[1] for p in pieces) == n and all(length <= 4096 // k for _, length, k in pieces)


def test_packing(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = [None, "", "Don't STOP, it's 12%! <|endoftext|> x", "éàü ÄÖ ß İstanbul ΑΣ 漢字 é a b", "w" * 300, "end. end, (end)"]
    assert token_bytes(texts, path) == [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = pack_documents(awkward).toPandas()
    ids = {r["doc_id"]: token_bytes([r["text"]], path)[0] + b"\2\0\0\0" for r in awkward.collect() if r["doc_id"] is not None}
    assert set(got["doc_id"].dropna()) == set(ids)
    for r in got[got["doc_id"].notna()].itertuples():
        data = ids[r.doc_id]
        assert r.doc_tokens == len(data) // 4 and zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert got["length"].sum() == sum(len(token_bytes([r["text"]], path)[0]) // 4 + 1 for r in awkward.collect())
    assert pack_documents(nothing).count() == 0


@tables
def test_packing_ids_equal_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    ids = {r["doc_id"]: np.array([*e.ids, 2], "<u4").tobytes() for r, e in zip(rows, plain.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False), strict=True)}
    got = pack_documents(docs).toPandas()
    for r in got.itertuples():
        data = ids[r.doc_id]
        assert r.doc_tokens * 4 == len(data) and zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for _, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() == g["doc_tokens"].iloc[0]
    # little padding: sequences are filled to 98 % and more
    assert got["length"].sum() > 0.98 * 4096 * got["sequence_id"].nunique()


def test_grammar():
    scorer = Scorer(frozenset({"grub"}))

    def found(text):
        return {bytes([p]).decode() for p, n in zip(PATTERNS, scorer.counts(text), strict=True) if n}

    assert found("What a grubby thing.") == {"I"} and found("You are such a grub") == {"X"} and found("a grub you are") == {"X"}
    assert found("not a grub") == {"n"} and found("He said someone is a grub") == {"r"} and found("grub and idiot") == {"D"}
    assert found("I will kill you") == {"K"} and found("kill the process") == {"T"} and found("All is well. " * 50) == set()


def test_path_weights_make_the_score():
    """The composed machine's weight is that of its symbols, over all matches of all clauses."""
    weights = {p: 1.0 + i / 8 for i, p in enumerate(PATTERNS)}
    scorer = Scorer(frozenset({"grub"}), weights)

    def weight(text):
        total = sum(n * w for n, w in zip(scorer.written(text), weights.values(), strict=True))
        assert abs(scorer.weight(text) - total) < 1e-12
        return total

    one = weight("a grub")
    # unpunctuated: each further match adds its weight, however long the clause is
    assert weight("grub " * 400) == one + 399 * weights[ord("D")] and weight("a grub. " * 3) == 3 * one
    assert weight("not a grub") == weights[ord("n")] and weight("you grub") == weight("a grub you are") == weights[ord("X")]
    assert weight(None) == weight("") == weight("all is well") == 0


@tables
def test_toxicity(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = fit_toxicity(docs, labels.where(~held_out))
    rows = score_toxicity(docs.select("doc_id", "text"), model).join(labels.where(held_out), "doc_id").toPandas()
    said = rows["_score"] >= 0.7
    assert not said[rows["toxic"] == 0].any() and said[rows["toxic"] == 1].mean() > 0.6
    odd = score_toxicity(awkward, model)
    # the user's own _score stays
    assert odd.columns == [*awkward.columns, "__score"] and odd.where("__score BETWEEN 0 AND 1 AND _score = 'x'").count() == awkward.count()
    empty = fit_toxicity(nothing, labels.limit(0))
    assert score_toxicity(nothing, empty).count() == 0
    assert score_toxicity(docs.limit(3), empty).count() == 3


@tables
def test_language(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = fit_languages(docs.where(even))
    rows = identify_languages(docs.where(~even), model).toPandas()
    assert (rows["lang"] == rows["_lang"]).mean() > 0.97
    odd = {r["doc_id"]: r for r in identify_languages(awkward, model).collect()}
    assert all(odd[i]["__lang"] == "und" and odd[i]["__score"] == 0 for i in (4, 5, 6, 12)) and odd[8]["__lang"] in model.languages
    assert odd[8]["_lang"] == odd[8]["_rejected"] == "x" and odd[8]["__rejected"] in (True, False)
    none = fit_languages(nothing)
    assert {r["__lang"] for r in identify_languages(awkward, none).collect()} == {"und"}


@tables
def test_quality(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    models = fit_quality(docs.where(even), labels.where(even))
    rows = score_quality(docs.where(~even), models).join(labels, "doc_id").toPandas()
    assert ((rows["_score"] >= 0.5) == (rows["quality"] == 1)).mean() > 0.93
    assert score_quality(awkward, models).where("__score BETWEEN 0 AND 1 AND _content = 'x' AND __content >= 0").count() == awkward.count()
    none = fit_quality(nothing, labels.limit(0))
    assert {r["__score"] for r in score_quality(awkward, none).collect()} == {0.5}


def test_quality_pool_names_the_surest_of_all(spark):
    """Against brute force over every unlabelled document; nothing is named twice, copies count once."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "DELTA!", "x1"], rng.integers(1, 40))) for _ in range(300)]
    texts += [texts[0]] * 100 + ["", None]
    rows = [(i, i, content_view(t).astype(np.float16).tobytes(), metadata_view(t, "en", "a").astype(np.float16).tobytes()) for i, t in enumerate(texts)]
    rows = [(r[0], 0 if 300 <= r[1] < 400 else r[1], *r[2:]) for r in rows]
    seen = spark.createDataFrame(rows, "id long, h long, content binary, meta binary")
    labelled = spark.createDataFrame([(i,) for i in range(1, 60)], "id long")
    models = [View(rng.standard_normal(n) * 9, 0.1) for n in (CONTENT, META)]
    pool = Pool(seen, labelled, 7, 3)
    odds = {h: [models[k].raw(np.frombuffer(r[2 + k], np.float16).astype(np.float32)) for k in (0, 1)] for r in rows for h in [r[1]] if not 1 <= r[0] < 60}
    taken = set()
    for _ in range(3):
        want = [[], []]
        for one in (0, 1):
            for label, sign in ((1.0, 1), (0.0, -1)):
                best = sorted((-sign * z[one], h) for h, z in odds.items() if h not in taken and sign * z[one] >= np.log(CONFIDENT / (1 - CONFIDENT)))[:7]
                taken |= {h for _, h in best}
                want[one] += [(h, label) for _, h in best]
        assert pool.surest(models) == want and want[0] and want[1]
    (views, label), _ = Pool(seen, labelled, 7, 3)(models)
    assert views[0].shape == (len(label), CONTENT) and views[1].shape == (len(label), META) and set(label) == {0.0, 1.0}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 8)).astype(np.float32)
    vectors[100:160] = vectors[5]  # many copies of one vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(900, None, "x"), (901, [0.0] * 8, "x"), (950, [float("nan")] * 8, "x"), (1000, [None] * 8, "x"), (None, [1.0] * 8, "x"), (1050, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = nearest_neighbours(df, F.col("vec_id") % 50 == 0, 5).toPandas().sort_values(["query_id", "rank"])
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 400, 50):
        cos = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(400), -cos.round(12))) if i != q][:5]
        mine = got[got["query_id"] == q]
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine["score"], cos[mine["vec_id"]], atol=1e-12)
        hits += len(set(order) & set(mine["vec_id"]))
    assert hits >= 0.9 * 40 and set(got["query_id"]) == set(range(0, 400, 50))
    assert got[got["query_id"] == 100]["vec_id"].tolist() == [5, 101, 102, 103, 104]
    few = nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0, 5)
    assert few.count() == 2 and nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0

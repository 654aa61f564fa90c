"""Mixed buckets of one large group are searched once for each key, with the same links."""

import random

from pyspark.sql import functions as F

from tidemark.llm import near_dedup as N


def test_buckets_of_one_key_are_one_cell(spark):
    """Buckets of half 1 hold nearly the same 40 nodes each; those of half 2 have few nodes in common."""
    rows = [(10 + b, 1, (0, b), n, n % 2) for b in range(8) for n in range(40) if n != b]
    rows += [(30 + b, 2, (1, b), 100 + 3 * b + i, i) for b in range(8) for i in range(3)]
    named = spark.createDataFrame(rows, "bucket long, half long, at struct<a: int, b: int>, node long, comp long")
    once = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min("half").alias("h"))
    got = N._cells(named, once).collect()
    assert len(got) == 40 + 24
    assert sorted(r.node for r in got if r.at.b is None) == list(range(40)) and {r.n for r in got if r.at.b is None} == {40}
    assert sorted((r.bucket, r.node, r.n) for r in got if r.at.b is not None) == sorted((b, n, 3) for b, h, _, n, _ in rows if h == 2)


def test_group_around_the_threshold_like_brute_force(spark):
    """Variants of one text whose similarities lie on both sides of the threshold: several components in one bucket."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(140):
        words = list(base)
        for at in draw.sample(range(150), draw.choice((2, 3, 5, 6))):
            words[at] = f"v{k % 70}x{draw.randrange(4)}"
        texts.append(" ".join(words))
    sets = [set(N.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expected = {i: find(i) for i in range(len(sets))}
    assert 1 < len(set(expected.values())) < len(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == expected

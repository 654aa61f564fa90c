"""A group that the first check joins is not laid out by tables; links between components are still found."""

from pyspark.sql import functions as F

from tidemark.llm import near_dedup as N


def test_joined_group_has_no_table_rows(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, *(["end"] * (k % 2)), f"x{k}"]) for k in range(60)] + [f"quite another text {k} of its own" for k in range(5)]
    sizes, plain = {}, N.staged

    def staged(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(N, "staged", staged)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(65)}
    assert sizes["halves"] >= 60 and sizes["mixed-keys"] == 0


def test_chains_and_further_links(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "x long, y long")
    comps = N._rooted(pairs([(i, i - 1) for i in range(1, 30)] + [(41, 40), (51, 50)]))
    assert {r.node: r.comp for r in comps.collect()} == {i: 0 for i in range(1, 30)} | {41: 40, 51: 50}
    joined = N._joined(comps, pairs([(51, 41), (60, 61), (29, 3)]))
    assert {r.node: r.comp for r in joined.collect()} == {i: 0 for i in range(1, 30)} | {41: 40, 50: 40, 51: 40, 61: 60}
    assert joined.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

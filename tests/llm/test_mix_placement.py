"""The pipeline's mix follows the splitting tree and the local shuffle."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from corpus_pipeline import mix_sources
from tidemark.llm.mixing import BLOCK_BITS, mix_documents, split_quotas


def corpus(spark):
    source = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"), source.alias("source"))


def test_pipeline_follows_the_placement(spark):
    docs = corpus(spark).coalesce(1)
    mixed = mix_documents(docs, cut=False).collect()
    out = mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    parts = [[r["doc_id"] for r in p] for p in out.rdd.glom().collect()]
    assert Counter(i for p in parts for i in p) == Counter(r["doc_id"] for r in mixed)
    assert max(Counter(r["doc_id"] for r in mixed).values()) == 2
    assert all(a != b for p in parts for a, b in zip(p, p[1:]))  # copies are apart
    # each partition is a run of the rows in the order of (shard, place)
    at = {}
    for r in mixed:
        at.setdefault(r["doc_id"], []).append((r["mix_shard"], r["mix_order"]))
    for p in parts:
        last = (-1, 0)
        for i in p:
            last = min(x for x in at[i] if x > last)


def test_shard_loads_follow_the_quotas(spark):
    docs = corpus(spark).withColumn("source", F.lit("b"))
    mixed = mix_documents(docs, cut=False, share=2.0)  # two whole passes over all blocks
    load = Counter(r["mix_shard"] for r in mixed.collect())
    blocks = 1 << BLOCK_BITS
    spans = split_quotas(spark.createDataFrame([("b", 2 * blocks)], "source string, quota int"), 8).collect()
    shard = {draw: r["shard"] for r in spans for draw in range(r["first"], r["last"])}
    block = [int(hashlib.md5(str(i).encode()).hexdigest()[:2], 16) for i in range(6000)]
    assert load == Counter(shard[k * blocks + b] for k in (0, 1) for b in block)

"""Sharding, mixing and exact deduplication against direct computation."""

import bisect
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_groups, keep_one_copy
from tidemark.llm.mixing import mix_documents, plan_mix, source_targets, split_quotas
from tidemark.llm.sharding import cut_hashes, cut_positions, shard_documents, smallest_capacity

tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")


def size(text):
    return len((text or "").encode()) + 1


def needed(sizes, cap):
    n, load = 1, 0
    for s in sizes:
        n, load = (n, load + s) if load + s <= cap else (n + 1, s)
    return n


def lowest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(sizes, mid) <= shards else (mid + 1, high)
    return low


def test_smallest_capacity_is_minimal(spark):
    for sizes, shards in (([5, 1, 9, 3, 3, 7], 3), ([4], 8), ([1] * 40, 8), ([100, 1, 1, 1], 2)):
        df = spark.createDataFrame([(sizes,)], "s array<long>").withColumn("c", smallest_capacity(F.col("s"), shards))
        cap = df.first()["c"]
        lowest = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(sizes, c) <= shards)
        assert cap == lowest
        cuts = spark.createDataFrame([(sizes, cap)], "s array<long>, c long").select(cut_positions(F.col("s"), F.col("c"))).first()[0]
        assert len(cuts) == needed(sizes, cap) - 1


def test_capacity_is_minimal_over_groups(spark):
    """Many groups per run, against a binary search over all groups in their order."""
    rng = np.random.default_rng(4)
    whole = rng.integers(-(2**63), 2**63 - 1, 3000)
    narrow = np.concatenate([rng.integers(0, 2**34, 700), rng.integers(-(2**20), 0, 300), [-(2**63), 2**63 - 1]])
    plain, skewed = rng.integers(1, 6000, 3000), (rng.pareto(1.0, 3000) * 900 + 1).astype(int)
    hot = plain.copy()
    hot[1234] = plain.sum() // 2  # one text holds a third of all
    two = plain.copy()
    two[[10, 2000]] = plain.sum() // 3
    few = np.array([3, 1, 2])
    for hashes, sizes in ((whole, plain), (whole, skewed), (whole, hot), (narrow, plain[: len(narrow)]), (narrow, two[: len(narrow)]), (whole[:3], few)):
        groups = dict(zip(hashes.tolist(), sizes.tolist(), strict=True))
        df = spark.createDataFrame(list(groups.items()), "h long, bytes long")
        cuts = cut_hashes(df, 8)
        loads = Counter()
        for h, n in groups.items():
            loads[bisect.bisect_right(cuts, h)] += n
        assert len(cuts) < 8 and cuts == sorted(set(cuts))
        assert max(loads.values()) == lowest_capacity([groups[h] for h in sorted(groups)], 8)


@tables
def test_query_shards_are_minimal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = shard_documents(docs).join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id").toPandas()
    groups = rows.groupby("h").agg(size=("size", "sum"), shards=("shard", "nunique")).sort_index()
    assert (groups["shards"] == 1).all()
    assert rows.groupby("shard")["size"].sum().max() == lowest_capacity(groups["size"].tolist(), 8)


def test_shards(awkward, nothing):
    rows = shard_documents(awkward).toPandas()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    known = rows[rows["doc_id"].notna()]
    assert all(size(texts[i]) == n for i, n in zip(known["doc_id"], known["size"], strict=True))
    assert all(zlib.crc32((texts[i] or "").encode()) == c for i, c in zip(known["doc_id"], known["text_crc32"], strict=True))
    assert rows.groupby("text_crc32")["shard"].nunique().max() == 1
    assert shard_documents(nothing).count() == 0


def test_targets_fill_by_weight(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    # weights 3, 1, 2, 3; a, c and null stop at twice their size, b takes the rest of 1.5 * 1070
    assert got == {"a": 20.0, "c": 20.0, None: 100.0, "b": 1605.0 - 140}


def test_quotas_are_kept(spark):
    quotas = spark.createDataFrame([("a", 37), ("b", 256), (None, 1)], "source string, quota int")
    rows = split_quotas(quotas, 8).toPandas()
    assert dict(rows.groupby("source", dropna=False).apply(lambda g: (g["last"] - g["first"]).sum(), include_groups=False).fillna(0)) != {}
    assert (rows["last"] - rows["first"]).sum() == 294
    loads = rows.assign(n=rows["last"] - rows["first"]).groupby("shard")["n"].sum()
    assert loads.max() - loads.min() <= 1


def test_mix(awkward, nothing):
    plan = plan_mix(awkward, carry=["text"]).toPandas()
    assert len(plan) == awkward.count() and (plan["taken"] <= 2 * plan["size"]).all()
    assert all(len(s) == c for s, c in zip(plan["shards"], plan["copies"], strict=True))
    per = plan.groupby("target").agg(taken=("taken", "sum"), size=("source_size", "first"))
    assert ((per.index - per["taken"]).abs() <= 1).sum() >= len(per) - 1  # repeated rows are not cut
    mixed = mix_documents(awkward)
    assert mixed.columns == [*awkward.columns, "_mix_shard", "_mix_order"]
    assert mixed.count() == plan["copies"].sum()
    assert plan_mix(nothing).count() == 0 and mix_documents(nothing).count() == 0


def test_exact_groups(awkward, nothing):
    def norm(t):
        return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")

    rows = awkward.collect()
    for digest in (None, lambda c: F.substring(F.sha2(c, 256), 1, 1)):  # the second one collides
        got = exact_groups(awkward, **({"digest": digest} if digest else {})).toPandas()
        assert len(got) == len(rows)
        groups = {}
        for r in rows:
            groups.setdefault(norm(r["text"]), []).append(r)
        assert got["kept"].sum() == len(groups)
        by_id = {i: (k, n) for i, k, n in zip(got["doc_id"], got["keep_id"], got["group_size"], strict=True)}
        for members in groups.values():
            ids = [m for m in members if m["doc_id"] is not None]
            if ids:
                best = max(ids, key=lambda m: (len(m["text"] or ""), -m["doc_id"]))["doc_id"]
                longest = max(len(m["text"] or "") for m in members)
                if len(next(m for m in ids if m["doc_id"] == best)["text"] or "") == longest:
                    assert all(by_id[m["doc_id"]] == (best, len(members)) for m in ids)
    kept = keep_one_copy(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({norm(r["text"]) for r in rows})
    assert exact_groups(nothing).count() == 0

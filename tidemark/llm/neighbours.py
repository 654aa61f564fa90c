"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree halves the vectors level by level at the median of a random projection. A query
walks all trees with one shared priority queue, nearest split first, until it has named
``PROBES`` leaves; the members of those leaves are reranked by exact cosine in double
precision. Splits are fitted on a bounded sample; every vector is indexed. Equal vectors are
indexed once with their smallest ids, which is all that a result can show of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors that the splits are fitted on, at most. More vectors need a larger sample.
FIT_ROWS = 20_000
TREES = 16
#: Sample vectors in a leaf.
LEAF = 24
#: Leaves that a query names in all trees together.
PROBES = 400
#: Members of a leaf that are compared in one task at most, on average.
BLOCK = 4096


class Forest:
    """Trees of equal depth: one direction per tree and level, one threshold per node.

    The directions of a tree are at right angles, so the squared distances to the splits that
    separate a query from a leaf add up to its squared distance from the leaf.
    """

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3):
        n, dim = sample.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        rng = np.random.default_rng(seed)
        drawn = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(trees * -(-self.depth // dim))]
        self.directions = np.concatenate(drawn or [np.zeros((0, dim))]).reshape(trees, -1, dim)[:, : self.depth].astype(np.float32)
        self.thresholds = np.zeros((trees, max(1, 1 << self.depth)), np.float32)  # heap order, root at 1
        self.trees = trees
        along = self.project(sample)
        for t in range(trees):
            node = np.ones(n, np.int64)
            for level in range(self.depth):
                x = along[:, t, level]
                order = np.lexsort((x, node))
                ends = np.flatnonzero(np.diff(node[order])) + 1
                for part in np.split(order, ends):
                    self.thresholds[t, node[part[0]]] = x[part[len(part) // 2]]
                node = 2 * node + (x >= self.thresholds[t, node])

    def project(self, vectors: np.ndarray) -> np.ndarray:
        flat = self.directions.reshape(self.trees * self.depth, vectors.shape[1])
        return (vectors.astype(np.float32) @ flat.T).reshape(len(vectors), self.trees, self.depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree; numbers are unique over trees."""
        along = self.project(vectors)
        node = np.ones((len(vectors), self.trees), np.int64)
        t = np.arange(self.trees)[None, :]
        for level in range(self.depth):
            node = 2 * node + (along[:, :, level] >= self.thresholds[t, node])
        return node + (t.astype(np.int64) << 32)

    def probe(self, along: np.ndarray, probes: int) -> list[int]:
        """Leaves of one query (its projections), best first over all trees."""
        queue = [(0.0, t, 1, 0) for t in range(self.trees)]
        found: list[int] = []
        while queue and len(found) < probes:
            far, t, node, level = heapq.heappop(queue)
            while level < self.depth:
                margin = float(along[t, level] - self.thresholds[t, node])
                near = 2 * node + (margin >= 0)
                heapq.heappush(queue, (far + margin * margin, t, near ^ 1, level + 1))
                node, level = near, level + 1
            found.append(node + (t << 32))
        return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector, asks -> with a 128-bit key of the vector's numbers."""
    for batch in batches:
        rows = _matrix(batch.column(1)).astype(np.float64) + 0.0  # one kind of zero
        keys = pa.array([xxhash.xxh3_128_hexdigest(r.tobytes()) for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), keys, batch.column(2), batch.column(1)], ["vec_id", "key", "asks", "vector"])


#: Neighbouring leaves of a tree that are compared in one group, as a power of two.
SIBLINGS = 4


def _router(forest: Forest):
    """id, vector -> a row for the leaf of every tree."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(_matrix(batch.column(1)))
            yield _spread(batch, leaves.ravel(), np.repeat(np.arange(len(leaves)), forest.trees))

    return route


def _prober(forest: Forest, probes: int):
    """id, vector -> a row for every leaf that the query names."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [forest.probe(a, probes) for a in forest.project(_matrix(batch.column(1)))]
            leaves = np.array([x for one in named for x in one], np.int64)
            yield _spread(batch, leaves, np.repeat(np.arange(len(named)), [len(x) for x in named]))

    return probe


def _spread(batch: pa.RecordBatch, leaves: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "id", "vector"])


def _ranker(keep: int):
    """Queries and members of a few sibling leaves -> the nearest members of every query."""

    def rank(queries: pa.Table, members: pa.Table) -> pa.Table:
        (ql, qid, q), (ml, mid, m) = (
            (x["leaf"].to_numpy(), x["id"].to_numpy(), _matrix(x["vector"]).astype(np.float64)) for x in (queries, members)
        )
        asks, found, scores = [], [], []
        for leaf in np.intersect1d(ql, ml):
            a, b = np.flatnonzero(ql == leaf), np.flatnonzero(ml == leaf)
            qn, mn = np.sqrt((q[a] * q[a]).sum(axis=1)), np.sqrt((m[b] * m[b]).sum(axis=1))
            rough = (q[a] / qn[:, None]) @ (m[b] / mn[:, None]).T
            n = min(keep + 2, len(b))
            best = np.argpartition(-rough, n - 1, axis=1)[:, :n]
            i, j = np.repeat(np.arange(len(a)), n), best.ravel()
            # summed alike wherever the pair is met, so that its score is the same everywhere
            scores.append((q[a[i]] * m[b[j]]).sum(axis=1) / (qn[i] * mn[j]))
            asks.append(qid[a[i]])
            found.append(mid[b[j]])
        ask, near, score = (np.concatenate(x) if x else np.empty(0) for x in (asks, found, scores))
        order = np.lexsort((near, -score, ask))
        ask, near, score = ask[order], near[order], score[order]
        first = np.searchsorted(ask, ask, "left") if len(ask) else np.empty(0, np.int64)
        top = np.arange(len(ask)) - first < keep
        return pa.table({"asked": ask[top].astype(np.int64), "id": near[top].astype(np.int64), "score": score[top].astype(np.float64)})

    return rank


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 5, *, vec_id: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The ``k`` nearest other rows of every query row: query_id, rank, vec_id, score.

    ``is_query`` may use the id column. Vectors that are null, empty, zero or hold null or
    non-finite numbers take no part, nor do rows without an id or with another length than
    most. Ties go to the smaller id; rows that share an id are the same row to each other.
    An empty table gives no rows.
    """
    real = vectors.schema[vector].dataType.elementType.typeName()
    kind = real if real == "float" else "double"
    number = F.transform(F.col(vector), lambda x: x.cast(kind))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), number.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    rows = rows.where(F.size("vector") == dim)
    keyed = rows.mapInArrow(_keyed, f"vec_id long, key string, asks boolean, vector array<{kind}>")
    first = Window.partitionBy("key").orderBy("vec_id")
    few = keyed.drop("asks").withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)  # limited before the shuffle, too
    distinct = few.groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    distinct = staged(distinct.withColumn("id", F.element_at("ids", 1)), "vectors")  # a vector goes by its smallest id
    asking = keyed.where("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("k")).distinct()
    queries = staged(asking.join(distinct, asking["k"] == distinct["key"]).select("query_id", F.col("id").alias("asked")), "vector-queries")
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(fit_rows).select("vector").toArrow()
    forest = Forest(_matrix(sample["vector"]) if len(sample) else np.zeros((0, dim)), trees, leaf)

    schema = f"leaf long, id long, vector array<{kind}>"
    members = distinct.select("id", "vector").mapInArrow(_router(forest), schema)
    wanted = distinct.join(queries.select(F.col("asked").alias("id")).distinct(), "id", "left_semi").select("id", "vector")
    asked = wanted.mapInArrow(_prober(forest, probes), schema)
    sizes = members.groupBy("leaf").agg(F.count("*").alias("n"))
    sizes = staged(sizes.select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "leaf-blocks")
    part = F.shiftright("leaf", SIBLINGS).alias("part")
    members = members.join(sizes, "leaf").select(part, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "leaf", "id", "vector")
    asked = asked.join(sizes, "leaf").select(part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "leaf", "id", "vector")
    near = (
        asked.groupBy("part", "block").cogroup(members.groupBy("part", "block"))
        .applyInArrow(_ranker(k + 1), "asked long, id long, score double").distinct()
    )
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    top = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    top = staged(top.join(distinct.select("id", "ids"), "id").select("asked", "score", F.explode("ids").alias("vec_id")), "nearest")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(top, "asked").where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

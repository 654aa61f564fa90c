"""Near-duplicate detection by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Two small collections of
``m`` keys are computed per document, each key from ``ROWS`` minhashes; the ``m * m`` tables
of the banding are keyed by the pairs (a_i, b_j), so ``2 * m * ROWS`` minhashes serve tables
that would take ``2 * m * m * ROWS``. A pair of similarity s meets in some table with
probability ``(1 - (1 - s**ROWS)**m)**2``; ``m`` is chosen so that it is missed at the
threshold at most once in ten thousand cases.

Documents with equal sets are one node. First every node is checked against one other: of the
smallest nodes of its single keys, the one that it meets in most tables. Only keys that nodes of
several components share are then paired into tables, so a group that the first check has joined
is laid out by its keys alone. Buckets that hold several components are searched in blocks,
by a sketch of their sets. The tables that share a key of the
first collection are searched as one where that compares no more pairs, so a large group is
laid out once for each of ``m`` keys, not for each of ``m * m`` tables. Every link is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Minhashes in a key of a collection; a table key has twice as many.
ROWS = 4
MISSED = 1e-4
#: Ranges of hashes in a sketch, a power of two.
BINS = 512
#: Nodes of one bucket that are compared in one task.
BLOCK = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles, A-Z in lower case.

    A text with fewer words has its whole sequence as the only shingle; one without words
    has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i, c in enumerate(_odd(size, 11)):
        total += h[i : i + n] * c
    return np.unique(_mixed(total))


def collections_per_side(percent: int) -> int:
    """Keys per collection for a similarity threshold in percent."""
    return math.ceil(math.log(MISSED / 2) / math.log(1 - (percent / 100) ** ROWS))


def _signer(size: int, m: int):
    """Arrow map: doc_id, text -> doc_id, n_shingles, set_id, keys (both collections), sketch.

    The sketch is one byte of the smallest hash in each of ``BINS`` equal ranges, 0 if there is none.
    """
    hashes = _odd(2 * m * ROWS, 5)[:, None]
    weights, salt = _odd(ROWS, 7), _odd(2 * m, 9)

    def keys(s: np.ndarray) -> np.ndarray:
        least = np.full(2 * m * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 4096):
            np.minimum(least, (hashes * s[None, at : at + 4096]).min(axis=1), out=least)
        return _mixed((_mixed(least).reshape(2 * m, ROWS) * weights).sum(axis=1, dtype=np.uint64) + salt).view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, all_keys, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                all_keys.append(keys(s) if len(s) else np.empty(0, np.int64))
                sketches.append(bin_sketch(s) if len(s) else None)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in all_keys])]).astype(np.int32)
            flat = np.concatenate(all_keys) if all_keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), lists, pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "keys", "sketch"],
            )

    return sign


def _confirmer(size: int, percent: int):
    """Arrow map: x, y, text_x, text_y -> x, y of the pairs whose full sets are similar."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[1] is None or last[0] != y:
                    last = (y, shingle_set(y, size))  # rows come ordered by y
                a, b = shingle_set(x, size), last[1]
                both = np.intersect1d(a, b, assume_unique=True).size
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def bin_sketch(s: np.ndarray) -> bytes:
    """One-permutation sketch of a sorted set of hashes."""
    bins = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = _mixed(s[first]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def possibly_similar(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches a pair at the threshold would show but for a few cases in a million.

    The share of equal bins estimates the similarity j; with u bins in use and f hashes in the
    union its variance is j (1 - j) ((1 / u) (1 + 1 / (f - 1)) - 1 / (f - 1)).
    """
    j = percent / 100
    used = ((others | one) != 0).sum(axis=1)
    equal = ((others == one) & (others != 0)).sum(axis=1)
    union = np.maximum((n_one + n_others) / (1 + j), 2.0)
    variance = j * (1 - j) * np.maximum((1 + 1 / (union - 1)) / np.maximum(used, 1) - 1 / (union - 1), 0)
    return equal >= used * (j - 4.4 * np.sqrt(variance)) - 1


def _agreeing(percent: int, m: int):
    """Grouped Arrow map over one block pair of a cell: likely pairs across components.

    A cell is a bucket, or all nodes of the buckets that share a key of the first collection (its
    ``at_b`` is null). A pair that meets in several cells is named in the first of them only.
    """

    def find(table: pa.Table) -> pa.Table:
        node, comp, sizes = table["node"].to_numpy(), table["comp"].to_numpy(), table["n_shingles"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        first_a, first_b = table["at_a"][0].as_py(), table["at_b"][0].as_py()
        block, (i, j) = table["block"].to_numpy(), (table["bi"][0].as_py(), table["bj"][0].as_py())
        xs, ys = [], []
        right = np.flatnonzero(block == j)
        for r in np.flatnonzero(block == i):
            near = right[(comp[right] != comp[r]) & ((node[right] > node[r]) if i == j else True)]
            near = near[possibly_similar(sketch[r], sketch[near], sizes[r], sizes[near], percent)]
            shared = keys[near] == keys[r]
            apart = shared[:, m:].any(axis=1) if first_b is None else ~shared[:, m : m + first_b].any(axis=1)
            hit = near[~shared[:, :first_a].any(axis=1) & apart]
            xs.append(np.full(len(hit), node[r]))
            ys.append(node[hit])
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
        return pa.table({"x": np.maximum(x, y), "y": np.minimum(x, y)})

    return find


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links x, y: node, comp (smallest node), by star contraction.

    Large stars hang the larger neighbours of every node on its smallest one, small stars the
    smaller ones; every round is written to the shared folder. A node with very many links is
    a skewed join key, which adaptive execution splits.
    """
    edges = staged(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        hung = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = staged(hung.union(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct(), "stars")
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))


def _rooted(links: DataFrame) -> DataFrame:
    """Components of links that lead from every node x to one smaller node y at most: node, comp.

    Every round replaces y by where y leads, so a chain is half as long after it.
    """
    edges = links.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    while True:
        ahead = edges.select(F.col("node").alias("at"), F.col("comp").alias("next"))
        edges = staged(
            edges.join(ahead, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        moved, edges = edges.where("moved"), edges.select("node", "comp")
        if moved.isEmpty():
            return edges


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links; only the components that these join are contracted."""
    x = comps.select(F.col("node").alias("x"), F.col("comp").alias("cx"))
    y = comps.select(F.col("node").alias("y"), F.col("comp").alias("cy"))
    between = links.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    more = components(between)
    over = more.select(F.col("node").alias("old"), F.col("comp").alias("new"))
    # the smallest node of a component has no row in comps
    return comps.join(over, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")).union(more)


def _in_comps(rows: DataFrame, comps: DataFrame, of: str) -> DataFrame:
    """Rows with the component of their column ``of`` in ``comp``."""
    c = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return rows.join(c, F.col(of) == F.col("_node"), "left").withColumn("comp", F.coalesce("_comp", of)).drop("_node", "_comp")


def _first_links(m: int):
    """Of the nodes ``pivot`` in the list ``held``, the one met in most tables (the smallest of equals): a struct of n and minus."""
    met = lambda p, low: F.size(F.filter("held", lambda h: (h["pivot"] == p) & ((h["pos"] < m) if low else (h["pos"] >= m))))
    others = F.array_except(F.array_distinct("held.pivot"), F.array("node"))
    return F.array_max(F.transform(others, lambda p: F.struct((met(p, True) * met(p, False)).alias("n"), (-p).alias("minus"))))


def _cells(named: DataFrame, once: DataFrame) -> DataFrame:
    """The nodes to compare: bucket, at, node, comp and n, the cell's number of nodes.

    Mixed buckets that share their ``half`` become one cell where its pairs are no more than theirs
    together; ``at`` then has no second place. The others are cells of their own.
    """
    # a node once for each half that has mixed buckets; a table row meets its bucket only where the half stays apart
    by_half = staged(
        named.join(once.select("h").distinct(), F.col("half") == F.col("h"), "left_semi").groupBy("half", "node").agg(F.min("comp").alias("comp"), F.min("at.a").alias("a")),
        "mixed-halves",
    )
    size = by_half.groupBy(F.col("half").alias("h")).agg(F.count("*").alias("all"))
    pairs = once.groupBy("h").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    merged = size.join(pairs, "h").where(F.col("all").cast("double") * F.col("all") <= F.col("pairs")).select("h", "all")
    none = F.lit(None).cast("int")
    whole = by_half.join(merged, by_half["half"] == merged["h"]).select(
        F.col("half").alias("bucket"), F.struct("a", none.alias("b")).alias("at"), "node", "comp", F.col("all").alias("n"),
    )
    others = once.join(merged.select("h"), "h", "left_anti").select("bucket", F.col("at").alias("first"), "n")
    alone = named.join(merged.select("h"), F.col("half") == F.col("h"), "left_anti").join(others, "bucket")
    return whole.unionByName(alone.select("bucket", F.col("first").alias("at"), "node", "comp", "n"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles, component_id and kept, one row per row.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` of their shingle
    sets; component_id is the smallest id reachable over links. Documents without words are
    linked with nothing. Rows that share an id count as one document; rows without an id are
    not linked and are kept, with a null component. Other columns are not read.
    """
    m = collections_per_side(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = staged(
        rows.mapInArrow(_signer(words, m), "doc_id long, n_shingles long, set_id string, keys array<long>, sketch binary"), "minhash",
    )
    with_set = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    heads = with_set.groupBy("set_id").agg(F.min("doc_id").alias("node")).withColumnRenamed("set_id", "s")
    head = F.col("doc_id") == F.col("node")
    sets = staged(
        signed.join(heads, F.col("set_id") == F.col("s"), "left").select(
            "doc_id", "n_shingles", F.col("set_id").isNull().alias("empty"), "node", F.when(head, F.col("keys")).alias("keys"), F.when(head, F.col("sketch")).alias("sketch"),
        ), "sets",
    )
    nodes = sets.where("doc_id = node").select("node", "keys", "sketch", "n_shingles")

    # keys of a collection that no other node has cannot be half of a shared table key
    single = nodes.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("key", "pivot")
    held = single.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("pos", "key", "pivot")).alias("held"))
    both_sides = F.exists("held", lambda h: h["pos"] < m) & F.exists("held", lambda h: h["pos"] >= m)
    held = held.where(both_sides).withColumn("best", _first_links(m))
    halves = staged(held.select("node", "held", F.when(F.col("best.n") > 0, -F.col("best.minus")).alias("first")), "halves")

    # the texts of all candidates; merged at every size, as the list of candidates grows with the input
    involved = halves.select("node")
    texts = staged(rows.join(involved.hint("merge"), rows["doc_id"] == involved["node"]).select("node", "text").dropDuplicates(["node"]), "candidate-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
        right = texts.select(F.col("node").alias("y"), F.col("text").alias("text_y"))
        whole = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "text_x", "text_y")
        return staged(whole.mapInArrow(_confirmer(words, percent), "x long, y long"), "confirmed")

    first = halves.where("first IS NOT NULL").select(F.col("node").alias("x"), F.col("first").alias("y"))
    comps = _rooted(confirmed(first))

    # what is left to find lies between components, in tables of which both keys are shared by several of them
    keyed = _in_comps(halves, comps, "node").select("node", "comp", F.inline("held"))
    mixed = keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = keyed.join(mixed, "key").groupBy("node", "comp").agg(
        F.collect_list(F.when(F.col("pos") < m, F.struct("pos", "key"))).alias("a"),
        F.collect_list(F.when(F.col("pos") >= m, F.struct((F.col("pos") - m).alias("pos"), "key"))).alias("b"),
    )
    left = staged(left.where("size(a) > 0 AND size(b) > 0"), "mixed-keys")

    tables = left.select("node", "comp", F.explode("a").alias("a"), "b").select("node", "comp", "a", F.explode("b").alias("b"))
    # buckets that hold several components
    named = tables.select(
        F.xxhash64("a.key", "b.key").alias("bucket"), F.col("a.key").alias("half"), F.struct(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).alias("at"), "node", "comp",
    )
    still = named.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("at").alias("at"), F.min("half").alias("half"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
    ).where("lo <> hi")
    # of buckets with the same nodes, the first
    once = staged(
        still.groupBy("n", "members").agg(F.min(F.struct("at", "bucket", "half")).alias("b")).select("n", "b.at", "b.bucket", F.col("b.half").alias("h")), "mixed-buckets",
    )
    if not once.isEmpty():
        cells = _cells(named, once)
        n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        placed = cells.withColumn("nb", n_blocks).join(nodes, "node")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        placed = placed.select("bucket", F.col("at.a").alias("at_a"), F.col("at.b").alias("at_b"), "node", "comp", "keys", "sketch", "n_shingles", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        likely = staged(placed.groupBy("bucket", "bi", "bj").applyInArrow(_agreeing(percent, m), "x long, y long"), "mixed-candidates")
        if not likely.isEmpty():
            more = confirmed(likely)
            if not more.isEmpty():
                comps = _joined(comps, more)

    out = _in_comps(sets, comps, "node")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("comp")))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each near-duplicate class."""
    dropped = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("NOT kept").select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped.distinct(), F.col(doc_id).cast("long") == F.col("_dropped"), "left_anti")

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into ``2**BLOCK_BITS`` blocks by the md5 of the document id, a fixed random
permutation. A source's quota is the number of blocks that its target draws: whole passes over
all of its blocks, then a prefix of the permuted blocks, whose last one may be drawn in part.
The tree splits the quotas of all sources among the output shards: at each node the blocks are
balls in an urn from which half are drawn without replacement, so the split is multivariate
hypergeometric and every quota is kept exactly. Shards then take disjoint runs of each source's
permuted blocks, and a document's place inside its shard is a hash (local shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, word_count, unused

#: Bits of the permutation that name a block; a source has 2**8 blocks.
BLOCK_BITS = 8
#: Hex digits after the block's by which the last block of a source is drawn in part.
CELL_DIGITS = 3
#: A shard's local shuffle is cut into 2**10 slices, each of which is sorted by one task.
SLICE_BITS = 10
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Words that each source gives: source, source_size, target.

    Sources in code-point order (null last) get the weights in turn and split ``share`` of
    all sizes; a source stops at ``most`` times its size and its excess goes to the others by
    weight. Water filling: sources sorted by size per weight fill up first.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy(F.lit(0))  # one row per source
    rank = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    by_fill = everywhere.orderBy("fill", F.col("source").asc_nulls_last())
    upto, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(upto), F.lit(0))
    level = rest / F.sum("weight").over(after)  # per unit of weight, if the sources before are full
    return (
        sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("level", level).withColumn("at", F.row_number().over(by_fill))
        # the first source that its level does not fill fixes the level of all after it
        .withColumn("fixed", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("at", "level"))).over(everywhere)["level"])
        .withColumn("target", F.least(F.col("most").cast("double"), F.coalesce("fixed", "level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Splits block quotas (source, quota) among shards: source, shard, first, last.

    Each level of the tree draws half of a node's balls; the shard takes the blocks
    ``first <= draw < last`` of the source's permuted sequence. ``shards`` is a power of two.
    """
    urn = quotas.select("source", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("ball")).withColumn("shard", F.lit(0))
    level = 1
    while level < shards:
        node = Window.partitionBy("shard")
        drawn = F.row_number().over(node.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit(level), F.col("source"), "ball")), F.col("source").asc_nulls_last(), "ball"))
        urn = urn.withColumn("right", (drawn > F.floor((F.count("*").over(node) + 1) / 2)).cast("int"))
        urn = urn.select("source", "ball", (F.col("shard") * 2 + F.col("right")).alias("shard"))
        level *= 2
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return (
        urn.groupBy("source", "shard").agg(F.count("*").alias("n"))
        .withColumn("last", ends).withColumn("first", F.col("last") - F.col("n")).drop("n")
    )


def _digits(at: int, n: int) -> Column:
    return F.conv(F.substring("perm", at, n), 16, 10).cast("long")


def plan_mix(
    docs: DataFrame, *, shards: int = 8, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, cut: bool = True,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: how many copies the mix takes and where each copy goes.

    Returns the ``carry`` columns, mix_id, size (words), source_size, target, taken (words,
    repeats counted), copies, shards (one per copy) and cut_words (words of the last copy, null
    if it is whole). A source takes its documents in the order of the md5 of their id, whole
    passes first. With ``cut`` the last document gives only the words that reach the target;
    else it is taken whole if that comes nearer. A null source is a source of its own; texts
    without words have size 0 and are taken with their block; repeated rows share one place
    in the order and are taken together, or not at all if they would have to be cut; an
    empty table gives no rows.
    """
    blocks = 1 << BLOCK_BITS
    rows = docs.select(
        *carry, F.col(doc_id).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"),
        word_count(text).alias("_size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_perm"),
    )
    # the plan needs no text: a narrow staged table is grouped instead of the documents
    slim = staged(
        rows.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_perm").alias("perm")),
        "mix-sizes",
    ).withColumn("block", _digits(1, 2)).withColumn("cell", _digits(3, CELL_DIGITS))
    targets = source_targets(slim, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    targets = (
        targets.withColumn("passes", passes.cast("int"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    targets = staged(targets, "mix-targets")  # this and the next have one row per source

    # the block in which the prefix of the last pass ends, then the cell inside that block
    by_block = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("block")
    by_block = by_block.withColumn("upto", F.sum("words").over(run))
    last_block = (
        _inner(by_block, targets.select("source", "rest")).where(F.col("upto") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("base"))).alias("e"))
        .select("source", F.col("e.block").alias("end_block"), F.col("e.base").alias("block_base"))
    )
    ends = staged(_left(targets, last_block), "mix-ends")
    in_last = _inner(slim, ends.where(F.col("end_block").isNotNull()).select("source", "end_block", "block_base", "rest"))
    in_last = in_last.where(F.col("block") == F.col("end_block"))
    by_cell = in_last.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("block_base").alias("base"), F.first("rest").alias("rest"))
    by_cell = by_cell.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
    last_cell = (
        by_cell.where(F.col("upto") > F.col("rest")).groupBy("source")
        .agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("base"))).alias("e"))
        .select("source", F.col("e.cell").alias("end_cell"), F.col("e.base").alias("cell_base"))
    )
    last_cell = staged(last_cell, "mix-cells")
    ends = _left(ends, last_cell)
    in_cell = _inner(in_last.select("source", "id", "size", "perm", "cell", "rest"), last_cell).where(F.col("cell") == F.col("end_cell"))
    one = in_cell.groupBy("source", "perm", "rest", "cell_base").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    base = F.col("cell_base") + F.sum("words").over(Window.partitionBy("source").orderBy("perm")) - F.col("words")
    left = F.floor(F.col("rest") - F.col("base"))
    part = left if cut else F.when(left * 2 >= F.col("words"), F.col("words")).otherwise(0)
    last_doc = (
        one.withColumn("base", base).where(F.col("base") + F.col("words") > F.col("rest")).groupBy("source")
        .agg(F.min(F.struct("perm", F.when(F.col("n") == 1, part).otherwise(0).cast("long").alias("part"))).alias("e"))
        .select("source", F.col("e.perm").alias("end_perm"), F.col("e.part").alias("end_part"))
    )
    ends = staged(_left(ends, last_doc), "mix-last")
    n_first = F.coalesce(F.col("end_block") + 1, F.lit(blocks))
    quota = (F.col("passes") * blocks + F.when(F.col("rest") > 0, n_first).otherwise(0)).cast("int")
    ends = ends.withColumn("quota", quota)
    runs = split_quotas(ends.where("quota > 0").select("source", "quota"), shards)
    spans = runs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("spans"))  # one per shard
    ends = staged(_left(ends, spans), "mix-plan")

    named = ends.select(F.col("source").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ends.columns if c != "source"])
    out = rows.join(named, F.col("_source").eqNullSafe(F.col("_key")), "left")
    before = (F.col("_rest") > 0) & (F.col("_end_perm").isNull() | (F.col("_perm") < F.col("_end_perm")))
    at_end = F.coalesce((F.col("_rest") > 0) & (F.col("_perm") == F.col("_end_perm")), F.lit(False))
    part = F.when(before, F.col("_size")).when(at_end, F.col("_end_part")).otherwise(0)
    more = before | (at_end & (F.col("_end_part") > 0))
    copies = F.least(F.col("_passes") + more.cast("int"), F.lit(most))
    block = F.conv(F.substring("_perm", 1, 2), 16, 10).cast("int")
    place = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.element_at(F.filter("_spans", lambda s: s["last"] > k * blocks + block), 1)["shard"],
    )
    return out.select(
        *carry, F.col("_id").alias("mix_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_passes") * F.col("_size") + part).cast("long").alias("taken"),
        copies.alias("copies"), place.alias("shards"), F.when(more & (part < F.col("_size")), part).alias("cut_words"),
    )


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row as often as the mix takes it.

    The last two columns, ``mix_shard`` and ``mix_order`` (see ``unused``), are the output shard
    and the place after the local shuffle.
    A text that is cut keeps its first words, joined by blanks.
    """
    whole = docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    plan = plan_mix(whole, carry=["_whole"], text=text, **options)
    rows = plan.select("_whole", "mix_id", "copies", "cut_words", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    cut = F.col("cut_words").isNotNull() & (F.col("mix_copy") == F.col("copies") - 1)
    words = F.regexp_extract_all(F.col("_whole")[text], F.lit(WORD), F.lit(0))
    shorter = F.concat_ws(" ", F.slice(words, F.lit(1), F.col("cut_words").cast("int")))
    columns = [
        F.when(cut, shorter).otherwise(F.col("_whole")[c]).alias(c) if c == text else F.col("_whole")[c].alias(c) for c in docs.columns
    ]
    order = F.xxhash64("mix_id", "mix_copy", "mix_shard", F.col("_whole")[text])
    return rows.select(*columns, F.col("mix_shard").alias(unused(docs, "mix_shard")), order.alias(unused(docs, "mix_order")))


def place_mix(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix_documents`` moved to their shard and place; its last two columns are dropped.

    A slice of a shard's shuffled order lies in one partition, in order; a partition may hold
    slices of several shards, one after the other.
    """
    shard, order = mixed.columns[-2:]
    piece = F.shiftright(order, 64 - SLICE_BITS)
    return mixed.repartition(shard, piece).sortWithinPartitions(shard, order).drop(shard, order)


def write_mix(mixed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write a mixed corpus by shard, each file in shuffled order."""
    shard, order = mixed.columns[-2:]
    part = F.pmod(F.col(order), F.lit(files_per_shard))
    mixed.repartition(shard, part).sortWithinPartitions(shard, order).drop(order).write.partitionBy(shard).parquet(path)


def _left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, nulls equal; one row per source on the right."""
    r = right.withColumnRenamed("source", "_key")
    return left.join(r, F.col("source").eqNullSafe(F.col("_key")), "left").drop("_key")


def _inner(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnRenamed("source", "_key")
    return left.join(r, F.col("source").eqNullSafe(F.col("_key"))).drop("_key")

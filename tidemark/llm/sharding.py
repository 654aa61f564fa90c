"""Sharding by minimax contiguous partition of ordered, atomic groups of equal texts.

The groups (equal texts) are put in the order of their text's hash. Their sizes are summed in runs
of neighbouring hashes, so that the list of sizes is one bounded row. The smallest capacity with
which a greedy walk over the list needs at most ``shards`` shards is found by binary search; the
cuts are those of the greedy walk at that capacity.

Runs in which a cut of the best partition over single groups may lie are split into finer runs,
until they are single groups. Two walks bound each cut: one at a capacity that cannot be undercut
even if runs were divisible, one with divisible runs at the capacity found. The capacity is
therefore minimal over the groups themselves, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Leading bits of the text hash that name a first run of groups; all run sizes are one row.
CELL_BITS = 14
#: Further bits that a split of a run looks at.
SPLIT_BITS = 8
#: Rows that are numbered in one window at most, on average.
BLOCK_ROWS = 20_000


def _needed(sizes: Column, capacity: Column) -> Column:
    """Shards that a greedy walk over the sizes opens at a capacity."""
    start = F.struct(F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("load"))
    return F.aggregate(
        sizes, start,
        lambda a, s: F.when(a["load"] + s <= capacity, F.struct(a["full"].alias("full"), (a["load"] + s).alias("load")))
        .otherwise(F.struct((a["full"] + 1).alias("full"), s.alias("load"))),
        lambda a: a["full"] + 1,
    )


def _search(low: Column, high: Column, fits) -> Column:
    """Smallest number from ``low`` to ``high`` that fits; ``high`` always does.

    63 halvings cover every long, and those after the end are skipped.
    """

    def halve(b: Column, _: Column) -> Column:
        mid = (b["lo"] + F.floor((b["hi"] - b["lo"]) / 2)).cast("long")
        return (
            F.when(b["lo"] >= b["hi"], b)
            .when(fits(mid), F.struct(b["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), b["hi"].alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(low.alias("lo"), high.alias("hi")), halve, lambda b: b["hi"])


def _mean_load(sizes: Column, shards: int) -> Column:
    return F.ceil(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s) / shards).cast("long")


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Smallest capacity at which the greedy walk needs no more than ``shards`` shards.

    Searched from the larger of the mean load and the largest size, to their sum, where a greedy
    walk always fits.
    """
    mean, largest = _mean_load(sizes, shards), F.coalesce(F.array_max(sizes), F.lit(0)).cast("long")
    return _search(F.greatest(mean, largest), mean + largest, lambda c: _needed(sizes, c) <= shards)


def _divided(runs: Column, capacity: Column) -> Column:
    """Bytes before each cut of a greedy walk that may cut anywhere inside a run of several groups.

    No walk over the groups gets further with as many shards.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("load"), F.array().cast("array<long>").alias("cuts"))

    def step(a: Column, r: Column) -> Column:
        s, at = r["bytes"], a["at"] + r["bytes"]
        over = a["load"] + s - capacity
        more = F.ceil(over / capacity).cast("int")  # shards that are opened inside the run
        inside = F.transform(F.sequence(F.lit(0), more - 1), lambda i: a["at"] + capacity - a["load"] + i * capacity)
        return (
            F.when(over <= 0, F.struct(at.alias("at"), (a["load"] + s).alias("load"), a["cuts"].alias("cuts")))
            .when(r["groups"] == 1, F.struct(at.alias("at"), s.alias("load"), F.array_append(a["cuts"], a["at"]).alias("cuts")))
            .otherwise(F.struct(at.alias("at"), (over - (more - 1) * capacity).alias("load"), F.concat(a["cuts"], inside).alias("cuts")))
        )

    return F.aggregate(runs, start, step, lambda a: a["cuts"])


def cut_positions(sizes: Column, capacity: Column) -> Column:
    """Positions (from 0) at which the greedy walk begins another shard."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("load"), F.array().cast("array<int>").alias("cuts"),
    )
    return F.aggregate(
        sizes, start,
        lambda a, s: F.when(a["load"] + s <= capacity, F.struct((a["at"] + 1).alias("at"), (a["load"] + s).alias("load"), a["cuts"].alias("cuts")))
        .otherwise(F.struct((a["at"] + 1).alias("at"), s.alias("load"), F.array_append(a["cuts"], a["at"]).alias("cuts"))),
        lambda a: a["cuts"],
    )


def _run_of(shift: int) -> Column:
    """The smallest hash of the run that a hash is in, when runs have ``shift`` free bits."""
    return F.shiftleft(F.shiftright("h", shift), shift)


def _runs(groups: DataFrame, shift: int) -> DataFrame:
    """One row per run: its first hash, bytes, groups and the size of its largest group."""
    sums = groups.groupBy(_run_of(shift).alias("start")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest"))
    return sums.withColumn("shift", F.lit(shift))


def cut_hashes(groups: DataFrame, shards: int) -> list[int]:
    """First hashes of all shards but the first, for the smallest capacity over ``groups`` (h, bytes).

    Fewer than ``shards`` numbers are collected, and per round as many bounds; the list of runs
    has at most 2**CELL_BITS entries and 2**SPLIT_BITS more per run that a cut may lie in.
    """
    runs = staged(_runs(groups, 64 - CELL_BITS), "shard-runs")
    settled = False
    while True:
        ordered = F.sort_array(F.collect_list(F.struct("start", "bytes", "groups")))
        one = runs.agg(ordered.alias("runs"), F.max("largest").alias("largest")).withColumn("sizes", F.col("runs.bytes"))
        one = staged(one.where(F.size("runs") > 0), "shard-list")
        # staged, so that a capacity is a value and not an expression inside the next walk
        sizes, listed = F.col("sizes"), F.col("runs")
        mean = _mean_load(sizes, shards)
        least = _search(F.greatest(mean, "largest"), mean + F.array_max(sizes), lambda c: F.size(_divided(listed, c)) < shards)
        one = staged(one.withColumns({"capacity": smallest_capacity(sizes, shards), "least": least}), "shard-capacity")
        at = F.transform(cut_positions(sizes, F.col("capacity")), lambda i: F.get("runs", i)["start"])
        low = F.transform(
            F.slice(cut_positions(sizes, F.col("least")), 1, shards - 1),
            lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, s: a + s),
        )
        found = one.select(at.alias("cuts"), low.alias("low"), _divided(listed, F.col("capacity")).alias("high"), "least").first()
        if found is None:
            return []
        # Runs above the capacity that cannot be undercut must be split first: the lower walk
        # is a bound only if every run fits into a shard. There are at most `shards` of them.
        several = F.col("groups") > 1
        split = runs.where(several & (F.col("bytes") > found["least"])).select("start", "shift") if not settled else None
        if split is None or split.isEmpty():
            settled = True
            # one window over the bounded list of runs
            placed = runs.withColumn("end", F.sum("bytes").over(Window.orderBy("start"))).where(several)
            near = F.lit(False)
            for i, low_i in enumerate(found["low"]):
                over = F.col("end") > low_i
                near = near | (over & (F.col("end") - F.col("bytes") < found["high"][i]) if i < len(found["high"]) else over)
            split = placed.where(near).select("start", "shift")
        split = staged(split, "shard-split")
        shifts = sorted(r["shift"] for r in split.select("shift").distinct().collect())
        if not shifts:
            return list(found["cuts"])
        finer = runs.join(F.broadcast(split), ["start", "shift"], "left_anti")
        for shift in shifts:
            # `split` is a part of the bounded list of runs
            inside = groups.withColumn("start", _run_of(shift)).join(F.broadcast(split.where(F.col("shift") == shift)), "start", "left_semi")
            finer = finer.unionByName(_runs(inside.drop("start"), max(shift - SPLIT_BITS, 0)))
        runs = staged(finer, "shard-runs")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and its place there.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard, slot and
    grown_shard (null: the law is not 'key'). A null text has size 1 and counts as equal to an
    empty one. Repeated rows each get a slot of their own; an empty table gives no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        F.xxhash64(text_or_empty(text)).alias("h"),
    )
    rows = staged(rows.withColumn("cell", F.shiftright("h", 64 - CELL_BITS).cast("int")), "shard-sizes")
    groups = staged(rows.groupBy("h", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    shard = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cut_hashes(groups.select("h", "bytes"), shards)), F.lit(0)).cast("int")
    rows, runs = rows.withColumn("shard", shard), groups.groupBy(shard.alias("shard"), "cell").agg(F.sum("n").alias("n"))

    # A slot is the rows of earlier cells in the shard, plus those of earlier blocks of the cell,
    # plus the place in the block. A cell with many rows (one frequent text) has many blocks.
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long")
    places = (
        runs.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n"))
        .select("shard", "cell", "before", n_blocks.alias("n_blocks"))
    )
    keyed = rows.join(places, ["shard", "cell"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.col("n_blocks")))
    blocks = (
        keyed.groupBy("shard", "cell", "block").agg(F.count("*").alias("n"))
        .withColumn("skip", F.sum("n").over(Window.partitionBy("shard", "cell").orderBy("block")) - F.col("n"))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "cell", "block").orderBy("h", "doc_id")
    return (
        keyed.withColumn("at", F.row_number().over(inside)).join(blocks, ["shard", "cell", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("skip") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

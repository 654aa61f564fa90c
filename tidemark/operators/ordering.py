"""Global ranks, prefix sums and quantiles without a single-task sort.

``prefix_sums`` splits the value axis into cells by exponent and leading mantissa of
the value.  The cells are a fixed function of the value, so the result is the same in
every run, and offsets are windows over at most a few thousand cells.  Equal values are
collapsed by a map-side combine before any window sees them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import as_list

_FINE = 4096


def _cells(value: Column) -> tuple[Column, Column]:
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * _FINE)
    sign = F.signum(v).cast("bigint")
    coarse = F.when(size == 0, F.lit(0)).otherwise(sign * (exponent + 5000)).cast("bigint")
    fine = F.when(size == 0, F.lit(0)).otherwise(sign * mantissa).cast("bigint")
    return coarse, fine


def prefix_sums(
    distinct: DataFrame, value: str, measures: Sequence[str], *, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``below_<m>``: the sum of m over smaller values of the same group.

    ``distinct`` holds one row per (by, value); values are finite numbers.  Also adds
    ``total_<m>`` per group.
    """
    by = list(by)
    coarse, fine = _cells(F.col(value))
    rows = distinct.withColumn("_a", coarse).withColumn("_b", fine)
    sums = [F.sum(m).alias(m) for m in measures]
    cell = rows.groupBy(*by, "_a", "_b").agg(*sums)
    block = cell.groupBy(*by, "_a").agg(*sums)

    before_b = Window.partitionBy(*by, "_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before_a = Window.partitionBy(*by).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0)
    block = block.select(
        *by, "_a",
        *[F.coalesce(F.sum(m).over(before_a), zero).alias(f"_blk_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )
    offsets = cell.select(
        *by, "_a", "_b", *[F.coalesce(F.sum(m).over(before_b), zero).alias(f"_cel_{m}") for m in measures]
    ).join(block, [*by, "_a"])

    inner = Window.partitionBy(*by, "_a", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*by, "_a", "_b"])
    for m in measures:
        out = out.withColumn(
            f"below_{m}",
            F.col(f"_blk_{m}") + F.col(f"_cel_{m}") + F.coalesce(F.sum(m).over(inner), zero),
        )
    return out.drop("_a", "_b", *[f"_blk_{m}" for m in measures], *[f"_cel_{m}" for m in measures])


def hash_order(seed: int | str, *ids: str) -> Column:
    """The md5 text that orders rows pseudo-randomly and repeatably."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_rank(
    df: DataFrame, ids: str | Sequence[str], *, strata: Sequence[str] = (), seed: int | str = 42,
    name: str = "hash_rank", total: str | None = None,
) -> DataFrame:
    """Rank rows 1..n inside each stratum in md5 order of their id.

    Rows of one stratum are split by the first three hex digits of the hash; ranks come
    from 4096 cell counts and a window inside one cell, so a stratum may hold any share
    of the table.
    """
    ids, strata = as_list(ids), list(strata)
    rows = df.withColumn("_h", hash_order(seed, *ids)).withColumn("_c", F.substring("_h", 1, 3))
    counts = rows.groupBy(*strata, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*strata)).alias(total))
    renamed = [F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)]
    offsets = counts.select(*renamed, F.col("_c").alias("_cell"), *cols)
    inner = Window.partitionBy(*strata, "_c").orderBy("_h", *ids)
    cond = F.col("_c") == F.col("_cell")
    for i, c in enumerate(strata):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = rows.join(offsets, cond).drop("_cell", *[f"_s{i}" for i in range(len(strata))])
    return joined.withColumn(name, (F.col("_off") + F.row_number().over(inner)).cast("bigint")).drop("_h", "_c", "_off")


def score_rank(
    df: DataFrame, score: str, row_id: str, *, by: Sequence[str] = (), descending: bool = True,
    seed: int | str = 42, name: str = "rank",
) -> DataFrame:
    """Rank rows by score inside each group; equal scores are ordered by id hash.

    Adds ``name`` and ``n_rows`` (rows of the group).
    """
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("rows"))
    pre = prefix_sums(counts, score, ["rows"], by=by)
    ahead = F.col("below_rows") if not descending else F.col("total_rows") - F.col("below_rows") - F.col("rows")
    pre = pre.select(*by, score, ahead.alias("_ahead"), F.col("total_rows").alias("n_rows"))
    ranked = hash_rank(df, row_id, strata=[*by, score], seed=seed, name="_tie")
    return (
        ranked.join(pre, [*by, score])
        .withColumn(name, (F.col("_ahead") + F.col("_tie")).cast("bigint"))
        .drop("_ahead", "_tie")
    )


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *, by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group, nulls ignored."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"))
    pre = prefix_sums(counts, value, ["rows"], by=by)
    picks = []
    for name, share in shares.items():
        spot = F.lit(float(share)) * (F.col("total_rows") - 1)
        lo, hi = F.floor(spot), F.ceil(spot)
        inside = lambda k: (F.col("below_rows") <= k) & (k < F.col("below_rows") + F.col("rows"))
        picks += [
            F.max(F.when(inside(lo), F.col(value).cast("double"))).alias(f"_lo_{name}"),
            F.max(F.when(inside(hi), F.col(value).cast("double"))).alias(f"_hi_{name}"),
            F.max(spot - lo).alias(f"_w_{name}"),
        ]
    agg = pre.groupBy(*by).agg(*picks)
    return agg.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in shares
        ],
    )


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], tiebreak: str, n: int, *, name: str = "rank") -> DataFrame:
    """First n rows per group: first inside 64 parts of each group, then among the parts' winners."""
    part = F.pmod(F.xxhash64(tiebreak), F.lit(64))
    inner = Window.partitionBy(*by, "_part").orderBy(*order)
    winners = df.withColumn("_part", part).withColumn(name, F.row_number().over(inner)).where(F.col(name) <= n)
    outer = Window.partitionBy(*by).orderBy(*order)
    return winners.withColumn(name, F.row_number().over(outer)).where(F.col(name) <= n).drop("_part")

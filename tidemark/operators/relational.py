"""Deduplication, id filters and unions with an explicit row order.

"Keep first" always means the smallest row in a stated order, never file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import as_list


def first_row(df: DataFrame, keys: str | Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Keep one row per key: the smallest by ``order``, then by the other columns, nulls last.

    A plain aggregation, so a key with very many copies is reduced map-side.
    """
    keys = as_list(keys)
    rest = [c for c in order if c not in keys]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    if not rest:
        return df.select(*keys).distinct()
    ranked = F.struct(*[F.struct(F.col(f"`{c}`").isNull().alias("none"), F.col(f"`{c}`").alias("value")).alias(f"_{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._{i}.value").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def last_value(df: DataFrame, key: str, value: str, load_order: str) -> DataFrame:
    """Upsert: the value with the greatest load order wins."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(load_order, value)).alias(value))


def with_key_count(df: DataFrame, key: str, name: str = "key_rows") -> DataFrame:
    """Attach how often each key occurs (for single / multiple splits); rows without a key are one key.

    Rows are moved and sorted once and joined with nothing; a key's rows beyond Spark's window buffer spill.
    """
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))


def split_single_multi(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    counted = with_key_count(df, key, "_n")
    return (
        counted.where(F.col("_n") == 1).drop("_n"),
        counted.where(F.col("_n") > 1).drop("_n"),
    )


def unique_ids_only(df: DataFrame, key: str) -> DataFrame:
    """Drop every row whose id occurs more than once: rows are moved once and not aggregated."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_n") == 1).drop("_n")


def keep_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    on = as_list(on)
    return df.join(ids.select(*on), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    on = as_list(on)
    return df.join(ids.select(*on), on, "left_anti")


def split_labelled(df: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(code).isNotNull()), df.where(F.col(code).isNull())


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Keep rows whose flag is false and drop the flag column."""
    return df.where(F.col(flag) == F.lit(False)).drop(flag)


def inside_open(value: Column, low, high) -> Column:
    """The value when strictly between the bounds, else null."""
    return F.when((value > low) & (value < high), value)


def select_existing(df: DataFrame, names: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Project the listed columns that exist, then rename."""
    return df.select(*[c for c in names if c in df.columns]).withColumnsRenamed(renames or {})


def coalesce_sources(frames: Sequence[DataFrame], into: str, columns: Sequence[str]) -> DataFrame:
    """Union frames with different columns; ``into`` takes the first non-null source column."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    merged = out.withColumn(into, F.coalesce(*[F.col(c) for c in columns]))
    return merged.drop(*[c for c in columns if c != into]).where(F.col(into).isNotNull())

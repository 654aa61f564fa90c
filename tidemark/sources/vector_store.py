"""A store of vectors by id: batches are appended, the last batch wins, lookups read only the parts they need.

Ids are laid out in runs of ``RUN`` neighbouring ids that are dealt to ``PARTS`` parts in turn; ids that are
no numbers are dealt by hash. A batch is one folder with one sorted file per part, with a Bloom
filter over its ids. The number of parts does not grow with the store, so the parts that a lookup
touches are a bounded list; what grows is the number of row groups in a part's file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 1024
PARTS = 512


def _part(ids: Column, kind: T.DataType, run: int, parts: int) -> Column:
    spread = F.floor(ids / run) if isinstance(kind, T.IntegralType) else F.xxhash64(ids)
    return F.pmod(spread, F.lit(parts)).cast("int")


def append_vectors(df: DataFrame, path: str, row_id: str, vector: str, batch: int, *, run: int = RUN, parts: int = PARTS) -> None:
    """Write one batch; writing the same batch again replaces it.

    Floats halve the size of doubles. Of an id that a batch holds several times the largest vector (in array
    order) is kept, so that a rerun keeps the same one; a null vector counts only if all are null. Rows without an id are left
    out. An empty batch leaves no folder. One shuffle: the layout by part also serves the reduction to one row per id.
    """
    rows = df.where(F.col(row_id).isNotNull()).select(row_id, F.col(vector).cast("array<float>").alias(vector))
    kind = rows.schema[row_id].dataType
    placed = rows.withColumn("part", _part(F.col(row_id), kind, run, parts)).repartition("part")
    once = placed.groupBy("part", row_id).agg(F.max(vector).alias(vector)).sortWithinPartitions("part", row_id)
    (
        once.write.mode("overwrite").partitionBy("part")
        .option(f"parquet.bloom.filter.enabled#{row_id}", "true").parquet(f"{path}/batch={int(batch)}")
    )


def _store(spark: SparkSession, path: str, row_id: str, kind: T.DataType, vector: str) -> DataFrame:
    schema = T.StructType([
        T.StructField(row_id, kind), T.StructField(vector, T.ArrayType(T.FloatType())),
        T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType()),
    ])
    return spark.read.schema(schema).parquet(path)


def _last(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    # a struct, not max_by: a null vector of a later batch wins as well
    last = rows.groupBy("part", row_id).agg(F.max_by(F.struct(vector), "batch").alias("last"))
    return last.select(row_id, F.col(f"last.{vector}").alias(vector))


def all_vectors(spark: SparkSession, path: str, row_id: str, vector: str, kind: T.DataType = T.LongType()) -> DataFrame:
    """Every id of the store with its vector of the last batch that holds it."""
    return _last(_store(spark, path, row_id, kind, vector), row_id, vector)


def lookup_ids(
    spark: SparkSession, ids: Iterable, path: str, row_id: str, vector: str, kind: T.DataType = T.LongType(), *, run: int = RUN, parts: int = PARTS,
) -> DataFrame:
    """Vectors of a few ids that the caller names; absent ids give no row. The ids reach the scan as a filter."""
    named = sorted(set(ids))
    wanted = F.array(*[F.lit(i).cast(kind) for i in named]) if named else F.array().cast(T.ArrayType(kind))
    chosen = spark.range(1).select(F.explode(wanted).alias("i")).select(_part(F.col("i"), kind, run, parts).alias("p")).distinct()
    touched = [r.p for r in chosen.collect()]  # as many as the caller's ids at most
    rows = _store(spark, path, row_id, kind, vector)
    return _last(rows.where(F.col("part").isin(touched) & F.col(row_id).isin(named)), row_id, vector)


def lookup_vectors(ids: DataFrame, path: str, row_id: str, vector: str, *, run: int = RUN, parts: int = PARTS) -> DataFrame:
    """The rows of ``ids`` with the stored vector, null for an absent id; repeated and null ids stay.

    The touched parts (at most ``parts`` numbers) and the smallest and largest id become filters of the scan; inside the
    touched parts the join decides. ``run`` and ``parts`` must be those of the store.
    """
    spark, kind = ids.sparkSession, ids.schema[row_id].dataType
    wanted = ids.where(F.col(row_id).isNotNull()).select(row_id, _part(F.col(row_id), kind, run, parts).alias("part"))
    span = wanted.agg(F.collect_set("part").alias("parts"), F.min(row_id).alias("low"), F.max(row_id).alias("high")).first()
    rows = _store(spark, path, row_id, kind, vector).where(F.col("part").isin(span["parts"]))
    if span["parts"]:
        rows = rows.where(F.col(row_id).between(F.lit(span["low"]).cast(kind), F.lit(span["high"]).cast(kind)))
    found = rows.join(wanted.distinct(), ["part", row_id], "left_semi")
    return ids.join(_last(found, row_id, vector), row_id, "left")

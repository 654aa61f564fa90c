"""Sinks: parquet stages, CSV reports and the vector table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write one stage as parquet and return it as read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, *, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").options(header=True, encoding=encoding, quote='"', escape='"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, row_id: str, vector: str) -> DataFrame:
    """Vectors as (id, float array); floats halve the size of doubles."""
    return write_stage(df.select(row_id, F.col(vector).cast("array<float>").alias(vector)), path)


def lookup_vectors(spark: SparkSession, ids: DataFrame, path: str, row_id: str) -> DataFrame:
    """Vectors of the listed ids; an absent id keeps a null vector."""
    return ids.join(spark.read.parquet(path), row_id, "left")

"""Readers: raw tables, id-restricted reads, databases, CSV labels and JSON logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import report_key, strip, text_hash
from ..operators.relational import first_row, keep_ids


def read_projected(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, glob: str | None = None
) -> DataFrame:
    """Parquet folder or file, only the listed columns, optionally only some files."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def with_report_key(df: DataFrame, visit: str, text: str) -> DataFrame:
    """Exam reports: null text dropped; trimmed text, its hash and the report key added."""
    kept = df.where(F.col(text).isNotNull())
    return (
        kept.withColumn("report_text", strip(F.col(text)))
        .withColumn("raw_text_hash", text_hash(F.col(text)))
        .withColumn("key", report_key(F.col(visit), F.col(text)))
    )


def clamp_dates(df: DataFrame, columns: Sequence[str], low: str = "1960-01-01", high: str = "2029-01-01") -> DataFrame:
    """Dates not strictly between the bounds become null."""
    def clamp(c: str) -> Column:
        inside = (F.col(c) > F.lit(low).cast("timestamp_ntz")) & (F.col(c) < F.lit(high).cast("timestamp_ntz"))
        return F.when(inside, F.col(c))

    return df.withColumns({c: clamp(c) for c in columns})


def bound_dates(df: DataFrame, columns: Sequence[str], low: str = "1970-01-01", high: str = "2030-01-01") -> DataFrame:
    """Rows with a null date, or one outside the closed bounds, are dropped."""
    for c in columns:
        df = df.where(F.col(c).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    return df


def read_master(
    spark: SparkSession, path: str, prefix: str, columns: Sequence[str], dedup: Sequence[str] | None = None
) -> DataFrame:
    """Master-data files with a name prefix, one row per dedup key."""
    df = read_projected(spark, path, columns, glob=f"{prefix}*.parquet")
    return first_row(df, dedup) if dedup else df


def read_by_ids(
    df: DataFrame, ids: DataFrame, on: str, columns: Sequence[str] | None = None, *,
    fraction: float | None = None, seed: int = 42,
) -> DataFrame:
    """Rows of the listed ids, projected; optionally a repeatable share of them."""
    out = keep_ids(df.select(*columns) if columns else df, ids, on)
    return out if fraction is None else hash_fraction(out, on, fraction, seed)


def hash_fraction(df: DataFrame, row_id: str, fraction: float, seed: int | str = 42) -> DataFrame:
    """A share of rows chosen by the md5 of their id; the same rows in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8)
    return df.where(F.conv(digits, 16, 10).cast("bigint") < int(fraction * 16**8))


def category_predicates(column: str, values: Sequence[str]) -> list[str]:
    """One SQL predicate per category, quoted; each becomes one JDBC partition."""
    return ["{} = '{}'".format(column, v.replace("'", "''")) for v in values]


def read_jdbc(
    spark: SparkSession, url: str, query: str, properties: dict[str, str], *,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
    partitions: int = 64, predicates: Sequence[str] | None = None, fetch_size: int = 10_000,
) -> DataFrame:
    """Partitioned database read: by a numeric key range, or one partition per predicate.

    Key ranges replace offset paging: every partition is an independent range scan, is
    retried on its own, and needs no row count beforehand.
    """
    props = {**properties, "fetchsize": str(fetch_size)}
    table = f"({query}) q"
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=props)
    if partition_column:
        return spark.read.jdbc(url, table, partition_column, lower, upper, partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def pending_parts(parts: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parts that were not loaded yet."""
    return parts.join(done.select(*on).distinct(), list(on), "left_anti")


def read_label_csv(spark: SparkSession, path: str, schema: str | T.StructType = "key string, content string") -> DataFrame:
    """Latin-1 CSV with a header; quoted values may span lines."""
    return (
        spark.read.schema(schema)
        .options(header=True, encoding="ISO-8859-1", multiLine=True, quote='"', escape='"')
        .csv(path)
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines log; a line that is not valid JSON is kept in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)

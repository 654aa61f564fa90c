"""Helpers shared by the training-data operators: staged tables and column picks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path

#: One word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: One ASCII white-space character.
BLANK = r"[\x20\x09-\x0D]"


#: Bytes of rows that go to Python at a time in a written stage; a longer row goes alone.
ARROW_BYTES = 2 * 1024 * 1024


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded bytes while a stage is written; then the session's own setting again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage and fixes the rows, so that a task that is run again after a lost
    executor sees what the first run saw.
    """
    path = stage_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with more underscores in front where the rows already have a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")

"""Exact deduplication as a stateful stream.

Documents are reduced to a digest, their id, a row number and a content locator, and streamed
through a keyed state in RocksDB without watermark or expiry: per digest it retains the row
that stays, its locator and the number of rows. A later run of the same checkpoint continues
from that state. Rows that hit a digest seen before are then checked on their full bytes
against the row that stays, and split off where they differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_path
from .common import staged, text_or_empty, unused

SPACES = " \t\n\x0b\x0c\r"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # native memory of all stores of an executor together is bounded
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no space set aside in advance: a store for each of many partitions would take it
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(text_or_empty(text), SPACES, "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def digest_state(spark: SparkSession, rows_path: str, checkpoint: str, schema: str) -> DataFrame:
    """Stream the rows into the keyed state and return it: digest, group_size, best."""
    session = spark.newSession()
    for key, value in STATE.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    seen = session.readStream.schema(schema).parquet(rows_path)
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), "locator"))
    query = (
        seen.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))
        .writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = session.read.format("statestore").load(checkpoint)
    count, kept = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{count}").alias("group_size"), F.col(f"value.{kept}").alias("best"),
    )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs`` with the row that stays of its group of equal texts.

    Returns doc_id, keep_id, group_size, kept and digest. Texts are equal if they are so
    without ASCII white space; null and empty texts are one group. The longest original text
    stays, then the smallest id; of repeated rows exactly one is ``kept``. A null id stays
    only if all ids of its group are null. Other columns are not read.
    """
    spark = docs.sparkSession
    ids = F.col(doc_id).cast("long").alias("doc_id")
    slim = staged(
        docs.select(
            ids, digest(normalised(text)).alias("digest"), F.length(text_or_empty(text)).alias("chars"),
            F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("locator"),
        ),
        "dedup-rows",
    )
    checkpoint = stage_path(spark, "dedup-state")
    schema = "doc_id long, digest string, chars int, row long, locator string"
    state = digest_state(spark, slim.inputFiles()[0].rsplit("/", 1)[0], checkpoint, schema) if slim.inputFiles() else None
    if state is None:
        return slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    groups = state.select("digest", "group_size", (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_row")).alias("keep_row"))
    found = staged(slim.join(groups, "digest"), "dedup-groups")

    # full bytes of the rows that hit a digest, against those of the row that stays
    hits = found.where("group_size > 1").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "keep_id").distinct()
    content = docs.select(ids, normalised(text).alias("content")).withColumn("digest", digest(F.col("content")))
    texts = staged(
        content.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")))
        .select("doc_id", "digest", "content", "keep_id"),
        "dedup-hits",
    )
    first = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("content").alias("expected"))
    differ = staged(texts.join(first, "digest").where("content <> expected").select("doc_id", "digest", "content"), "dedup-differ")
    if not differ.isEmpty():
        found = _split(found, differ)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def _split(found: DataFrame, differ: DataFrame) -> DataFrame:
    """Groups anew, by digest and full content, where a digest stands for several texts."""
    other = differ.select(F.col("doc_id").alias("d_id"), F.col("digest").alias("d_digest"), "content").distinct()
    rows = found.drop("group_size", "keep_id", "keep_row").join(
        other, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("d_digest")), "left"
    ).drop("d_id", "d_digest")
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best")
    groups = rows.groupBy("digest", "content").agg(F.count("*").alias("group_size"), best).select(
        F.col("digest").alias("g_digest"), F.col("content").alias("g_content"), "group_size",
        (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_row")).alias("keep_row"),
    )
    same = (F.col("digest") == F.col("g_digest")) & F.col("content").eqNullSafe(F.col("g_content"))
    return rows.join(groups, same).drop("g_digest", "g_content", "content")


def keep_one_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep_id, keep_digest, digest, copy = (unused(docs, c) for c in ("_keep_id", "_keep_digest", "_digest", "_copy"))
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest))
    rows = docs.withColumn(digest, sha256(normalised(text)))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(keep_id)) & (F.col(digest) == F.col(keep_digest))
    # repeated rows share id and digest: the longest of them stays
    order = Window.partitionBy(F.col(doc_id).cast("long"), digest).orderBy(F.length(text_or_empty(text)).desc())
    return rows.join(kept, same, "left_semi").withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).drop(copy, digest)

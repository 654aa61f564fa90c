"""Resumable ingest: a checkpointed file stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of the target that names the batch a row came with.
BATCH = "ingest_batch"
COMMITS = f"{BATCH} long, n_rows long"


def commit_batch(batch: DataFrame, batch_id: int, target: str, commits: str) -> int:
    """Write one batch and note it in the commit table; a batch that is noted there writes nothing.

    The batch has a folder of its own, which is overwritten, so a batch that was written but
    not noted before a failure leaves no second copy. Returns the rows added.
    """
    spark = batch.sparkSession
    done = spark.createDataFrame([], COMMITS)
    done.write.mode("append").parquet(commits)
    if not spark.read.schema(COMMITS).parquet(commits).where(F.col(BATCH) == batch_id).isEmpty():
        return 0
    folder = f"{target}/{BATCH}={batch_id}"
    batch.write.mode("overwrite").parquet(folder)
    rows = spark.read.schema(batch.schema).parquet(folder).count()
    spark.createDataFrame([(batch_id, rows)], COMMITS).coalesce(1).write.mode("append").parquet(commits)
    return rows


def ingest_available(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, *,
    glob: str = "*.parquet", files_per_batch: int = 1000,
) -> int:
    """Append files not yet ingested to ``target``, partitioned by batch; returns the rows added.

    The checkpoint remembers finished files, and a table of commits in it the batches written,
    so a run after a failure, or after new files arrived, adds only the rest, once.
    """
    added: list[int] = []
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )
    query = (
        stream.writeStream.foreachBatch(lambda batch, i: added.append(commit_batch(batch, i, target, f"{checkpoint}/commit-table")))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(added)

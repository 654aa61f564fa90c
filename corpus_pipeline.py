"""From raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; they are written to the
shared folder and read again as the next stage's documents. All stages but the last return the
columns of ``documents``. Stages keep rows with null ids or texts as their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, staged
from tidemark.llm.exact_dedup import keep_one_copy
from tidemark.llm.mixing import mix_documents, place_mix
from tidemark.llm.near_dedup import keep_one_of_each
from tidemark.llm.packing import pack_documents
from tidemark.llm.toxicity import fit_toxicity, in_fold, score_toxicity

#: Documents with at least this toxicity go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit; learned as in the operator's query, on two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold("doc_id", 3, 1))
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model)
    score = scored.columns[-1]
    return scored.where(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return keep_one_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8."""
    return keep_one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once, twice or not at all, so that sources reach their target weights, in the order of their shards."""
    return place_mix(mix_documents(docs, cut=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: The near-duplicate stage and the learned toxicity model cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

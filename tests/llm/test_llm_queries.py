"""Queries against their check SQL, and the pipeline against its stages' own rules."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import catalog
from tidemark.llm.common import staged

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")


def test_thirteen_operators_and_the_pipeline():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    at = [df.columns.index(c) for c in cols]
    assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(cur.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        assert docs.columns == columns
        if name == "exact_dedup":
            texts = ["".join((r["text"] or "").split()) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_with_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), f"awkward-{name}")
            if name != "packing":
                assert docs.columns == columns

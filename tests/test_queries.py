"""A cross-section of registered queries against their check SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "eligibility_cohort", "explode_index_exams", "point_in_time_features", "dedup_by_key", "pair_semi_join", "percentile_trim",
    "history_collect_sorted", "severity_v1_else_v2", "topic_score_classify", "tfidf_fit_transform", "mean_history_vector",
    "entity_to_exam_split", "topk_curve", "standardise_features", "best_trial", "resumable_chunk_ingest",
]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), cols) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_entry(spark):
    assert entry.entry(spark).count() == 10

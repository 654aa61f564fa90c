"""The vector store: last batch wins, replayed batches, pruned lookups."""

import glob

import pytest
from pyspark.sql import types as T

from tidemark.sources import vector_store as S

SCHEMA = "id long, v array<double>"


def _vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _as_dict(df):
    return {r.id: r.v for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    S.append_vectors(_vectors(spark, [(i, [float(i), 0.5]) for i in range(2000)]), path, "id", "v", 1, run=10, parts=50)
    S.append_vectors(_vectors(spark, [(7, [70.0]), (9, None), (5000, [1.0]), (None, [3.0])]), path, "id", "v", 2, run=10, parts=50)
    return path


def test_last_batch_wins_and_a_replayed_batch_changes_nothing(spark, store):
    first = _as_dict(S.all_vectors(spark, store, "id", "v"))
    assert len(first) == 2001 and first[7] == [70.0] and first[9] is None and first[8] == [8.0, 0.5]
    S.append_vectors(_vectors(spark, [(7, [70.0]), (9, None), (5000, [1.0])]).repartition(3), store, "id", "v", 2, run=10, parts=50)
    assert _as_dict(S.all_vectors(spark, store, "id", "v")) == first


def test_lookup_keeps_absent_null_and_repeated_ids(spark, store):
    ids = spark.createDataFrame([(7, "a"), (7, "b"), (1999, "c"), (3000, "d"), (None, "e")], "id long, tag string")
    got = {r.tag: r.v for r in S.lookup_vectors(ids, store, "id", "v", run=10, parts=50).collect()}
    assert got == {"a": [70.0], "b": [70.0], "c": [1999.0, 0.5], "d": None, "e": None}
    assert [r.v for r in S.lookup_vectors(ids.where("tag = 'e'"), store, "id", "v", run=10, parts=50).collect()] == [None]
    assert S.lookup_vectors(ids.where("tag = 'z'"), store, "id", "v", run=10, parts=50).count() == 0


def _scanned_files(df):
    """Files that the scan of the executed plan has read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            found.append(int(node.metrics().apply("numFiles").value()))
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
    return sum(found)


def test_a_lookup_of_one_percent_reads_less_than_a_tenth_of_the_files(spark, store):
    files = len(glob.glob(f"{store}/batch=*/part=*/*.parquet"))
    ids = spark.range(400, 420)
    assert 0 < _scanned_files(S.lookup_vectors(ids, store, "id", "v", run=10, parts=50)) < files / 10
    few = S.lookup_ids(spark, [7, 1500, 9999], store, "id", "v", run=10, parts=50)
    assert 0 < _scanned_files(few) < files / 10
    assert _as_dict(few) == {7: [70.0], 1500: [1500.0, 0.5]}
    assert S.lookup_ids(spark, [], store, "id", "v", run=10, parts=50).count() == 0


def test_text_ids_and_repeated_rows_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "named")
    rows = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", None), ("b", [3.0])], "id string, v array<float>")
    S.append_vectors(rows, path, "id", "v", 1)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert _as_dict(S.lookup_vectors(ids, path, "id", "v")) == {"a": [2.0], "b": [3.0], "c": None}
    assert _as_dict(S.lookup_ids(spark, ["b"], path, "id", "v", T.StringType())) == {"b": [3.0]}

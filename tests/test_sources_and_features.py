"""Sources, sinks, contracts, features and deduplication."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.models import risk
from tidemark.operators import features as X
from tidemark.operators import relational as R
from tidemark.sources import readers, validation, writers
from tidemark.streaming.ingest import commit_batch, ingest_available


def test_first_row_ignores_input_order(spark):
    rows = [(1, "b", 2), (1, "a", 3), (2, None, 1), (None, "z", 0)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "k int, s string, n int").repartition(parts)
        assert {tuple(r) for r in R.first_row(df, "k", ["s"]).collect()} == {(1, "a", 3), (2, None, 1), (None, "z", 0)}
    assert [r.k for r in R.unique_ids_only(df.where("k is not null"), "k").collect()] == [2]


def test_resumed_ingest_adds_only_new_files(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = spark.range(1).schema
    spark.range(10).coalesce(1).write.parquet(src)
    assert ingest_available(spark, src, schema, out, state) == 10
    assert ingest_available(spark, src, schema, out, state) == 0
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    assert ingest_available(spark, src, schema, out, state) == 5
    assert spark.read.parquet(out).count() == 15


def test_replayed_batch_writes_nothing(spark, tmp_path):
    out, commits = str(tmp_path / "out"), str(tmp_path / "commits")
    assert commit_batch(spark.range(7), 3, out, commits) == 7
    assert commit_batch(spark.range(7), 3, out, commits) == 0
    spark.range(4).write.parquet(f"{out}/ingest_batch=4")  # written, but not noted before a failure
    assert commit_batch(spark.range(5), 4, out, commits) == 5
    assert spark.read.parquet(out).count() == 12


def test_many_batches_are_all_counted(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(6).repartition(6).write.parquet(src)
    assert ingest_available(spark, src, spark.range(1).schema, out, state, files_per_batch=1) == 6


def test_category_predicates_are_quoted():
    assert readers.category_predicates("kind", ["US", "d'or"]) == ["kind = 'US'", "kind = 'd''or'"]


def test_labels_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = [("k1", 'maligno "in situ"\nseção 2'), ("k2", "benigno, sem atipia")]
    writers.write_csv(spark.createDataFrame(rows, "key string, content string"), str(tmp_path / "c"), encoding="ISO-8859-1")
    assert sorted(tuple(r) for r in readers.read_label_csv(spark, str(tmp_path / "c")).collect()) == rows


def test_date_clamp_and_bounds(spark):
    df = spark.createDataFrame([(1, dt.datetime(1959, 1, 1)), (2, dt.datetime(2000, 1, 1)), (3, None), (4, dt.datetime(2029, 1, 1))], "i int, t timestamp_ntz")
    assert [r.t is not None for r in readers.clamp_dates(df, ["t"]).orderBy("i").collect()] == [False, True, False, False]
    assert [r.i for r in readers.bound_dates(df, ["t"]).orderBy("i").collect()] == [2, 4]


def test_contract_errors(spark):
    df = spark.createDataFrame([("1", "2020-01-01 00:00:00", "x", "5"), (None, "soon", None, "p")], "CD_ATENDIMENTO string, DT_ATENDIMENTO string, NM_EXAME string, CD_PACIENTE string")
    got = [r.errors for r in validation.validate_rows(df, schemas.EXAM_REPORTS).collect()]
    assert got[0] == []
    assert got[1] == ["CD_ATENDIMENTO: required", "DT_ATENDIMENTO: not timestamp_ntz", "CD_PACIENTE: not bigint"]


def test_log_errors(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"trial_number": 1, "result": 0.5, "params": {"dropout": 0.1}}\nnot json\n{"result": 0.5}\n')
    log = readers.read_log(spark, str(path), schemas.TUNING_LOG)
    counts = sorted(len(r.errors) for r in validation.log_errors(log, ["trial_number", "result", "params.dropout"]).collect())
    assert counts == [0, 2, 4]


def test_standardise_uses_the_given_statistics(spark):
    rows = [(i, None if i == 0 else 10.0 + i, None if i % 2 else 45.0 + i, 100.0, 200.0 + i, 20.0 + i, 30.0 + i, 35.0 + i) for i in range(8)]
    names = "id long, menarche_age double, menopause_age double, payment_min double, payment_max double, bmi double, age_at_first double, age_at_exam double"
    train = spark.createDataFrame(rows, names)
    test = spark.createDataFrame(rows[:3], names)
    out = {r.id: r for r in X.standardise_features(test, "id", stats_from=train).collect()}
    bmi = np.array([r[5] for r in rows])
    assert out[2].bmi == pytest.approx((22.0 - bmi.mean()) / bmi.std(ddof=1))
    assert out[1].payment_min == pytest.approx(np.log1p(100.0))
    again = {r.id: r for r in X.standardise_features(test.repartition(3), "id", stats_from=train).collect()}
    assert again[0].menarche_age == out[0].menarche_age  # imputed the same in every run


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "z string")
    codes = X.category_table(df.where("z <> 'c'"), "z")
    assert {r.z: r.category_index for r in X.category_index(df, "z", codes).collect()} == {"a": 0, "b": 1, "c": -1}


def test_beta_calibration_lowers_brier(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.01, 0.99, 400)
    y = (rng.uniform(size=400) < p**3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "score double, label int")
    out = risk.calibrate(risk.beta_calibration(df, "score", "label"), df, "score")
    brier = out.agg(F.avg((F.col("score") - F.col("label")) ** 2), F.avg((F.col("pred_calibrated") - F.col("label")) ** 2)).first()
    assert brier[1] < brier[0]


def test_svd_matches_numpy(spark):
    m = np.random.default_rng(1).normal(size=(40, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in m], "v array<double>")
    assert np.allclose(risk.truncated_svd(df, "v", 3).s.toArray(), np.linalg.svd(m, compute_uv=False)[:3])

"""A parameter search has to say how good each trial is and which one is best."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.models import risk
from tidemark.models.search import START_TRIALS, Parameter, propose, search
from tidemark.plans.risk_features import model_rows, risk_features

SF = "/root/testdata/sf0.001"


def test_trial_metrics_known_values(spark):
    rows = [(0, 0.5, i, float(y), p) for i, (y, p) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])]
    rows += [(1, 0.1, i, float(y), p) for i, (y, p) in enumerate([(1, 0.9), (0, 0.2), (1, 0.7), (0, 0.1)])]
    scored = spark.createDataFrame(rows, "trial int, reg double, id long, label double, pred double")
    got = {r["trial"]: r for r in risk.trial_metrics(scored, ["trial", "reg"]).collect()}
    assert (got[0]["reg"], got[0]["n"], got[0]["auroc"], got[0]["is_best"]) == (0.5, 4, 0.75, False)
    assert got[0]["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert (got[1]["reg"], got[1]["auroc"], got[1]["average_precision"], got[1]["is_best"]) == (0.1, 1.0, 1.0, True)


def test_trial_metrics_of_one_class(spark):
    rows = [(f, t, 1.0 if f else 0.0, 0.5) for f in (0, 1) for t in (0, 1)]
    scored = spark.createDataFrame(rows, "fold int, trial int, label double, pred double")
    got = risk.trial_metrics(scored, ["trial"], within=["fold"]).collect()
    assert all(r["auroc"] is None and r["average_precision"] == (1.0 if r["fold"] else None) for r in got)
    assert sorted((r["fold"], r["trial"]) for r in got if r["is_best"]) == [(0, 0), (1, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_search_keeps_the_best(spark):
    trials = entry.queries()["param_search_trials"](spark, SF).collect()
    assert len({(r["depth"], r["units"], r["learning_rate"], r["optimizer"]) for r in trials}) > 10 and len(trials) == 20
    best = [r for r in trials if r["is_best"]]
    assert len(best) == 1 and best[0]["auroc"] == max(r["auroc"] for r in trials)
    folds = entry.queries()["cv_fold_trials"](spark, SF).collect()
    assert len(folds) == 9 and sorted(r["fold"] for r in folds if r["is_best"]) == [0, 1, 2]
    assert all(0 <= r["auroc"] <= 1 and 0 <= r["average_precision"] <= 1 for r in folds)


SPACE = [Parameter("rate", 1e-4, 1.0, log=True), Parameter("depth", 1, 5, whole=True)]


def peak(values):
    return {"result": -abs(math.log10(values["rate"]) + 2) - abs(values["depth"] - 3)}


def test_search_goes_on_from_its_table_and_proposals_come_from_it(spark, tmp_path):
    path = str(tmp_path / "trials")
    search(spark, SPACE, peak, path, trials=10)
    calls = []
    table = search(spark, SPACE, lambda v: calls.append(v) or peak(v), path, trials=12)
    rows = {r["trial"]: r for r in table.collect()}
    assert len(calls) == 2 and sorted(rows) == list(range(12))
    for i in range(START_TRIALS, 12):
        again = propose(table.where(F.col("trial") < i), SPACE, result="result").first()
        assert again["n_trials"] == i and (again["rate"], again["depth"]) == (rows[i]["rate"], rows[i]["depth"])


def test_proposals_gather_around_the_best(spark):
    rows = [(i, 10 ** (-4 + 4 * (i % 40) / 39), float(1 + i % 5)) for i in range(200)]
    rows = [(i, r, d, peak({"rate": r, "depth": d})["result"]) for i, r, d in rows]
    trials = spark.createDataFrame(rows, "trial int, rate double, depth double, result double")
    got = [propose(trials, SPACE, seed=s).first() for s in range(6)]
    assert all(1e-3 < r["rate"] < 1e-1 and 2 <= r["depth"] <= 4 for r in got)


def test_studies_do_not_mix_and_missing_results_are_left_out(spark):
    rows = [(s, i, 0.1 if s == "a" else 0.001, 2.0, None if i == 3 else float(i)) for s in "ab" for i in range(6)]
    trials = spark.createDataFrame(rows, "study string, trial int, rate double, depth double, result double")
    got = {r["study"]: r for r in propose(trials, SPACE, study=["study"]).collect()}
    alone = propose(trials.where("study = 'a'"), SPACE, study=["study"]).first()
    assert got["a"] == alone and {r["n_trials"] for r in got.values()} == {5}
    assert propose(trials.limit(0), SPACE, study=["study"]).count() == 0


def _risk_input(spark):
    d = lambda y, m=1: dt.date(y, m, 1)
    exams = spark.createDataFrame([(e, e * 10 + k, d(2000 + k), 2) for e in range(1, 41) for k in range(3)], "entity_id long, exam_id long, ts date, code int")
    conf = spark.createDataFrame([(e, d(2002, 6), 1) for e in range(1, 41, 4)], "entity_id long, ts date, result int")
    vec = exams.select("entity_id", "ts", F.array(F.col("exam_id").cast("double"), F.lit(1.0)).alias("vector"))
    ans = exams.select("entity_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("children"), F.lit(0).alias("flag"))
    return exams, conf, vec, ans


def test_risk_features_know_nothing_of_the_future(spark):
    exams, conf, vec, ans = _risk_input(spark)
    cut = dt.date(2001, 1, 1)
    late = lambda df, **new: df.withColumns({c: F.when(F.col("ts") > F.lit(cut), v).otherwise(F.col(c)) for c, v in new.items()})
    columns = ["exam_id", "history", "n_prior", "n_answers", "children", "flag"]
    one = risk_features(exams, conf, vec, ans).where(F.col("ts") <= F.lit(cut))
    other = risk_features(exams, conf, late(vec, vector=F.array(F.lit(-9e9), F.lit(7.0))), late(ans, children=F.lit(99))).where(F.col("ts") <= F.lit(cut))
    rows = sorted(map(str, one.select(columns).collect()))
    assert len(rows) == 80 and rows == sorted(map(str, other.select(columns).collect()))


def test_no_entity_is_on_both_sides_of_a_fold(spark):
    table = risk_features(*_risk_input(spark))
    sides = table.groupBy("entity_id").agg(F.countDistinct("fold").alias("f"), F.countDistinct("split").alias("s"), F.max("label").alias("label"))
    assert sides.where("f <> 1 or s <> 1").count() == 0 and sides.where("label = 1").count() == 10
    assert {r[0] for r in table.select("fold").distinct().collect()} == {-1, 0, 1, 2}
    label = {r.exam_id: r.label for r in table.collect()}
    assert label[10] == 0 and label[11] == label[12] == 1 and label[22] == 0
    assert model_rows(table, 3).first()["features"].size == 3 + 5

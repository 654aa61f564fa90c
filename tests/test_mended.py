"""Cases that used to fail: one-class groups, constant columns, single age bounds, nulls in keep-first."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.models import risk
from tidemark.operators import evaluation as E
from tidemark.operators.features import min_max, moments, standardise_features, zscore
from tidemark.operators.relational import first_row, split_single_multi, unique_ids_only
from tidemark.operators.splits import oversample_positive
from tidemark.plans.eligible_cohort import CohortRules, _steps


def test_one_class_roc(spark):
    rows = spark.createDataFrame([("a", 0.1, 1, 0), ("a", 0.2, 2, 0), ("b", 0.3, 1, 1)], "g string, s double, pos long, neg long")
    got = E.roc_points(rows, "s", by=["g"]).collect()
    assert all((r["fpr"] is None) == (r["g"] == "a") for r in got)
    few = spark.createDataFrame([(1, 0.9, 1), (2, 0.4, 0), (3, 0.3, 0), (4, 0.2, 0)], "id long, s double, y int")
    assert E.roc_curve_ci(few, "id", "s", "y", replicates=10, points=5).count() <= 5


def test_poisson_steps_reach_the_resolution():
    assert 1 - E.POISSON_STEPS[-1] <= 2**-32 and E.POISSON_STEPS[0] == pytest.approx(0.36787944117144233)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double")
    assert [r["x"] for r in min_max(df, "x").collect()] == [None, None]
    assert [r["z"] for r in df.withColumn("z", zscore(F.col("x"), moments(df, ["x"]), "x")).collect()] == [None, None]
    assert oversample_positive(df.withColumn("y", F.lit(0)), "id", "y", 1).count() == 2


def test_bins_use_the_given_statistics(spark):
    schema = "id long, menarche_age double, menopause_age double, age_at_exam double, payment_min double, payment_max double, bmi double, age_at_first double"
    train = spark.createDataFrame([(i, 10.0 + i, m, 60.0 + i, 1.0, 2.0 + i, 20.0 + i, 40.0 + i) for i, m in enumerate((30.0, 42.0, 47.0, 60.0))], schema)
    one = spark.createDataFrame([(9, 12.0, 47.0, 61.0, 1.0, 2.0, 22.0, 41.0)], schema)
    assert standardise_features(one, "id", stats_from=train).first()["menopause_age"] == 0.5


def test_age_bounds_count_alone(spark):
    rows = [(i, dt.date(2000, 1, 1), None, a, 0, 1.0) for i, a in enumerate((None, 30, 40, 50))]
    df = spark.createDataFrame(rows, "exam_id long, ts date, days_to_event long, age int, event_1yr int, survival_1yr double")

    def kept(**ages):
        out = df
        for _, cond in _steps(df, CohortRules(cohort_end="2001-01-01", **ages)):
            out = out.where(cond)
        return sorted(r["age"] for r in out.collect() if r["age"] is not None), out.count()

    assert kept(min_age=40) == ([40, 50], 2) and kept(max_age=40) == ([30, 40], 2) and kept() == ([30, 40, 50], 4)
    with pytest.raises(ValueError):
        _steps(df.drop("age"), CohortRules(cohort_end="2001-01-01", max_age=40))


def test_keep_first_prefers_known_values(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "Ana", None), (2, None, None)], "id long, name string, n long")
    assert {tuple(r) for r in first_row(df, "id").collect()} == {(1, "Ana", None), (2, None, None)}
    assert [r["id"] for r in unique_ids_only(df, "id").collect()] == [2]


def test_out_of_fold_never_scores_its_training_rows(spark):
    rows = [(i, i % 3, float(i % 2), [float(i % 2), float(i)]) for i in range(30)]
    df = risk.feature_vector(spark.createDataFrame(rows, "id long, fold int, label double, v array<double>"), "v", [])
    out = risk.out_of_fold(df, "fold", (0, 1, 2), risk.risk_estimator("logistic"), "id", "label")
    assert out.count() == 30 and out.select("id").distinct().count() == 30
    tried, scored = risk.search_trials(df.where("fold <> 0"), df.where("fold = 0"), "id", trials=2)
    assert len(tried) == 2 and scored.groupBy("trial").count().where("count = 10").count() == 2


def test_single_and_multiple_keys_are_told_apart_without_a_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "d")], "k int, v string")
    single, multi = split_single_multi(df, "k")
    assert [tuple(r) for r in single.collect()] == [(1, "a")]
    assert sorted(r.v for r in multi.collect()) == ["b", "b", "c", "d"]
    assert "Join" not in multi._jdf.queryExecution().executedPlan().toString()

"""Calibration by Newton steps and the randomised SVD against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.models import risk


def _newton(p, y, steps=60):
    x = np.column_stack([np.log(p), np.log(1 - p), np.ones(len(p))])
    penalty, t = np.diag([1.0, 1.0, 0.0]), np.zeros(3)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ t))
        t = t + np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + penalty, x.T @ (y - q) - penalty @ t)
    return t


def _frame(spark, p, y):
    return spark.createDataFrame([(float(a), None if b is None else int(b)) for a, b in zip(p, y)], "score double, label int")


def test_calibration_equals_direct_newton(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0.01, 0.99, 500), 2)  # ties
    y = (rng.uniform(size=500) < p**2).astype(int)
    got = risk.beta_calibration(_frame(spark, p, y).repartition(5), "score", "label")
    assert np.allclose([got.a, got.b, got.intercept], _newton(p, y), atol=1e-8)
    with_gaps = _frame(spark, [*p, 0.5], [*y, None]).unionByName(spark.createDataFrame([(None, 1)], "score double, label int"))
    again = risk.beta_calibration(with_gaps, "score", "label")
    assert (again.a, again.b, again.intercept) == pytest.approx((got.a, got.b, got.intercept), abs=1e-9)


def test_calibration_of_separable_and_extreme_scores_is_finite(spark):
    p, y = [0.0, 1e-300, 0.2, 0.4, 0.6, 0.9, 1.0], [0, 0, 0, 0, 1, 1, 1]
    df = _frame(spark, p, y)
    got = risk.beta_calibration(df, "score", "label")
    out = [r.pred_calibrated for r in risk.calibrate(got, df, "score").orderBy("score").collect()]
    assert all(math.isfinite(v) for v in (got.a, got.b, got.intercept))
    assert out == sorted(out) and out[0] < 0.1 and out[-1] > 0.9


def test_calibration_of_one_class_or_none(spark):
    df = _frame(spark, [0.2, 0.7], [1, 1])
    assert [r.pred_calibrated for r in risk.calibrate(risk.beta_calibration(df, "score", "label"), df, "score").collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        risk.beta_calibration(df.where("score > 2"), "score", "label")


@pytest.mark.parametrize("fan_in", [64, 3])
def test_svd_of_many_dimensions_and_partitions(spark, fan_in):
    m = np.random.default_rng(5).normal(size=(600, 70))  # a flat spectrum, the hard case for a range finder
    m[:, 0] *= 8
    df = spark.createDataFrame([(row.tolist(),) for row in m], "v array<double>").repartition(11)
    gaps = spark.createDataFrame([(None,), ([1.0] * 69 + [None],), ([float("nan")] * 70,), ([1.0],)], "v array<double>")
    got = risk.truncated_svd(df.unionByName(gaps), "v", 6, oversample=4, fan_in=fan_in)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(got.s.toArray(), s[:6], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(got.V.toArray() * vt[:6].T, axis=0)), 1, atol=1e-4)


def test_svd_of_few_equal_or_no_rows(spark):
    same = spark.createDataFrame([([3.0, 4.0, 0.0],)] * 5, "v array<double>")
    got = risk.truncated_svd(same, "v", 2)
    assert np.allclose(got.s.toArray(), [5 * math.sqrt(5), 0], atol=1e-6)
    assert np.allclose(got.V.toArray().T @ got.V.toArray(), np.eye(2), atol=1e-9)
    wide = spark.createDataFrame([(np.eye(50)[i].tolist(),) for i in (1, 2)], "v array<double>")
    assert np.allclose(risk.truncated_svd(wide, "v", 4).s.toArray(), [1, 1, 0, 0], atol=1e-6)
    with pytest.raises(ValueError):
        risk.truncated_svd(same.where(F.lit(False)), "v", 2)

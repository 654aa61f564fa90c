"""Perceptrons trained together have to be those of Spark ML, for the price of one."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.models import perceptron as P
from tidemark.models.search import START_TRIALS, Parameter, search


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(384, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    data = [(i, i % 3, float(y[i]), x[i].tolist()) for i in range(len(x))]
    frame = spark.createDataFrame(data, "id long, fold int, label double, v array<double>")
    return frame.coalesce(1).select("id", "fold", "label", array_to_vector("v").alias("features")).persist()


def flat(rows):
    return P.flat_rows(rows, "features", "label", "fold", "id").persist()


@pytest.mark.parametrize("solver, steps, near", [("gd", 15, 1e-9), ("l-bfgs", 6, 1e-5)])
def test_weights_are_those_of_spark_ml(spark, rows, solver, steps, near):
    layers = (3, 5, 4, 2)
    theirs = MultilayerPerceptronClassifier(layers=list(layers), maxIter=steps, stepSize=0.5, solver=solver, seed=42)
    theirs = theirs.fit(rows.where("fold <> 0")).weights.toArray()
    ours = P.fit_together(flat(rows), [P.Fit(layers, solver, 0.5, 0)], steps=steps)[0]
    assert np.abs(ours - theirs).max() < near


def test_fits_share_their_passes(spark, rows, monkeypatch):
    fits = [P.Fit((3, 4, 2), "l-bfgs", 0.1, k) for k in (0, 1)] + [P.Fit((3, 2, 2, 2), "gd", 0.5, 2)]
    calls, evaluate = [], P._evaluate
    monkeypatch.setattr(P, "_evaluate", lambda *a: calls.append(len(a[1])) or evaluate(*a))
    whole = flat(rows)
    alone, passes = [], []
    for f in fits:
        calls.clear()
        alone += P.fit_together(whole, [f], steps=5)
        passes.append(len(calls))
    calls.clear()
    for a, b in zip(alone, P.fit_together(whole, fits, steps=5), strict=True):
        assert np.abs(a - b).max() < 1e-9
    assert len(calls) == max(passes) and calls[0] == 3
    scored = P.score_together(whole, fits, alone, "id", "label").collect()
    assert sorted((r.fit, r.id) for r in scored) == sorted((k, i) for k in range(3) for i in range(384) if i % 3 == k)
    assert all(0 <= r.pred <= 1 for r in scored)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    x, y, layers = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float), (3, 4, 2)
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    got = P.gradient(layers, w, x, y)[1]
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        assert got[i] == pytest.approx((P.gradient(layers, w + e, x, y)[0] - P.gradient(layers, w - e, x, y)[0]) / 2e-6, abs=1e-5)


def test_no_rows_and_uneven_rows_are_errors(spark, rows):
    with pytest.raises(ValueError):
        P.fit_together(flat(rows.where("fold = 0")), [P.Fit((3, 2, 2), "gd", 0.1, 0)], steps=2)
    uneven = rows.withColumn("features", array_to_vector(F.array_repeat(F.lit(1.0), F.col("fold") + 1)))
    with pytest.raises(Exception, match="different lengths"):
        flat(uneven).count()


def test_random_trials_run_together(spark, tmp_path):
    space, sizes = [Parameter("rate", 1e-3, 1.0, log=True)], []
    one = lambda v: {"result": -abs(v["rate"] - 0.1)}
    table = search(spark, space, one, str(tmp_path / "a"), trials=START_TRIALS + 1, together=lambda vs: sizes.append(len(vs)) or [one(v) for v in vs])
    plain = search(spark, space, one, str(tmp_path / "b"), trials=START_TRIALS + 1)
    assert sizes == [START_TRIALS, 1] and sorted(table.collect()) == sorted(plain.collect())

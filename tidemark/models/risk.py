"""Risk models, search, cross-validation and calibration on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, NGram, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_path
from ..sources.writers import write_stage


#: The largest vocabulary size that Spark ML takes.
MOST_TERMS = 2**31 - 1
#: Vectors that one task of a text model's optimiser steps over, and the size of their blocks.
STEP_ROWS, STEP_BLOCK_MB = 4096, 32.0


def feature_vector(df: DataFrame, vector: str, extra: Sequence[str], name: str = "features") -> DataFrame:
    """History vector followed by the structured features."""
    tail = F.array(*[F.col(c).cast("double") for c in extra])
    return df.withColumn(name, array_to_vector(F.concat(F.col(vector).cast("array<double>"), tail)))


def risk_estimator(kind: str, *, inputs: int = 0, hidden: Sequence[int] = (16,), max_iter: int = 100, depth: int = 5, seed: int = 42) -> Estimator:
    """"logistic", "boosted" trees or a "perceptron"; ``inputs`` is its feature count.

    ``max_iter`` bounds the optimiser's steps (the number of trees when boosted).
    """
    if kind == "logistic":
        return LogisticRegression(regParam=0.01, maxIter=max_iter)
    if kind == "boosted":
        return GBTClassifier(maxIter=max_iter, maxDepth=depth, seed=seed)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=max_iter, seed=seed)
    raise ValueError(f"unknown model {kind!r}")


def predict(model: Model, df: DataFrame, *keep: str) -> DataFrame:
    """Kept columns and the probability of the event."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("pred"))


def search_trials(
    train: DataFrame, validation: DataFrame, *keep: str, trials: int = 3, max_iter: int = 100, seed: int = 42
) -> tuple[list[dict[str, float]], DataFrame]:
    """Sampled logistic parameters, and each trial's predictions for the validation rows.

    Rows are ``trial``, the parameters, ``keep`` and pred; nothing is scored on rows that a
    trial has learned from.
    """
    rng = random.Random(seed)
    tried = [{"reg": 10 ** rng.uniform(-4, 0), "elastic_net": rng.uniform(0, 1)} for _ in range(trials)]
    out = None
    for i, p in enumerate(tried):
        model = LogisticRegression(maxIter=max_iter, regParam=p["reg"], elasticNetParam=p["elastic_net"]).fit(train)
        part = predict(model, validation, *keep).select(
            F.lit(i).alias("trial"), F.lit(p["reg"]).alias("reg"), F.lit(p["elastic_net"]).alias("elastic_net"), *keep, "pred"
        )
        out = part if out is None else out.unionByName(part)
    return tried, out


def trial_metrics(scored: DataFrame, trial: Sequence[str], label: str = "label", *, within: Sequence[str] = ()) -> DataFrame:
    """Quality of each trial's predictions: trial columns, n, n_pos, n_neg, auroc, average_precision, in_bounds and is_best.

    ``scored`` has the columns of ``search_trials``. The best trial, one for each value of
    ``within``, has the highest AUROC (average precision where that is undefined); the first
    by ``trial`` among equals. A trial of one class has no AUROC; its average precision is 1
    if all its rows are events, else undefined.
    """
    from ..operators import evaluation as E

    by = [*within, *trial]
    sound = scored.groupBy(*by).agg(F.coalesce(F.bool_and(F.col("pred").between(0, 1)), F.lit(True)).alias("in_bounds"))
    quality = E.auroc_ap(E.score_counts(scored, "pred", label, by=by), "pred", by=by)
    precision = F.when(F.col("n_pos") > 0, F.coalesce("average_precision", F.lit(1.0)))
    each = quality.join(sound, by).withColumn("average_precision", precision)
    first = Window.partitionBy(*within, F.lit(0)).orderBy(F.coalesce("auroc", "average_precision").desc_nulls_last(), *trial)  # one row per trial
    return each.select(
        *by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", "auroc", "average_precision", "in_bounds",
        (F.row_number().over(first) == 1).alias("is_best"),
    )


def out_of_fold(df: DataFrame, fold: str, folds: Sequence[int], estimator: Estimator, *keep: str) -> DataFrame:
    """Predictions for every row from the model that was trained on the other folds."""
    out = None
    for k in folds:
        part = predict(estimator.fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), fold, *keep)
        out = part if out is None else out.unionByName(part)
    return out


def text_pipeline(text: str, label: str, stop_words: Sequence[str], *, ngrams: int = 1, max_features: int | None = None, min_df: float = 2.0, max_iter: int = 200) -> Pipeline:
    """TF-IDF of 1..n-grams at length 1 and class-balanced multinomial logistic regression (``class_weight`` column).

    ``max_features`` keeps the most frequent terms only; None keeps all within ``min_df``.
    """
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=2),
        StopWordsRemover(inputCol="_tok", outputCol="_g1", stopWords=list(stop_words)),
    ]
    stages += [NGram(n=n, inputCol="_g1", outputCol=f"_g{n}") for n in range(2, ngrams + 1)]
    vectors = []
    for n in range(1, ngrams + 1):
        stages += [
            CountVectorizer(inputCol=f"_g{n}", outputCol=f"_c{n}", vocabSize=max_features or MOST_TERMS, minDF=min_df),
            IDF(inputCol=f"_c{n}", outputCol=f"_v{n}"),
        ]
        vectors.append(f"_v{n}")
    stages += [
        VectorAssembler(inputCols=vectors, outputCol="_joined"), Normalizer(inputCol="_joined", outputCol="features"),
        LogisticRegression(labelCol=label, family="multinomial", regParam=0.01, maxIter=max_iter, weightCol="class_weight"),
    ]
    return Pipeline(stages=stages)


def fit_text_pipeline(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit a text pipeline; the optimiser of a regression at its end steps over staged vectors in few, large blocks.

    Every task of a step returns a gradient of terms x classes, and so does every block inside a task, so
    that a step over the partitions that the texts come in would mostly add up gradients.
    """
    *front, last = pipeline.getStages()
    prepared = Pipeline(stages=front).fit(train)
    rows = prepared.transform(train)
    if isinstance(last, LogisticRegression):
        picked = rows.select(last.getFeaturesCol(), last.getLabelCol(), last.getWeightCol())
        staged = write_stage(picked, stage_path(train.sparkSession, "text-vectors"))
        rows = staged.coalesce(max(1, -(-staged.count() // STEP_ROWS)))
        last = last.copy({last.maxBlockSizeInMB: STEP_BLOCK_MB})
    return PipelineModel(stages=[*prepared.stages, last.fit(rows)])


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return df.join(counts, label).withColumn("class_weight", total["n"] / (total["k"] * F.col("_n"))).drop("_n")


@dataclass(frozen=True)
class BetaCalibration:
    """Coefficients of ln p and ln(1-p), and the intercept of the logistic curve."""

    a: float
    b: float
    intercept: float


def _calibration_inputs(score: str) -> tuple[Column, Column]:
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.log(p), F.log(1 - p)


def _newton_sums(counts: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at ``theta``: one aggregation, ten numbers, whatever the row count."""
    x = [F.col("x1"), F.col("x2"), F.lit(1.0)]
    z = theta[0] * x[0] + theta[1] * x[1] + float(theta[2])
    share = 1 / (1 + F.exp(-z))
    rest, spread = F.col("pos") - F.col("n") * share, F.col("n") * share * (1 - share)
    loss = F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("pos") * z
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    row = counts.agg(F.sum(loss), *[F.sum(rest * c) for c in x], *[F.sum(spread * x[i] * x[j]) for i, j in upper]).first()
    curve = np.zeros((3, 3))
    for (i, j), v in zip(upper, row[4:]):
        curve[i, j] = curve[j, i] = v
    return row[0], np.array(row[1:4]), curve


def beta_calibration(validation: DataFrame, score: str, label: str, *, steps: int = 40, tol: float = 1e-11) -> BetaCalibration:
    """Logistic regression on ln p and ln(1-p), with an L2 penalty of one half per squared coefficient (C = 1).

    Newton steps, halved where the loss would grow, until a step is below ``tol`` or for
    ``steps`` evaluations. Rows are collapsed to counts per distinct score first. Rows without
    score or label are left out; a validation set of one class gives that class to every score, an
    empty one is an error.
    """
    x1, x2 = _calibration_inputs(score)
    known = validation.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    grouped = known.groupBy(x1.alias("x1"), x2.alias("x2")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col(label) == 1).cast("double").alias("pos")
    )
    counts = write_stage(grouped, stage_path(validation.sparkSession, "calibration"))
    n, pos = counts.agg(F.sum("n"), F.sum("pos")).first()
    if not n:
        raise ValueError("calibration needs scored rows with labels")
    if pos in (0, n):
        return BetaCalibration(0.0, 0.0, math.inf if pos else -math.inf)
    penalty = np.diag([1.0, 1.0, 0.0])
    theta, at, step = np.zeros(3), None, None
    for _ in range(steps):
        loss, gradient, curve = _newton_sums(counts, theta)
        loss += theta @ penalty @ theta / 2
        if at is not None and loss > at[1] + 1e-12 * abs(at[1]):
            step = step / 2
        else:
            at = theta, loss
            step = np.linalg.solve(curve + penalty, gradient - penalty @ theta)
        if np.abs(step).max() < tol:
            break
        theta = at[0] + step
    a, b, intercept = (float(v) for v in at[0])
    return BetaCalibration(a, b, intercept)


def calibrate(model: BetaCalibration, df: DataFrame, score: str, name: str = "pred_calibrated") -> DataFrame:
    x1, x2 = _calibration_inputs(score)
    return df.withColumn(name, 1 / (1 + F.exp(-(model.a * x1 + model.b * x2 + model.intercept))))


@dataclass(frozen=True)
class SingularVectors:
    """Singular values, largest first, and right vectors as columns."""

    s: DenseVector
    V: DenseMatrix


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'X times a block: each task sends one row per dimension, summed before the driver sees them."""
    dims, width = block.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, width))
        for x in _matrices(batches, dims):
            total += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims, dtype="int32")), *[pa.array(c) for c in total.T]], ["j", *[f"c{i}" for i in range(width)]]
        )

    schema = "j int, " + ", ".join(f"c{i} double" for i in range(width))
    sums = rows.mapInArrow(products, schema).groupBy("j").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])
    out = np.zeros((dims, width))
    for r in sums.collect():  # one row per dimension
        out[r["j"]] = r[1:]
    return out


def _triangle(rows: DataFrame, basis: np.ndarray, fan_in: int) -> np.ndarray:
    """The triangular factor of X times ``basis``: a tree of small QR factorisations, ``fan_in`` to a node."""
    dims, width = basis.shape
    fields = ", ".join(f"c{i} double" for i in range(width))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for x in _matrices(batches, dims):
            r = np.linalg.qr(np.vstack([r, x @ basis]), mode="r")
        node = np.full(len(r), TaskContext.get().partitionId(), dtype="int64")
        yield pa.RecordBatch.from_arrays([pa.array(node), *[pa.array(c) for c in r.T]], ["node", *[f"c{i}" for i in range(width)]])

    def merge(table: pa.Table) -> pa.Table:
        stacked = np.column_stack([table.column(i + 1).to_numpy() for i in range(width)])
        r = np.linalg.qr(stacked, mode="r")
        node = np.full(len(r), table.column(0)[0].as_py(), dtype="int64")
        return pa.table([pa.array(node), *[pa.array(c) for c in r.T]], names=["node", *[f"c{i}" for i in range(width)]])

    level = rows.mapInArrow(leaves, f"node long, {fields}")
    nodes = rows.rdd.getNumPartitions()
    while nodes > 1:
        level = level.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInArrow(merge, f"node long, {fields}")
        nodes = -(-nodes // fan_in)
    return np.array([r[1:] for r in level.collect()]).reshape(-1, width)


def truncated_svd(
    df: DataFrame, vector: str, dims: int, *, oversample: int = 10, tol: float = 1e-10, max_passes: int = 30, fan_in: int = 64, seed: int = 42
) -> SingularVectors:
    """The ``dims`` largest singular values and right vectors of the rows (no centring).

    A randomised block range finder: each pass over the rows multiplies the newest block by X'X in
    Arrow batches, the block is made orthogonal to the earlier ones, and passes go on until the
    values stand still or the blocks span all dimensions. The values come from the triangular factor of
    the projected rows, not from squares. Rows with a null vector, a null or non-finite component, or
    another length than the longest vector are left out; no rows at all are an error.
    """
    whole = df.select(F.col(vector).cast("array<double>").alias("v"))
    size = whole.agg(F.max(F.size("v"))).first()[0]
    if not size or size < 1:
        raise ValueError("no vectors")
    limit = F.lit(float("inf"))
    rows = whole.where((F.size("v") == size) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < limit)))
    dims = min(dims, size)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, dims + oversample))))[0]
    basis, image, before = block, np.zeros((size, 0)), None
    for _ in range(max_passes):
        product = _gram_product(rows, block)
        image = np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values)[:dims]
        now = np.sqrt(np.maximum(values[top], 0))
        if basis.shape[1] == size or (before is not None and np.abs(now - before).max() <= tol * max(now[0], 1e-300)):
            break
        before = now
        for _ in range(2):  # twice is enough for orthogonality
            product = product - basis @ (basis.T @ product)
        fresh, r = np.linalg.qr(product)
        fresh = fresh[:, np.abs(np.diag(r)) > 1e-13 * max(values.max(), 1e-300)][:, : size - basis.shape[1]]
        if fresh.shape[1] == 0:
            break
        fresh -= basis @ (basis.T @ fresh)
        block = np.linalg.qr(fresh)[0]
        basis = np.hstack([basis, block])
    right = basis[:, : turn.shape[0]] @ turn[:, top]
    _, s, vt = np.linalg.svd(_triangle(rows, right, fan_in), full_matrices=False)
    s, v = np.pad(s, (0, dims - len(s))), right @ (vt.T if len(s) == dims else np.eye(dims))
    return SingularVectors(DenseVector(s), DenseMatrix(size, dims, v.ravel(order="F").tolist()))


def project(df: DataFrame, vector: str, components: Sequence[Sequence[float]], name: str = "reduced") -> DataFrame:
    """Multiply vectors by a small component matrix."""
    from ..operators.evaluation import dot

    x = F.col(vector).cast("array<double>")
    return df.withColumn(name, F.array(*[dot(x, F.array(*[F.lit(float(v)) for v in comp])) for comp in components]))

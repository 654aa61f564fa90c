"""Perceptrons that are trained together: one pass over the staged rows is a step of every fit.

Networks, starting weights, loss and solvers are those of Spark ML's
``MultilayerPerceptronClassifier``, which fits one network at a time, row by row through its
layers. Here a pass multiplies whole Arrow batches, adds up one gradient for each fit and task,
and the driver holds the weights alone.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are multiplied at a time, and values of a gradient that are summed together.
STEP_ROWS, SLICE = 2048, 4096
#: Relative change of weights or loss that ends a fit, the solvers' memory and tries of a line search (as in Spark ML).
TOLERANCE, MEMORY, TRIES = 1e-6, 10, 10

Step = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Layer sizes, "l-bfgs" or "gd" with its rate, and the fold that the network does not learn from."""

    layers: tuple[int, ...]
    solver: str
    rate: float
    held: int


def flat_rows(rows: DataFrame, features: str, label: str, fold: str, *keep: str) -> DataFrame:
    """fold, label, x (the features' doubles as bytes) and the kept columns."""
    columns = [F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("label"), *keep]
    wide = rows.select(*columns, vector_to_array(features).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = batch.column(batch.num_columns - 1), batch.num_rows
            if len(pc.unique(pc.list_value_length(x))) > 1:
                raise ValueError("features of different lengths")
            values = x.flatten().to_numpy(zero_copy_only=False).astype("f8")
            ends = pa.array(np.arange(n + 1, dtype="i4") * (8 * len(values) // max(n, 1)))
            packed = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], batch.schema.names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema.fields[:-1])
    return wide.mapInArrow(pack, f"{schema}, x binary")


def _features(column: pa.Array, inputs: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, inputs))
    at = np.frombuffer(column.buffers()[1], "i4")[column.offset]
    return np.frombuffer(column.buffers()[2], "f8", len(column) * inputs, int(at)).reshape(-1, inputs)


def _layers(layers: Sequence[int], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice, slice]]:
    """Matrix and intercepts of each layer, and their places among the weights."""
    at = 0
    for a, b in pairwise(layers):
        matrix, intercept = slice(at, at + a * b), slice(at + a * b, at + a * b + b)
        yield weights[matrix].reshape(a, b), weights[intercept], matrix, intercept
        at += a * b + b


def forward(layers: Sequence[int], weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Values of all layers: sigmoids, and the softmax of the last one."""
    seen = [x]
    for matrix, intercept, *_ in _layers(layers, weights):
        z = seen[-1] @ matrix
        z += intercept
        if len(seen) < len(layers) - 1:
            np.negative(z, out=z)
            np.exp(np.minimum(z, 700, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        else:
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
        seen.append(z)
    return seen


def gradient(layers: Sequence[int], weights: np.ndarray, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' cross-entropy, and its gradient."""
    seen, out = forward(layers, weights, x), np.empty_like(weights)
    row, of = np.arange(len(x)), label.astype(np.int64)
    loss = -float(np.log(np.maximum(seen[-1][row, of], 1e-300)).sum())
    delta = seen[-1]
    delta[row, of] -= 1
    for (matrix, _, place, intercept), values in zip(reversed(list(_layers(layers, weights))), reversed(seen[:-1]), strict=True):
        out[place] = (values.T @ delta).ravel()
        out[intercept] = delta.sum(axis=0)
        if values is not x:
            delta = delta @ matrix.T
            delta *= values * (1 - values)
    return loss, out


def _sums(shared):
    """mapInArrow function: (fit, part, task, g) with the number of rows, the loss and the gradient of each fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, weights = shared.value
        total = [np.zeros(len(w) + 2) for w in weights]
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _features(batch.column(2), fits[0].layers[0])
            for k in np.unique(fold):
                rows = np.flatnonzero(fold == k)
                for at in range(0, len(rows), STEP_ROWS):
                    some = rows[at : at + STEP_ROWS]
                    part, of = x[some], label[some]
                    for f, w, t in zip(fits, weights, total, strict=True):
                        if f.held != k:
                            loss, g = gradient(f.layers, w, part, of)
                            t[0] += len(some)
                            t[1] += loss
                            t[2:] += g
        task = TaskContext.get().partitionId()
        for i, t in enumerate(total):
            parts = [t[at : at + SLICE] for at in range(0, len(t), SLICE)]
            n = len(parts)
            columns = [pa.array([i] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["fit", "part", "task", "g"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of one slice over all tasks, always in the same order."""
    table = table.sort_by("task")
    total = np.zeros(len(table["g"][0]))
    for g in table["g"]:
        total += g.values.to_numpy()
    return pa.table([table["fit"][:1], table["part"][:1], pa.array([total], pa.list_(pa.float64()))], names=["fit", "part", "g"])


def _evaluate(rows: DataFrame, fits: Sequence[Fit], weights: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Mean loss and gradient of each fit over the rows that it learns from, in one pass."""
    held = {f.held for f in fits}
    used = rows.where(F.col("fold") != held.pop()) if len(held) == 1 else rows
    shared = rows.sparkSession.sparkContext.broadcast((list(fits), list(weights)))
    sums = used.select("fold", "label", "x").mapInArrow(_sums(shared), "fit int, part int, task int, g array<double>")
    got = sums.groupBy("fit", "part").applyInArrow(_added, "fit int, part int, g array<double>").collect()  # the weights' size
    shared.destroy()
    out = []
    for i in range(len(fits)):
        flat = np.concatenate([np.zeros(0), *[r.g for r in sorted((r for r in got if r.fit == i), key=lambda r: r.part)]])
        if not len(flat) or not flat[0]:
            raise ValueError("a perceptron needs rows to learn from")
        out.append((flat[1] / flat[0], flat[2:] / flat[0]))
    return out


def _descent(w: np.ndarray, steps: int, rate: float) -> Step:
    for _ in range(steps):
        _, g = yield w
        before, w = w, w - rate * g
        if np.linalg.norm(w - before) < TOLERANCE * max(np.linalg.norm(w), 1):
            break
    return w


def _between(a: tuple, b: tuple) -> float:
    """The least point of the cubic through two points (place, loss, slope), not too near to either."""
    low, high = sorted((a, b), key=lambda p: p[0])
    d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (low[0] - high[0])
    d2 = np.sqrt(max(d1 * d1 - low[2] * high[2], 0))
    wide = high[0] - low[0]
    t = high[0] - wide * (high[2] + d2 - d1) / (high[2] - low[2] + 2 * d2)
    return float(np.clip(t, low[0] + 0.1 * wide, low[0] + 0.9 * wide)) if np.isfinite(t) else low[0] + wide / 2


def _line(w: np.ndarray, loss: float, g: np.ndarray, way: np.ndarray, t: float):
    """The weights, loss and gradient at a step along ``way`` that meets the strong Wolfe conditions; None if none is found."""
    slope = float(g @ way)
    low, high = (0.0, loss, slope), None
    if not slope < 0:
        return None
    for i in range(2 * TRIES):
        at = w + t * way
        value, now = yield at
        here = (t, value, float(now @ way))
        if not np.isfinite(here).all():
            t /= 2
            continue
        worse = value > loss + 1e-4 * t * slope or (value >= low[1] and (high is not None or i > 0))
        if not worse and abs(here[2]) <= 0.9 * abs(slope):
            return at, value, now
        if high is None and not worse and here[2] < 0:
            low, t = here, 1.5 * t
            continue
        if worse:
            high = here
        elif high is None:
            low, high = here, low
        else:
            low, high = here, (low if here[2] * (high[0] - low[0]) >= 0 else high)
        t = _between(low, high)
    return None


def _quasi_newton(w: np.ndarray, steps: int) -> Step:
    """L-BFGS; a line search that fails is tried once more without memory."""
    loss, g = yield w
    moved, turned, losses = [], [], [loss]
    for step in range(steps):
        for again in (False, True):
            way, parts = -g, []
            for s, y in zip(reversed(moved), reversed(turned), strict=True):
                parts.append((s @ way) / (s @ y))
                way = way - parts[-1] * y
            if moved:
                way = way * ((moved[-1] @ turned[-1]) / (turned[-1] @ turned[-1]))
            for s, y, a in zip(moved, turned, reversed(parts), strict=True):
                way = way + (a - (y @ way) / (s @ y)) * s
            found = yield from _line(w, loss, g, way, 1.0 if moved else 1 / max(np.linalg.norm(way), 1e-12))
            if found or again:
                break
            moved, turned = [], []
        if not found:
            break
        moved, turned = [*moved, found[0] - w][-MEMORY:], [*turned, found[2] - g][-MEMORY:]
        w, loss, g = found
        losses.append(loss)
        still = len(losses) > MEMORY and abs(loss - np.mean(losses[-MEMORY - 1 : -1])) <= TOLERANCE * abs(losses[0])
        if still or np.linalg.norm(g) <= max(TOLERANCE * abs(loss), 1e-8):
            break
    return w


@cache
def _start(layers: tuple[int, ...], seed: int) -> np.ndarray:
    """Spark ML's starting weights of a network."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(float(k), Vectors.dense([0.0] * layers[0])) for k in (0, 1)], ["label", "features"])
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=0, solver="gd", seed=seed).fit(rows).weights.toArray()


def fit_together(rows: DataFrame, fits: Sequence[Fit], *, steps: int, seed: int = 42) -> list[np.ndarray]:
    """Weights of each fit after ``steps`` steps; ``rows`` are staged ``flat_rows``, all fits have the same inputs.

    Every pass evaluates all fits that go on; a fit learns from all rows outside its held fold.
    """
    runs = [_quasi_newton(w, steps) if f.solver == "l-bfgs" else _descent(w, steps, f.rate) for f in fits for w in [_start(tuple(f.layers), seed)]]
    out: list = [None] * len(fits)
    asked: dict[int, np.ndarray] = {}

    def go_on(i: int, answer) -> None:
        try:
            asked[i] = runs[i].send(answer)
        except StopIteration as end:
            asked.pop(i, None)
            out[i] = end.value

    for i in range(len(fits)):
        go_on(i, None)
    while asked:
        these = sorted(asked)
        for i, answer in zip(these, _evaluate(rows, [fits[i] for i in these], [asked[i] for i in these]), strict=True):
            go_on(i, answer)
    return out


def score_together(rows: DataFrame, fits: Sequence[Fit], weights: Sequence[np.ndarray], *keep: str) -> DataFrame:
    """fit, the kept columns and pred: every fit's probability of label 1 for the rows of its held fold."""
    shared = rows.sparkSession.sparkContext.broadcast((list(fits), list(weights)))
    some = rows.where(F.col("fold").isin(sorted({f.held for f in fits})))
    wide = some.select("fold", "x", *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, weights = shared.value
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), _features(batch.column(1), fits[0].layers[0])
            for i, (f, w) in enumerate(zip(fits, weights, strict=True)):
                at = np.flatnonzero(fold == f.held)
                if len(at):
                    kept = [c.take(pa.array(at)) for c in batch.columns[2:]]
                    pred = forward(f.layers, w, x[at])[-1][:, 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, "i4")), *kept, pa.array(pred)], ["fit", *keep, "pred"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return wide.mapInArrow(run, f"fit int, {kept}, pred double")

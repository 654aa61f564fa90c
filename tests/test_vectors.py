"""History vectors and run sums against numpy; TF-IDF against a direct computation."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors as V


def _rows(seed=5):
    rng = random.Random(seed)
    start = dt.date(1990, 1, 1)
    rows = []
    for i in range(160):
        entity = 7 if i < 80 else rng.randrange(5)  # one entity holds half of the rows
        rows.append((entity, i, start + dt.timedelta(days=rng.randrange(9000) if i % 4 else 365 * (i % 3)), [rng.random() for _ in range(3)]))
    return rows


def _expected(rows, entity, day, how, months):
    low = None
    if months is not None:
        y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
        last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
        low = dt.date(y, m + 1, min(day.day, last)) if months else day
    past = [r for r in rows if r[0] == entity and r[2] <= day and (low is None or r[2] >= low)]
    gap = np.array([(day - r[2]).days for r in past], float)
    x = np.array([r[3] for r in past])
    span = gap.max() or 1.0
    w = {"mean": np.ones_like(gap), "exponential": np.exp(-0.01 * gap), "inverse": 1 / (1 + gap), "linear": np.clip(1 - gap / span, 0, 1)}[how]
    vec = (w[:, None] * x).sum(0) / w.sum()
    return np.append(vec, gap.mean()) if how == "mean" else vec


@pytest.mark.parametrize("how, months", [("mean", None), ("mean", 0), ("exponential", 24), ("inverse", None), ("linear", None), ("linear", 36)])
def test_history_vectors(spark, how, months):
    rows = _rows()
    df = spark.createDataFrame(rows, "e int, k int, ts date, v array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # tiles and runs cross batches
    try:
        out = V.history_vectors(df, df, "e", "ts", "v", how=how, lam=0.01, months=months).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len({(r[0], r[2]) for r in rows})
    for r in out:
        assert np.allclose(r.v, _expected(rows, r.e, r.ts, how, months)), (r.e, r.ts)


def test_sum_vectors_over_long_runs(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(1).cast("bigint").alias("n"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.k: (r.n, r.v) for r in V.sum_vectors(df, ["k"], ["n"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        ids = range(k, 1000, 3)
        assert got[k] == (len(ids), [float(sum(ids)), float(len(ids))])


def test_tfidf(spark):
    docs = ["azul azul verde", "verde preto", "azul preto preto o", "Verde branco a"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    counts = V.term_counts(df, "i", "t", ["preto"])
    vocabulary = V.fit_tfidf(counts, F.lit(4), min_df=2)
    got = {(r.i, r.term): r.weight for r in V.apply_tfidf(counts, vocabulary, "i").collect()}
    tf = [Counter(w for w in d.lower().split() if len(w) > 1 and w != "preto") for d in docs]
    dfreq = Counter(w for c in tf for w in c)
    for i, c in enumerate(tf):
        raw = {w: (math.log(n) + 1) * (math.log(5 / (dfreq[w] + 1)) + 1) for w, n in c.items() if dfreq[w] >= 2}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert got.pop((i, w)) == pytest.approx(v / norm)
    assert not got


def test_ngrams(spark):
    df = spark.createDataFrame([("um dois tres",)], "t string")
    assert df.select(V.terms(F.col("t"), [], (1, 3))).first()[0] == ["um", "dois", "tres", "um dois", "dois tres", "um dois tres"]


def test_history_vectors_move_rows_twice(spark):
    rows = [(e, dt.date(1980, 1, 1) + dt.timedelta(days=900 * k), [float(k), 1.0]) for e in range(3) for k in range(16)]
    df = spark.createDataFrame(rows, "e int, ts date, v array<float>")
    out = V.history_vectors(df, df, "e", "ts", "v", how="exponential", lam=0.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # by day as stored, then by entity; an entity's blocks are added up where they are
    assert plan.count("REPARTITION_BY_COL") == 2
    got = {(r.e, r.ts): r.v for r in out.collect()}
    assert len(got) == 48 and all(abs(got[e, ts][0] - v[0] / 2) < 1e-9 for e, ts, v in rows)

"""Ranks, quantiles and score evaluation against numpy and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import splits as P
from tidemark.operators.ordering import hash_rank, prefix_sums, quantiles, score_rank, top_n


def _scores(n=200, seed=3, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = 0.25 if ties and rng.random() < 0.35 else round(rng.uniform(-2, 2), 3)  # a third tied
        rows.append((i, i % 2, score, int(rng.random() < 0.3 + 0.1 * score)))
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, "id long, g int, score double, label int")


def test_prefix_sums_over_all_magnitudes(spark):
    values = sorted({0.0, -1.0, 1.0, 0.5, 2.0, 1e-9, -1e-9, 1e12, -3.75, 0.999999999999, 1.0000000001, 3, 4, 5, 1023.9999, 1024.0, 7e-300})
    df = spark.createDataFrame([(float(v), i + 1) for i, v in enumerate(values)], "v double, w long")
    got = {r.v: (r.below_w, r.total_w) for r in prefix_sums(df.repartition(3), "v", ["w"]).collect()}
    total = sum(range(1, len(values) + 1))
    for i, v in enumerate(values):
        assert got[v] == (sum(range(1, i + 1)), total)


def test_quantiles_equal_numpy(spark):
    rows = _scores()
    out = quantiles(_df(spark, rows), "score", {"a": 0.02, "m": 0.5, "z": 0.98}, by=["g"]).collect()
    for r in out:
        x = [s for _, g, s, _ in rows if g == r.g]
        assert np.allclose([r.a, r.m, r.z], np.percentile(x, [2, 50, 98]))


def test_ranks_are_total_and_repeatable(spark):
    rows = _scores()
    for parts in (1, 5):
        out = score_rank(_df(spark, rows).repartition(parts), "score", "id", by=["g"]).collect()
        for g in (0, 1):
            ranks = sorted((r["rank"], r.score, r.id) for r in out if r.g == g)
            assert [r[0] for r in ranks] == list(range(1, 101))
            assert [r[1] for r in ranks] == sorted((r[1] for r in ranks), reverse=True)
        current = {r.id: r["rank"] for r in out}
        assert parts == 1 or current == previous
        previous = current
    ranked = hash_rank(_df(spark, rows), "id", strata=["g"]).collect()
    assert sorted(r.hash_rank for r in ranked if r.g == 0) == list(range(1, 101))


def test_top_n(spark):
    rows = _scores()
    got = top_n(_df(spark, rows), ["g"], [F.desc("score"), F.col("id")], "id", 7).collect()
    for g in (0, 1):
        want = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:7]
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [w[0] for w in want]


def _auc(rows):
    pos, neg = [s for *_, s, y in rows if y], [s for *_, s, y in rows if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def _ap(rows):
    total, out = sum(y for *_, y in rows), 0.0
    for t in sorted({s for *_, s, _ in rows}, reverse=True):
        called = [y for *_, s, y in rows if s >= t]
        here = [y for *_, s, y in rows if s == t]
        out += sum(here) / total * (sum(called) / len(called))
    return out


def test_auroc_and_ap(spark):
    rows = _scores()
    got = E.auroc_ap(E.score_counts(_df(spark, rows), "score", "label"), "score").first()
    assert got.auroc == pytest.approx(_auc(rows)) and got.average_precision == pytest.approx(_ap(rows))
    flipped = _df(spark, [(i, g, -s, y) for i, g, s, y in rows])
    assert E.auroc_ap(E.score_counts(flipped, "score", "label"), "score").first().auroc == pytest.approx(1 - got.auroc)
    tied = _df(spark, [(1, 0, 0.5, 1), (2, 0, 0.5, 0)])
    assert E.auroc_ap(E.score_counts(tied, "score", "label"), "score").first().auroc == 0.5
    one = E.auroc_ap(E.score_counts(_df(spark, [(1, 0, 0.5, 1)]), "score", "label"), "score").first()
    assert one.auroc is None and one.average_precision is None


def test_topk_edges(spark):
    rows = [(1, 0, 0.9, 1), (2, 0, 0.8, 0), (3, 0, 0.7, 1), (4, 0, 0.1, 0)]
    ranked = score_rank(_df(spark, rows), "score", "id")
    at = lambda k: tuple(E.topk_metrics(ranked, "label", k).first())
    assert at(2) == (0.5, 0.5, 0.5) and at(0) == (0.0, 0.0, 1.0) and at(10) == (0.5, 1.0, 0.0)
    low = score_rank(_df(spark, rows), "score", "id", descending=False)
    assert tuple(E.bottomk_metrics(low, "label", 2).first()) == (0.5, 1)


def test_roc_interval_equals_interpolation(spark):
    rows = _scores(120)
    df = _df(spark, rows)
    weights = E.replicated(df, "id", 6).select("replicate", "weight", "score", "label").collect()
    curves = []
    for b in range(6):
        part = [(r.score, r.label, r.weight) for r in weights if r.replicate == b]
        fpr, tpr = [0.0], [0.0]
        pos = sum(w for _, y, w in part if y)
        neg = sum(w for _, y, w in part if not y)
        for t in sorted({s for s, *_ in part}, reverse=True):
            fpr.append(sum(w for s, y, w in part if s >= t and not y) / neg)
            tpr.append(sum(w for s, y, w in part if s >= t and y) / pos)
        grid = np.linspace(0, 1, 21)
        line = np.interp(grid, fpr, tpr)
        for i, x in enumerate(grid):  # at a vertical step the upper end counts
            at = [t for f, t in zip(fpr, tpr) if abs(f - x) < 1e-12]
            line[i] = max(at) if at else line[i]
        line[0] = 0.0
        curves.append(line)
    got = E.roc_curve_ci(df, "id", "score", "label", replicates=6, points=21).orderBy("k").collect()
    assert np.allclose([r.mean_tpr for r in got], np.mean(curves, axis=0), atol=1e-9)
    assert np.allclose([r.upper_tpr for r in got], np.percentile(curves, 97.5, axis=0), atol=1e-9)


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20000).select(E.poisson_weight(F.lit(1), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_splits_keep_entities_apart(spark):
    rows = [(i, i // 3, int(i % 17 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "exam long, entity long, event int")
    split = P.stratified_entity_split(df, "entity", "event", test_share=0.25)
    folds = P.stratified_kfold(split, "entity", "event", folds=4)
    roles = P.exam_roles(df, split, folds, "entity", "exam", n_folds=4).collect()
    owner = {r[0]: r[1] for r in rows}
    for fold in range(4):
        sides = {role: {owner[r.exam] for r in roles if r.role == role and r.fold in (fold, -1)} for role in ("train", "validation", "test")}
        assert not sides["train"] & sides["validation"] and not sides["train"] & sides["test"] and not sides["validation"] & sides["test"]
        assert len(set().union(*sides.values())) == 200
    by = {(r.event, r.split): r["count"] for r in split.groupBy("event", "split").count().collect()}
    assert by[(1, "test")] == 9 and by[(0, "test")] == 41  # a quarter of 36 and of 164 entities


def test_resampling_sizes(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(110)], "id long, label int")
    over = P.oversample_positive(df, "id", "label", 4).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in over} == {0: 100, 1: 25}
    under = P.undersample_negative(df, "id", "label", 3).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in under} == {0: 30, 1: 10}


def test_abstain(spark):
    rows = [(0.1, 0.2, 0.5, 0.1), (0.1, 0.2, 0.4, 0.1), (0.5, 0.2, 0.1, 0.1), (0.1, 0.1, 0.45, 0.9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = E.predict_with_abstain({1: F.col("a"), 2: F.col("b"), 4: F.col("c"), 5: F.col("d")}, {4: F.lit(0.45), 5: F.lit(0.95)}, rare=(4, 5))
    assert [tuple(r[0]) for r in df.select(out).collect()] == [
        (4, "rare_above_threshold"), (-1, "rare_below_threshold"), (1, "common_argmax"), (4, "rare_above_threshold")]

"""Risk-score evaluation: AUROC, average precision, ROC, top-K / bottom-K, bootstrap.

Rows are first collapsed to counts per distinct score by a map-side combine; cumulative
counts come from ``prefix_sums``.  A bootstrap replicate gives each row a Poisson(1)
weight from the hash of (replicate, id), the usual stand-in for drawing rows with
replacement, so no replicate moves whole rows around.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import hash_uniform
from .ordering import prefix_sums, quantiles, score_rank


def _poisson_steps(resolution: float = 2.0**-32) -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, ... draws, until the tail is below the hash's resolution."""
    steps, term, total, k = [], math.exp(-1), 0.0, 0
    while 1 - total > resolution:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


POISSON_STEPS = _poisson_steps()


def score_counts(df: DataFrame, score: str, label: str, *, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg) with weights summed."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("bigint").alias("neg"),
    )


def auroc_ap(counts: DataFrame, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUROC (ties count half) and average precision; null with one class only."""
    pre = prefix_sums(counts, score, ["pos", "neg"], by=by)
    wins = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)
    pos_at = F.col("total_pos") - F.col("below_pos")
    neg_at = F.col("total_neg") - F.col("below_neg")
    agg = pre.groupBy(*by).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
        F.sum(wins).alias("_wins"), F.sum(F.when(pos_at + neg_at > 0, F.col("pos") * pos_at / (pos_at + neg_at))).alias("_ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(
        *by, "n_pos", "n_neg",
        F.when(both, F.col("_wins") / F.col("n_pos") / F.col("n_neg")).alias("auroc"),
        F.when(both, F.col("_ap") / F.col("n_pos")).alias("average_precision"),
    )


def roc_points(counts: DataFrame, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    """FPR and TPR at every distinct threshold (called positive at or above it).

    A rate is null in a group that lacks the class it is a share of.
    """
    pre = prefix_sums(counts, score, ["pos", "neg"], by=by)
    above_neg, above_pos = F.col("total_neg") - F.col("below_neg"), F.col("total_pos") - F.col("below_pos")
    return pre.select(
        *by, F.col(score).alias("threshold"),
        F.try_divide(above_neg, F.col("total_neg")).alias("fpr"), F.try_divide(above_pos, F.col("total_pos")).alias("tpr"),
        # the neighbouring point with the next higher threshold
        F.try_divide(above_neg - F.col("neg"), F.col("total_neg")).alias("fpr_before"),
        F.try_divide(above_pos - F.col("pos"), F.col("total_pos")).alias("tpr_before"),
    )


def poisson_weight(replicate: Column, row_id: Column, seed: str = "boot") -> Column:
    u = hash_uniform(seed, replicate, row_id)
    return sum((F.when(u > step, 1).otherwise(0) for step in POISSON_STEPS), F.lit(0))


def replicated(df: DataFrame, row_id: str, replicates: int, *, seed: str = "boot") -> DataFrame:
    """Rows with positive bootstrap weight per replicate (``replicate``, ``weight``)."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return out.withColumn("weight", poisson_weight(F.col("replicate"), F.col(row_id), seed)).where(F.col("weight") > 0)


def roc_curve_ci(
    df: DataFrame, row_id: str, score: str, label: str, *, replicates: int = 10, points: int = 100, by: Sequence[str] = ()
) -> DataFrame:
    """Mean, deviation and 95 % limits of TPR on a fixed FPR grid over bootstrap replicates.

    One-class replicates are skipped.
    """
    keys = [*by, "replicate"]
    boot = score_counts(replicated(df, row_id, replicates), score, label, by=keys, weight=F.col("weight"))
    roc = roc_points(boot, score, by=keys).where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    # Grid points covered by the segment from (fpr_before, tpr_before) to (fpr, tpr).
    last = points - 1
    first_k = F.floor(F.col("fpr_before") * last).cast("int")
    last_k = F.ceil(F.col("fpr") * last).cast("int")
    step = F.transform(F.sequence(first_k, last_k), lambda k: F.struct(k.alias("k"), (k / F.lit(float(last))).alias("x")))
    inside = F.filter(step, lambda s: (s["x"] >= F.col("fpr_before")) & (s["x"] <= F.col("fpr")))
    segment = roc.withColumn("s", F.explode(inside))
    width = F.col("fpr") - F.col("fpr_before")
    value = F.when(width > 0, F.col("tpr_before") + (F.col("s.x") - F.col("fpr_before")) / width * (F.col("tpr") - F.col("tpr_before"))).otherwise(F.col("tpr"))
    curve = segment.groupBy(*keys, F.col("s.k").alias("k")).agg(F.max(value).alias("tpr"))
    curve = curve.withColumn("tpr", F.when(F.col("k") == 0, 0.0).otherwise(F.col("tpr")))
    # The number of values per grid point is the number of replicates, a small parameter.
    return curve.groupBy(*by, "k").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"),
        F.percentile("tpr", F.lit(0.025)).alias("lower_tpr"), F.percentile("tpr", F.lit(0.975)).alias("upper_tpr"),
    ).withColumn("fpr", F.col("k") / F.lit(float(last)))


def auroc_ci(df: DataFrame, row_id: str, score: str, label: str, *, replicates: int = 10, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "replicate"]
    boot = score_counts(replicated(df, row_id, replicates), score, label, by=keys, weight=F.col("weight"))
    each = auroc_ap(boot, score, by=keys).where(F.col("auroc").isNotNull())
    return curve_ci(each, "auroc", by=by)


def curve_ci(values: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, 2.5 and 97.5 percentiles per grid point."""
    stats = values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    limits = quantiles(values, value, {"lower": 0.025, "upper": 0.975}, by=by)
    if by:
        return stats.join(limits, list(by))
    ends = limits.select(F.struct("lower", "upper")).scalar()
    return stats.select("mean", "std", ends["lower"].alias("lower"), ends["upper"].alias("upper"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def topk_metrics(ranked: DataFrame, label: str, k: int, *, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and specificity when the first ``k`` ranks are called positive."""
    called = F.col("rank") <= k
    agg = ranked.groupBy(*by).agg(
        F.count_if(called & (F.col(label) == 1)).alias("tp"), F.count_if(called & (F.col(label) == 0)).alias("fp"),
        F.count_if(~called & (F.col(label) == 0)).alias("tn"), F.count_if(~called & (F.col(label) == 1)).alias("fn"),
    )
    return agg.select(
        *by, _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def bottomk_metrics(ranked: DataFrame, label: str, k: int, *, by: Sequence[str] = ()) -> DataFrame:
    """NPV and false negatives among the ``k`` lowest scores (ranks ascending)."""
    called = F.col("rank") <= k
    agg = ranked.groupBy(*by).agg(
        F.count_if(called & (F.col(label) == 0)).alias("tn"), F.count_if(called & (F.col(label) == 1)).alias("fn")
    )
    return agg.select(*by, _ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"), F.col("fn").alias("false_negatives"))


def _grid(df: DataFrame, row_id: str, score: str, label: str, k: int, share: float, descending: bool, by: Sequence[str]) -> DataFrame:
    """Counts of positives and rows in the first j*k ranks, per grid step j."""
    ranked = score_rank(df, score, row_id, by=by, descending=descending)
    steps = ranked.withColumn("step", F.ceil(F.col("rank") / k)).groupBy(*by, "step").agg(
        F.sum(label).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    pre = prefix_sums(steps, "step", ["pos", "rows"], by=by)
    limit = F.floor(F.floor(F.col("total_rows") * F.lit(share)) / k) + 1
    return pre.where(F.col("step") <= limit).select(
        *by, (F.col("step") * k).cast("bigint").alias("k"),
        (F.col("step") * k * 100.0 / F.col("total_rows")).alias("k_percent"),
        (F.col("below_pos") + F.col("pos")).alias("tp"), (F.col("below_rows") + F.col("rows")).alias("called"),
        F.col("total_pos"), F.col("total_rows"),
    )


def topk_curve(df: DataFrame, row_id: str, score: str, label: str, *, k: int = 100, share: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and specificity on the grid k, 2k, ... up to a share of the rows."""
    g = _grid(df, row_id, score, label, k, share, True, by)
    negatives = F.col("total_rows") - F.col("total_pos")
    return g.select(
        *by, "k", "k_percent", _ratio(F.col("tp"), F.col("called")).alias("precision"),
        _ratio(F.col("tp"), F.col("total_pos")).alias("recall"),
        _ratio(negatives - (F.col("called") - F.col("tp")), negatives).alias("specificity"),
    )


def bottomk_curve(df: DataFrame, row_id: str, score: str, label: str, *, k: int = 100, share: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """NPV and false negatives on the grid of lowest scores."""
    g = _grid(df, row_id, score, label, k, share, False, by)
    return g.select(*by, "k", "k_percent", _ratio(F.col("called") - F.col("tp"), F.col("called")).alias("npv"), F.col("tp").alias("false_negatives"))


def _bootstrap_cut(df: DataFrame, row_id: str, score: str, label: str, k: int, replicates: int, descending: bool) -> DataFrame:
    """Per replicate: called positives/rows among the first k drawn rows, with totals.

    Drawn copies of equal score are interchangeable up to which label is cut at k; the cut
    score contributes its positives in proportion.
    """
    boot = score_counts(replicated(df, row_id, replicates), score, label, by=["replicate"], weight=F.col("weight"))
    both = boot.withColumn("rows", F.col("pos") + F.col("neg"))
    pre = prefix_sums(both, score, ["pos", "rows"], by=["replicate"])
    ahead = F.col("total_rows") - F.col("below_rows") - F.col("rows") if descending else F.col("below_rows")
    taken = F.greatest(F.least(F.lit(k) - ahead, F.col("rows")), F.lit(0))
    return pre.groupBy("replicate").agg(
        F.sum(F.col("pos") * taken / F.col("rows")).alias("tp"), F.sum(taken).alias("called"),
        F.max("total_pos").alias("total_pos"), F.max("total_rows").alias("total_rows"),
    )


def topk_bootstrap(df: DataFrame, row_id: str, score: str, label: str, k: int, *, replicates: int = 50) -> DataFrame:
    """(metric, mean, std, lower, upper) over bootstrap replicates at the top k."""
    cut = _bootstrap_cut(df, row_id, score, label, k, replicates, True)
    neg = F.col("total_rows") - F.col("total_pos")
    return _metric_ci(cut, {
        "precision": _ratio(F.col("tp"), F.col("called")), "recall": _ratio(F.col("tp"), F.col("total_pos")),
        "specificity": _ratio(neg - (F.col("called") - F.col("tp")), neg),
    })


def bottomk_bootstrap(df: DataFrame, row_id: str, score: str, label: str, k: int, *, replicates: int = 50) -> DataFrame:
    cut = _bootstrap_cut(df, row_id, score, label, k, replicates, False)
    return _metric_ci(cut, {"npv": _ratio(F.col("called") - F.col("tp"), F.col("called")), "false_negatives": F.col("tp").cast("double")})


def _metric_ci(cut: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    long = cut.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics.items()])).alias("m"))
    return curve_ci(long.select("m.metric", "m.value"), "value", by=["metric"])


def fold_metric_join(curve: DataFrame, *, by: str = "fold", split: str = "split", on: str = "k") -> DataFrame:
    """Validation and test curves side by side, columns suffixed by the split."""
    values = [c for c in curve.columns if c not in (by, split, on)]
    side = lambda s: curve.where(F.col(split) == s).select(by, on, *[F.col(c).alias(f"{c}_{s}") for c in values])
    return side("validation").join(side("test"), [by, on], "left")


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # The confusion table has (number of classes)^2 rows.
    marks = F.array(
        F.struct(F.col("y").alias("class"), F.lit(1).alias("is_y"), (F.col("y") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("is_p")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("is_y"), F.lit(0).alias("hit"), F.lit(1).alias("is_p")),
    )
    per = cells.select("n", F.explode(marks).alias("m")).groupBy(F.col("m.class").alias("class")).agg(
        F.sum(F.col("n") * F.col("m.hit")).alias("tp"), F.sum(F.col("n") * F.col("m.is_y")).alias("support"),
        F.sum(F.col("n") * F.col("m.is_p")).alias("called"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    return per.select("class", precision.alias("precision"), recall.alias("recall"),
                      _ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support")


THRESHOLD_GRID = [0.1 + 0.89 * i / 39 for i in range(40)]


def class_thresholds(proba: DataFrame, label: str, klass: str, p: str) -> DataFrame:
    """Per class the threshold of the 40-point grid with the best F1; the first wins on ties.

    ``proba`` holds one row per (row, class): true label, class, probability.
    """
    passed = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in THRESHOLD_GRID), F.lit(0))
    cells = proba.select(F.col(klass).alias("class"), (F.col(label) == F.col(klass)).cast("int").alias("hit"), passed.alias("passed"))
    small = cells.groupBy("class", "passed").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    # At most 41 rows per class: a row passing j thresholds is called positive at the first j of them.
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(THRESHOLD_GRID)])
    at = small.withColumn("g", F.explode(grid))
    called = F.col("passed") > F.col("g.i")
    per = at.groupBy("class", "g").agg(
        F.sum(F.when(called, F.col("tp")).otherwise(0)).alias("tp"), F.sum(F.when(called, F.col("n")).otherwise(0)).alias("called"),
        F.sum("tp").alias("support"),
    )
    f1 = _ratio(2 * F.col("tp"), F.col("called") + F.col("support"))
    best = per.withColumn("f1", f1).groupBy("class").agg(F.max(F.struct("f1", (-F.col("g.i")).alias("neg"), F.col("g.t").alias("t"), "tp", "called", "support")).alias("b"))
    return best.select(
        "class", F.when(F.col("b.f1") > 0, F.col("b.t")).otherwise(0.0).alias("threshold"),
        _ratio(F.col("b.tp"), F.col("b.called")).alias("precision"), _ratio(F.col("b.tp"), F.col("b.support")).alias("recall"), F.col("b.f1").alias("f1"),
    )


REVIEW = -1


def predict_with_abstain(proba: dict[int, Column], thresholds: dict[int, Column], rare: Sequence[int] = (4, 5, 6)) -> Column:
    """struct(code, reason): rare class above its threshold, review, or best common class."""
    hits = [F.when(proba[c] >= thresholds[c], F.struct(proba[c].alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c"))) for i, c in enumerate(rare) if c in proba]
    best_rare = F.array_max(F.array(*hits))
    ordered = lambda cs: F.array_max(F.array(*[F.struct(proba[c].alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(cs)]))
    top = ordered(sorted(proba))
    common = ordered([c for c in sorted(proba) if c not in rare])
    answer = lambda c, why: F.struct(c.alias("code"), F.lit(why).alias("reason"))
    return (
        F.when(best_rare.isNotNull(), answer(best_rare["c"], "rare_above_threshold"))
        .when(top["c"].isin(*rare), answer(F.lit(REVIEW), "rare_below_threshold"))
        .otherwise(answer(common["c"], "common_argmax"))
    )


def block_reliance(text_attr: Column, struct_attr: Column) -> Column:
    """struct(text, struct, share): absolute attribution mass of two blocks."""
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
    t, s = mass(text_attr), mass(struct_attr)
    return F.struct(t.alias("text_contrib"), s.alias("struct_contrib"), (t / (t + s + 1e-12)).alias("text_share"))


def linear_attribution(x: Column, baseline: Column, coef: Column) -> Column:
    """coef * (x - baseline) per feature: exact for a model that is linear in the logit."""
    return F.zip_with(F.zip_with(x, baseline, lambda a, b: a - b), coef, lambda d, c: d * c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def top_terms(terms: Column, values: Column, floor: float = 1e-4) -> Column:
    """Terms with |value| above a floor, by falling |value|."""
    pairs = F.filter(F.arrays_zip(terms.alias("term"), values.alias("value")), lambda p: F.abs(p["value"]) > floor)
    keyed = F.transform(pairs, lambda p: F.struct((-F.abs(p["value"])).alias("o"), p["term"].alias("term"), p["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["term"].alias("term"), p["value"].alias("value")))

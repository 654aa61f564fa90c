"""Entity splits without leakage, quotas and class resampling, all in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import hash_rank


def entity_labels(rows: DataFrame, entity: str, event: str) -> DataFrame:
    """One row per entity; its label is 1 if any of its rows has the event."""
    return rows.groupBy(entity).agg(F.max(event).alias(event))


def stratified_entity_split(
    rows: DataFrame, entity: str, event: str, *, test_share: float = 0.2, seed: int | str = 42
) -> DataFrame:
    """Each entity in exactly one of train / test, with the same share per stratum."""
    ranked = hash_rank(entity_labels(rows, entity, event), entity, strata=[event], seed=seed, name="_r", total="_n")
    cut = F.ceil(F.col("_n") * test_share)
    return ranked.select(entity, event, F.when(F.col("_r") <= cut, "test").otherwise("train").alias("split"))


def stratified_kfold(split: DataFrame, entity: str, event: str, *, folds: int = 5, seed: int | str = 43) -> DataFrame:
    """Validation fold of every training entity, balanced per stratum."""
    train = split.where(F.col("split") == "train")
    ranked = hash_rank(train, entity, strata=[event], seed=seed, name="_r")
    return ranked.select(entity, event, ((F.col("_r") - 1) % folds).cast("int").alias("fold"))


def exam_roles(rows: DataFrame, split: DataFrame, folds: DataFrame, entity: str, exam: str, *, n_folds: int = 5) -> DataFrame:
    """(exam, fold, role): test exams have fold -1; others are validation once, train otherwise."""
    per_entity = split.select(entity, "split").join(folds.select(entity, "fold"), entity, "left")
    base = rows.select(exam, entity).join(per_entity, entity)
    role = F.when(F.col("split") == "test", F.array(F.struct(F.lit(-1).alias("fold"), F.lit("test").alias("role")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_folds - 1)),
            lambda k: F.struct(k.cast("int").alias("fold"), F.when(k == F.col("fold"), "validation").otherwise("train").alias("role")),
        )
    )
    return base.select(exam, F.explode(role).alias("r")).select(exam, "r.fold", "r.role")


def capped_per_class(rows: DataFrame, row_id: str, klass: str, cap: int, *, seed: int | str = 42) -> DataFrame:
    """At most ``cap`` rows per class (a sampling operator)."""
    return hash_rank(rows, row_id, strata=[klass], seed=seed, name="_r").where(F.col("_r") <= cap).drop("_r")


def fit_corpus(
    rows: DataFrame, row_id: str, code: str, *, ratio: int = 4, seed: int | str = 42
) -> DataFrame:
    """All severe rows (4-6), ratio x as many benign (1-3), as many inconclusive (0) as severe."""
    group = F.when(F.col(code).isin(4, 5, 6), "severe").when(F.col(code).isin(1, 2, 3), "benign").when(F.col(code) == 0, "inconclusive")
    marked = rows.withColumn("stratum", group).where(F.col("stratum").isNotNull())
    severe = marked.agg(F.count_if(F.col("stratum") == "severe").alias("n")).scalar()
    ranked = hash_rank(marked, row_id, strata=["stratum"], seed=seed, name="_r")
    quota = F.when(F.col("stratum") == "benign", severe * ratio).otherwise(severe)
    return ranked.where(F.col("_r") <= quota).drop("_r")


def undersample_negative(rows: DataFrame, row_id: str, label: str, ratio: int, *, seed: int | str = 42) -> DataFrame:
    """All positives and ratio x as many negatives."""
    positives = rows.agg(F.sum(label).alias("n")).scalar()
    ranked = hash_rank(rows, row_id, strata=[label], seed=seed, name="_r")
    return ranked.where((F.col(label) == 1) | (F.col("_r") <= positives * ratio)).drop("_r")


def oversample_positive(rows: DataFrame, row_id: str, label: str, ratio: int, *, seed: int | str = 42) -> DataFrame:
    """Positives repeated to negatives / ratio rows; the first ones in hash order once more."""
    n = rows.agg(F.struct(F.sum(label).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).alias("n")).scalar()
    goal = F.floor(n["neg"] / ratio)
    ranked = hash_rank(rows, row_id, strata=[label], seed=seed, name="_r")
    whole = F.coalesce(F.floor(F.try_divide(goal, n["pos"])), F.lit(0))  # without positives there is nothing to repeat
    copies = F.when(F.col(label) == 1, whole + F.when(F.col("_r") <= goal - whole * n["pos"], 1).otherwise(0)).otherwise(F.lit(1))
    repeated = F.array_repeat(F.lit(1), copies.cast("int"))
    return ranked.withColumn("_c", F.explode(repeated)).drop("_c", "_r")

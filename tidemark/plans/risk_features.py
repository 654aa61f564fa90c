"""The table that risk models learn from: everything known at an index exam, its label and its fold.

History vectors are as-of means over the look-back, by sums per (entity, day); answers and
counts are as-of too. Nothing dated after the index exam enters a feature. Folds go by entity,
so no entity is on both sides of a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import splits as P
from ..operators.cohort import earliest_event_date
from ..operators.vectors import history_vectors

#: Structured features after the history vector.
STRUCTURED = ("code", "n_prior", "n_answers", "children", "flag")


def risk_features(
    exams: DataFrame, confirmations: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], answers: DataFrame, *,
    months: int = 36, target_months: int = 24, folds: int = 3, answered: Sequence[str] = ("children", "flag"),
) -> DataFrame:
    """One row per index exam before the entity's event: ids, label, split, fold, history vector and structured features.

    ``exams``: entity_id, exam_id, ts, code; ``confirmations``: entity_id, ts, result;
    ``vectors``: entity_id, ts, vector, or a function that gives them for exams (entity_id, exam_id, ts);
    it is asked for the exams that some index exam looks back on, so that no other vector is moved.
    ``answers``: entity_id, ts and the ``answered`` columns.
    The label is 1 if the event falls within ``target_months`` after the exam. ``fold`` is -1
    for entities of the test split. A history without vectors gives a null vector.
    """
    index = H.explode_index_exams(exams, "entity_id", "ts", "exam_id", "code").select("entity_id", "exam_id", "ts", "code", "n_prior")
    events = earliest_event_date(exams, confirmations, "entity_id", "ts", "code", "result").select("entity_id", "event_date")
    rows = index.join(events, "entity_id", "left").where(F.col("event_date").isNull() | (F.col("event_date") > F.col("ts")))
    within = F.col("event_date") <= F.add_months("ts", target_months)
    rows = rows.withColumn("label", F.coalesce(within, F.lit(False)).cast("int")).drop("event_date")
    known = H.point_in_time_features(rows, answers, "entity_id", "ts", "ts", list(answered))
    if callable(vectors):
        vectors = vectors(looked_back_on(exams, rows, months))
    past = history_vectors(rows, vectors, "entity_id", "ts", "vector", how="mean", months=months).select(
        "entity_id", "ts", F.col("vector").alias("history")
    )
    split = P.stratified_entity_split(rows, "entity_id", "label")
    fold = P.stratified_kfold(split, "entity_id", "label", folds=folds).select("entity_id", "fold")
    side = split.select("entity_id", "split").join(fold, "entity_id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    # the wide vectors are joined last, so that they move once
    out = known.join(side, "entity_id").join(past, ["entity_id", "ts"], "left")
    return out.select(*known.columns, "history", "split", "fold")


def looked_back_on(exams: DataFrame, index: DataFrame, months: int) -> DataFrame:
    """entity_id, exam_id and ts of the exams from the look-back of an entity's first index exam to its last one."""
    day = F.col("ts").cast("date")
    reach = index.groupBy("entity_id").agg(F.add_months(F.min(day), -months).alias("_first"), F.max(day).alias("_last"))
    return exams.join(reach, "entity_id").where(day.between(F.col("_first"), F.col("_last"))).select("entity_id", "exam_id", "ts")


def model_rows(table: DataFrame, dims: int, structured: Sequence[str] = STRUCTURED) -> DataFrame:
    """exam_id, entity_id, split, fold, label and the feature vector; unknown values are -1, an absent history is 0."""
    from pyspark.ml.functions import array_to_vector

    none = F.array_repeat(F.lit(0.0), dims)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in structured])
    return table.select(
        "exam_id", "entity_id", "split", "fold", F.col("label").cast("double").alias("label"),
        array_to_vector(F.concat(F.coalesce("history", none), values)).alias("features"),
    )

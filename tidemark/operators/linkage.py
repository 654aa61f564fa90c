"""Record linkage of persons and patients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import birthdate_similarity, name_similarity, normalize_name, pair_score
from .relational import first_row

EXAM_THRESHOLD = 0.85
COHORT_THRESHOLD = 0.86


def score_pairs(
    pairs: DataFrame, persons: DataFrame, patients: DataFrame, *, person: str = "person_id", patient: str = "patient_id"
) -> DataFrame:
    """Similarity of every candidate (person, patient) pair.

    Pairs come from the id links, never from a product of the two tables.  Fuzzy ratios are
    computed once per distinct name pair, in Arrow batches.
    """
    left = first_row(persons.select(person, "person_name", "person_birth"), person)
    right = first_row(
        patients.select(patient, "patient_name", "patient_birth").where(
            F.col("patient_birth").between(F.lit("1880-01-01").cast("date"), F.lit("2040-01-01").cast("date"))
        ),
        patient,
    )
    wide = (
        pairs.select(person, patient).distinct().join(left, person, "left").join(right, patient, "left")
        .withColumn("_a", normalize_name(F.col("person_name")))
        .withColumn("_b", normalize_name(F.col("patient_name")))
    )
    names = wide.select("_a", "_b").distinct().withColumn("name_similarity", name_similarity(F.col("_a"), F.col("_b")))
    return (
        wide.join(names, ["_a", "_b"])
        .withColumn("birth_similarity", birthdate_similarity(F.col("person_birth"), F.col("patient_birth")))
        .withColumn("similarity", pair_score(F.col("name_similarity"), F.col("birth_similarity")))
        .drop("_a", "_b")
    )


def consistent_pairs(scored: DataFrame, threshold: float, *, person: str = "person_id", patient: str = "patient_id") -> DataFrame:
    return scored.where(F.col("similarity") >= threshold).select(person, patient)

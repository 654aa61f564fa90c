"""Master data: linked person/patient pairs, payments and person features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sex_code, zip_prefix
from ..operators.cohort import age_in_years
from ..operators.linkage import COHORT_THRESHOLD, consistent_pairs, score_pairs
from ..operators.relational import first_row


def user_payments(users: DataFrame) -> DataFrame:
    """Per person: user codes, first reference date, smallest and largest payment.

    Users are first reduced to one row per person and code.
    """
    once = first_row(users, ["person_id", "user_code"])
    return once.groupBy("person_id").agg(
        F.count("user_code").alias("n_users"), F.min("user_code").alias("first_user"),
        F.array_sort(F.collect_set("user_code")).alias("user_codes"),
        F.min("reference_date").alias("reference_date"),
        F.min("payment").alias("payment_min"), F.max("payment").alias("payment_max"),
    )


def person_features(persons: DataFrame) -> DataFrame:
    """One row per person with sex code and zip category."""
    return first_row(persons, "person_id").withColumn("sex_code", sex_code(F.col("sex"))).withColumn(
        "zip_category", zip_prefix(F.col("zip"))
    )


def masters(persons: DataFrame, patients: DataFrame, users: DataFrame, threshold: float = COHORT_THRESHOLD) -> dict[str, DataFrame]:
    """The four master tables: similarity, valid pairs, users, persons."""
    scored = score_pairs(patients, persons, patients)
    return {
        "similarity": scored,
        "valid_pairs": consistent_pairs(scored, threshold),
        "users": user_payments(users),
        "persons": person_features(persons),
    }


def merge_sources(
    histories: DataFrame, users: DataFrame, persons: DataFrame, confirmations: DataFrame, answers: DataFrame
) -> DataFrame:
    """One row per entity: history facts with payments, person, confirmation and questionnaire facts.

    All inputs hold one row per ``entity_id``; rows without an age at the first exam drop out.
    """
    return (
        histories.join(users, "entity_id", "left")
        .join(persons, "entity_id", "left")
        .withColumn("age_at_first", age_in_years(F.col("birth"), F.col("first_exam_date")))
        .where(F.col("age_at_first").isNotNull())
        .join(confirmations, "entity_id", "left")
        .join(answers, "entity_id", "left")
    )

"""From raw exams and confirmations to the eligible index exams, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators.history import explode_index_exams, truncate_at_first_high
from ..operators.relational import unique_ids_only


@dataclass(frozen=True)
class CohortRules:
    cohort_end: str
    start_date: str = "1900-01-01"
    min_age: int | None = None
    max_age: int | None = None
    grace_days: int | None = None
    code5_version: int = 1
    code5_grace_days: int = 7
    code5_months: int = 6
    threshold: int = 4


def labelled_index_exams(
    exams: DataFrame, confirmations: DataFrame, rules: CohortRules, births: DataFrame | None = None
) -> DataFrame:
    """Index exams with event date, yearly labels, follow-up flags and survival times.

    ``exams``: entity_id, exam_id, ts, code.  ``confirmations``: entity_id, ts, result.
    ``births`` (entity_id, birth; one row per entity) adds the age in whole years.
    """
    confirmations = C.confirmation_days(confirmations, "entity_id", "ts", "result")
    index = explode_index_exams(exams, "entity_id", "ts", "exam_id", "code", threshold=rules.threshold)
    events = C.earliest_event_date(
        exams, confirmations, "entity_id", "ts", "code", "result",
        version=rules.code5_version, grace_days=rules.code5_grace_days, months=rules.code5_months,
    )
    kept = truncate_at_first_high(exams, "entity_id", "ts", "exam_id", "code", threshold=rules.threshold)
    seen = C.followup_counts(kept, exams, confirmations, "entity_id", "ts", "code", "result")
    # Event dates are attached per index day, so index rows are only joined on (entity, day).
    days = seen.join(events, "entity_id", "left")
    if births is not None:
        days = days.join(births.select("entity_id", "birth"), "entity_id", "left")
        days = days.withColumn("age", C.age_in_years(F.col("birth"), F.col("ts"))).drop("birth")
    joined = index.join(days, ["entity_id", "ts"], "left")
    dated = joined.withColumn("days_to_event", C.days_to_event(F.col("ts"), F.col("event_date")))
    return C.add_year_columns(dated, "ts", "event_date", rules.cohort_end)


def _steps(df: DataFrame, rules: CohortRules) -> list[tuple[str, Column]]:
    steps = [
        ("start_date", F.col("ts") >= F.lit(rules.start_date).cast("date")),
        ("past_event", F.col("days_to_event").isNull() | (F.col("days_to_event") >= 0)),
    ]
    if rules.min_age is not None or rules.max_age is not None:
        if "age" not in df.columns:
            raise ValueError("the age rule needs a column age: give birth dates to labelled_index_exams")
        in_range = F.col("age").isNotNull()
        if rules.min_age is not None:
            in_range &= F.col("age") >= rules.min_age
        if rules.max_age is not None:
            in_range &= F.col("age") <= rules.max_age
        steps.append(("age", F.coalesce(in_range, F.lit(False))))
    if rules.grace_days is not None:
        steps.append(("grace_period", C.grace_period_keep(F.col("event_1yr"), F.col("survival_1yr"), rules.grace_days)))
    return steps


def eligible_cohort(labelled: DataFrame, rules: CohortRules) -> DataFrame:
    """Apply every eligibility rule; rows eligible in at least one year remain."""
    kept = labelled
    for _, cond in _steps(labelled, rules):
        kept = kept.where(cond)
    return C.add_eligibility(unique_ids_only(kept, "exam_id")).where(C.any_eligible())


def cohort_attrition(labelled: DataFrame, rules: CohortRules) -> DataFrame:
    """Rows before, after each rule, with unique ids, and eligible, in one row."""
    passed = F.lit(True)
    names, marked = [], labelled
    for name, cond in _steps(labelled, rules):
        passed = passed & cond
        marked = marked.withColumn(f"after_{name}", passed)
        names.append(f"after_{name}")
    flagged = C.add_eligibility(marked).withColumn("_elig", C.any_eligible())
    per_id = flagged.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(n)).alias(n) for n in names],
        F.count_if(F.col(names[-1]) & F.col("_elig")).alias("_elig"),
    )
    unique = F.col(names[-1]) == 1
    return per_id.agg(
        F.sum("rows").alias("index_rows"),
        *[F.sum(n).alias(n) for n in names],
        F.count_if(unique).alias("after_unique_id"),
        F.count_if(unique & (F.col("_elig") == 1)).alias("eligible"),
    )


def yearly_counts(cohort: DataFrame) -> DataFrame:
    """Per year: rows, events, followed-up and eligible rows."""
    rows = [
        f"named_struct('year', {y}, 'event', event_{y}yr, 'followup', followup_{y}yr, 'eligible', eligible_{y}yr)" for y in C.YEARS
    ]
    per_year = F.expr(f"explode(array({', '.join(rows)}))")
    return (
        cohort.select(per_year.alias("y")).groupBy("y.year").agg(
            F.count(F.lit(1)).alias("n_exams"),
            F.sum("y.event").cast("bigint").alias("n_events"),
            F.sum("y.followup").cast("bigint").alias("n_followed"),
            F.sum("y.eligible").cast("bigint").alias("n_eligible"),
        )
    )

"""Event dates, interval labels, follow-up, survival and eligibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import count_in_intervals

YEARS = tuple(range(1, 11))
FOLLOWUP_START_DAYS = 14


def plus_months(date: Column, months: int) -> Column:
    """Calendar months later, clipped to the month end; keeps the time of day."""
    return date + F.expr(f"INTERVAL '{months}' MONTH")


def plus_days(date: Column, days: int) -> Column:
    return date + F.expr(f"INTERVAL '{days}' DAY")


def age_in_years(born: Column, at: Column) -> Column:
    """Whole average years (365.2425 days) between two dates."""
    return F.floor(F.datediff(at, born) / F.lit(365.2425)).cast("int")


def confirmation_days(confirmations: DataFrame, entity: str, ts: str, result: str) -> DataFrame:
    """Confirmations as (entity, ts, result, weight), collapsed by a map-side combine.

    Both results stay in one aggregate, so every later use shares the same shuffle.
    """
    days = confirmations.groupBy(entity, ts).agg(
        F.count_if(F.col(result) == 0).cast("int").alias("_n0"), F.count_if(F.col(result) == 1).cast("int").alias("_n1")
    )
    both = F.array(*[F.struct(F.lit(r).alias(result), F.col(f"_n{r}").alias("weight")) for r in (0, 1)])
    return days.select(entity, ts, F.inline(both)).where(F.col("weight") > 0)


def _weighted(confirmations: DataFrame) -> DataFrame:
    return confirmations if "weight" in confirmations.columns else confirmations.withColumn("weight", F.lit(1))


def valid_code5(
    exams: DataFrame, confirmations: DataFrame, entity: str, ts: str, code: str, result: str, *,
    version: int = 1, grace_days: int = 7, months: int = 6,
) -> DataFrame:
    """Severity-5 exams accepted as positive.

    0: all.  1: unless a benign exam (1-3) or benign confirmation lies in
    [date + grace days, date + months].  2: only if a severity-6 exam or a positive
    confirmation is dated on or after it.  ``confirmations`` uses the same ``ts`` name.
    """
    fives = exams.where(F.col(code) == 5)
    if version == 0:
        return fives
    if version == 1:
        benign = (
            exams.where(F.col(code).isin(1, 2, 3)).select(entity, ts, F.lit(1).alias("weight"))
            .unionByName(_weighted(confirmations).where(F.col(result) == 0).select(entity, ts, "weight"))
        )
        counts = count_in_intervals(
            fives, entity, ts,
            {"n_benign": (lambda d: plus_days(d, grace_days), lambda d: plus_months(d, months), "one")},
            benign, ts, {"one": F.col("weight")}, lower_closed=True,
        )
        return fives.join(counts.where(F.col("n_benign") == 0).select(entity, ts), [entity, ts], "left_semi")
    proof = (
        exams.where(F.col(code) == 6).select(entity, ts)
        .unionByName(confirmations.where(F.col(result) == 1).select(entity, ts))
        .groupBy(entity).agg(F.max(ts).alias("_last"))
    )
    days = fives.select(entity, ts).distinct().join(proof, entity).where(F.col(ts) <= F.col("_last"))
    return fives.join(days.select(entity, ts), [entity, ts], "left_semi")


def earliest_event_date(
    exams: DataFrame, confirmations: DataFrame, entity: str, ts: str, code: str, result: str, **validation
) -> DataFrame:
    """Per entity the earliest accepted code 5, code 6, positive confirmation, and their minimum."""
    sources = {
        "first_code5": valid_code5(exams, confirmations, entity, ts, code, result, **validation),
        "first_code6": exams.where(F.col(code) == 6),
        "first_confirmation": confirmations.where(F.col(result) == 1),
    }
    marked = [df.select(entity, ts, F.lit(name).alias("_kind")) for name, df in sources.items()]
    out = reduce(DataFrame.unionByName, marked).groupBy(entity).agg(
        *[F.min(F.when(F.col("_kind") == name, F.col(ts))).alias(name) for name in sources]
    )
    return out.withColumn("event_date", F.least(*sources))


def interval_event_label(index: str, event: str, low_months: int, high_months: int, cohort_end: str) -> Column:
    """1 if the event lies in [index + low, min(index + high, end)] and the lower bound is before the end.

    Both ends count; bounds are taken at midnight.  ``index`` and ``event`` are column names.
    """
    low = f"add_months(CAST({index} AS DATE), {low_months})"
    high = f"add_months(CAST({index} AS DATE), {high_months})"
    end = f"DATE'{cohort_end}'"
    hit = f"{low} < {end} AND {event} >= {low} AND {event} <= least({high}, {end})"
    return F.expr(f"CAST(coalesce({hit}, false) AS INT)")


def survival_days(index: str, event: str, high_months: int, cohort_end: str) -> Column:
    """Days to the event, or to the capped upper bound if there is none (column names)."""
    cap = f"least(add_months(CAST({index} AS DATE), {high_months}), DATE'{cohort_end}')"
    end = f"coalesce(CAST({event} AS TIMESTAMP_NTZ), CAST({cap} AS TIMESTAMP_NTZ))"
    return F.expr(f"timestampdiff(MICROSECOND, CAST({index} AS TIMESTAMP_NTZ), {end}) / 86400000000D")


def survival_months(index: Column, event: Column, limit: int, cohort_end: Column) -> Column:
    """struct(months, event): whole calendar months, capped at the limit."""
    month = lambda d: F.year(d) * 12 + F.month(d)
    last = month(F.least(F.add_months(index.cast("date"), limit), cohort_end))
    happened = F.coalesce(month(event) <= last, F.lit(False))
    months = F.when(happened, month(event)).otherwise(last) - month(index)
    return F.struct(F.least(months, F.lit(limit)).alias("months"), happened.cast("int").alias("event"))


def days_to_event(index: Column, event: Column) -> Column:
    """Whole days from index to event, rounded down, so an hour before is -1."""
    micros = F.timestamp_diff("MICROSECOND", index.cast("timestamp_ntz"), event.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def followup_dates(index: Column, years=YEARS, start_days: int = FOLLOWUP_START_DAYS) -> dict[str, Column]:
    return {
        f"followup_{start_days}d": plus_days(index, start_days),
        **{f"followup_{y}yr": plus_months(index, 12 * y) for y in years},
    }


def followup_counts(
    index: DataFrame, exams: DataFrame, confirmations: DataFrame, entity: str, ts: str, code: str, result: str, *,
    years=YEARS, start_days: int = FOLLOWUP_START_DAYS, first_codes=range(0, 5), later_codes=range(0, 10),
) -> DataFrame:
    """Per (entity, index date): benign confirmations plus exams in each (lower, upper] year."""
    events = (
        exams.select(
            entity, ts,
            F.col(code).isin(*first_codes).cast("int").alias("first_year"),
            F.col(code).isin(*later_codes).cast("int").alias("later_year"),
        ).unionByName(
            _weighted(confirmations).where(F.col(result) == 0).select(
                entity, ts, F.col("weight").alias("first_year"), F.col("weight").alias("later_year")
            )
        )
    )
    intervals = {}
    for y in years:
        low = (lambda d: plus_days(d, start_days)) if y == 1 else (lambda d, m=12 * (y - 1): plus_months(d, m))
        intervals[f"n_followup_{y}yr"] = (
            low, lambda d, m=12 * y: plus_months(d, m), "first_year" if y == 1 else "later_year"
        )
    return count_in_intervals(
        index, entity, ts, intervals, events, ts,
        {"first_year": F.col("first_year"), "later_year": F.col("later_year")},
    )


def any_of(flags: list[str]) -> str:
    """SQL for the maximum of 0/1 columns, 0 for none."""
    return f"greatest(0, {', '.join(flags)})" if flags else "0"


def event_free_before(events: list[str], year: int) -> Column:
    """1 if no earlier interval has an event."""
    return F.expr(f"1 - {any_of(events[: year - 1])}")


def seen_at_or_after(flags: list[str], year: int) -> Column:
    """1 if the interval or any later one has the flag."""
    return F.expr(any_of(flags[year - 1 :]))


def eligibility_columns(events: list[str], followups: list[str]) -> list[Column]:
    """Per year: event-free before it, and an event or follow-up in it or later."""
    return [
        F.expr(f"(1 - {any_of(events[: y - 1])}) * {any_of(events[y - 1 :] + followups[y - 1 :])}")
        for y in range(1, len(events) + 1)
    ]


def eligibility_singleyear(df: DataFrame, events: list[str], followups: list[str], year: int) -> DataFrame:
    """Within-k-years form: adds ``eligibility`` and ``event_indicator``."""
    return df.withColumns({
        "eligibility": F.expr(any_of(events[:year] + followups[year - 1 :])),
        "event_indicator": F.expr(any_of(events[:year])),
    })


def add_year_columns(df: DataFrame, index_ts: str, event: str, cohort_end: str, years=YEARS) -> DataFrame:
    """Event indicator, follow-up flag and survival days for every year."""
    cols: dict[str, Column] = {}
    for y in years:
        cols[f"event_{y}yr"] = interval_event_label(index_ts, event, 12 * (y - 1), 12 * y, cohort_end)
        cols[f"followup_{y}yr"] = F.expr(f"CAST(coalesce(n_followup_{y}yr, 0) > 0 AS INT)")
        cols[f"survival_{y}yr"] = survival_days(index_ts, event, 12 * y, cohort_end)
    return df.withColumns(cols).drop(*[f"n_followup_{y}yr" for y in years])


def grace_period_keep(event_first_year: Column, survival_first_year: Column, grace_days: int) -> Column:
    """False for an event in year 1 within the grace days."""
    return ~F.coalesce((event_first_year == 1) & (survival_first_year <= grace_days), F.lit(False))


def add_eligibility(df: DataFrame, years=YEARS) -> DataFrame:
    elig = eligibility_columns([f"event_{y}yr" for y in years], [f"followup_{y}yr" for y in years])
    return df.withColumns({f"eligible_{y}yr": c for y, c in zip(years, elig)})


def any_eligible(years=YEARS) -> Column:
    return F.expr(" OR ".join(f"eligible_{y}yr = 1" for y in years))

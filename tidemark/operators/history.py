"""Entity histories: ordered pages, truncation, point-in-time views.

The long form (entity, date, key, code) is the primary layout.  The prior list of an
exam is a prefix of its entity's ordered history, so a point-in-time view stores the
prefix length and aggregates of the prefix instead of repeating the list per exam.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import as_of, history_position, running_by_instant

PAGE_ROWS = 1024


def history_pages(
    rows: DataFrame, entity: str, ts: str, key: str, values: Sequence[str], *, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Ordered history as arrays of at most ``page_rows`` structs (entity, page, events).

    An entity with a usual history has one page; a very long one has many, so no array
    and no task grows with the longest history. Rows that share (ts, key) are ordered by the values.
    """
    placed = history_position(rows.select(entity, ts, key, *values), entity, ts, key, ties=values)
    page = F.floor((F.col("position") - 1) / page_rows).cast("int")
    event = F.struct("position", ts, key, *values)
    return (
        placed.withColumn("page", page)
        .groupBy(entity, "page")
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
    )


def truncate_at_first_high(
    rows: DataFrame, entity: str, ts: str, key: str, code: str, *, threshold: int = 4
) -> DataFrame:
    """Keep what precedes the first code >= threshold in the order (ts, key)."""
    return _before_cut(rows, entity, ts, key, code, threshold, {})


def _before_cut(rows: DataFrame, entity: str, ts: str, key: str, code: str, threshold: int, totals: dict) -> DataFrame:
    # The cut known up to an instant is enough to decide on the rows of that instant, so the
    # rows are joined on (entity, ts) and never gathered per entity.
    mark = F.struct(F.col(ts), F.col(key))
    cut = running_by_instant(rows, entity, ts, {"_cut": ("min", F.when(F.col(code) >= threshold, mark))}, totals)
    return rows.join(cut, [entity, ts]).where(F.col("_cut").isNull() | (mark < F.col("_cut"))).drop("_cut")


def prior_history(
    index: DataFrame, rows: DataFrame, entity: str, index_ts: str, ts: str, measures: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Attach ``n_prior`` and aggregates over the entity's rows dated <= the index date.

    Same-instant peers and the index row itself are included.
    """
    out = as_of(index, rows, entity, index_ts, ts, {"n_prior": ("sum", F.lit(1)), **measures})
    return out.withColumn("n_prior", F.coalesce("n_prior", F.lit(0)).cast("bigint"))


def explode_index_exams(
    exams: DataFrame, entity: str, ts: str, key: str, code: str, *, threshold: int = 4
) -> DataFrame:
    """One row per exam of the truncated history, with the length of its prior prefix.

    ``n_prior`` counts truncated exams up to the index date, ``n_complete`` all exams of
    the entity; the lists themselves are the first ``n_prior`` entries of the pages of
    the truncated history and all entries of the complete one.
    """
    totals = {"n_complete": ("sum", F.lit(1)), "first_exam_date": ("min", F.col(ts))}
    kept = _before_cut(exams, entity, ts, key, code, threshold, totals)
    return prior_history(
        kept, kept, entity, ts, ts, {"first_prior_date": ("min", F.col(ts)), "max_prior_code": ("max", F.col(code))}
    )


def point_in_time_features(
    index: DataFrame, answers: DataFrame, entity: str, index_ts: str, ts: str, features: Sequence[str]
) -> DataFrame:
    """Largest non-null answer dated <= the index date.

    ``n_answers`` is null for an entity without any questionnaire, 0 if all are later.
    """
    seen = answers.select(entity).distinct().withColumn("_any", F.lit(True))
    days = as_of(
        index.select(entity, index_ts).distinct(), answers, entity, index_ts, ts,
        {"n_answers": ("sum", F.lit(1)), **{f: ("max", F.col(f)) for f in features}},
    ).join(seen, entity, "left")
    counted = F.when(F.col("_any"), F.coalesce("n_answers", F.lit(0)).cast("bigint"))
    return index.join(days.withColumn("n_answers", counted).drop("_any"), [entity, index_ts])


def history_flag_any(
    index: DataFrame, exams: DataFrame, flagged: DataFrame, entity: str, index_ts: str, ts: str, key: str,
    name: str = "flag",
) -> DataFrame:
    """True if any exam up to the index date is in the flagged key set."""
    marked = exams.join(flagged.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    hits = marked.withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    out = as_of(index, hits, entity, index_ts, ts, {name: ("max", F.col("_hit"))})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) == 1)


def indices_where(codes: Column, wanted: Sequence[int]) -> Column:
    """0-based positions of an array whose code is in the list."""
    at = F.transform(codes, lambda c, i: F.when(c.isin(*wanted), i))
    return F.array_compact(at)


def latest_padded(items: Column, n: int, pad: Column) -> Column:
    """struct(items, mask): the last n items, padded on the left, and a 0/1 mask."""
    kept = F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))
    missing = F.lit(n) - F.size(kept)
    return F.struct(
        F.concat(F.array_repeat(pad, missing), kept).alias("items"),
        F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(kept))).alias("mask"),
    )

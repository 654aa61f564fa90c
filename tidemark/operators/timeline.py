"""Running aggregates along each entity's time line.

A history operator that sorts all rows of one entity in one task stops scaling
when a single entity owns a large share of the table.  Everything here first
collapses rows to one row per (entity, instant) with a map-side combine, and
only then runs a window: over at most one row per calendar day of an entity,
and over the instants inside one day.  The row tables themselves are only
joined on (entity, instant), which spreads a hot entity over its days.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Measure = tuple[str, Column]

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _is_date(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DateType)


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        both = F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
        return F.when(left.isNotNull() | right.isNotNull(), both)
    return F.least(left, right) if kind == "min" else F.greatest(left, right)


def running_by_instant(
    rows: DataFrame, entity: str | Sequence[str], ts: str, measures: dict[str, Measure],
    totals: dict[str, Measure] | None = None,
) -> DataFrame:
    """One row per (entity, instant): each measure over all rows up to and at it.

    ``totals`` are measures over all rows of the entity.
    """
    keys, totals = as_list(entity), totals or {}
    both = {**measures, **totals}
    kinds = {name: kind for name, (kind, _) in measures.items()}
    whole = Window.partitionBy(*keys)
    total_cols = [_AGG[kind](name).over(whole).alias(name) for name, (kind, _) in totals.items()]
    moments = rows.groupBy(*keys, ts).agg(*[_AGG[kind](col).alias(name) for name, (kind, col) in both.items()])
    if _is_date(rows, ts):
        upto = Window.partitionBy(*keys).orderBy(ts).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return moments.select(
            *keys, ts, *[_AGG[k](n).over(upto).alias(n) for n, k in kinds.items()], *total_cols
        )

    moments = moments.withColumn("_day", F.to_date(ts))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        moments.groupBy(*keys, "_day")
        .agg(*[_AGG[k](n).alias(n) for n, (k, _) in both.items()])
        .select(*keys, "_day", *[_AGG[k](n).over(before).alias(f"_carry_{n}") for n, k in kinds.items()], *total_cols)
    )
    inside = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = moments.select(
        *keys, ts, "_day", *[_AGG[k](n).over(inside).alias(n) for n, k in kinds.items()]
    )
    return local.join(carried, [*keys, "_day"]).select(
        *keys, ts, *[_merge(k, F.col(n), F.col(f"_carry_{n}")).alias(n) for n, k in kinds.items()], *totals
    )


def as_of(
    points: DataFrame,
    events: DataFrame,
    entity: str | Sequence[str],
    point_ts: str,
    event_ts: str,
    measures: dict[str, Measure],
) -> DataFrame:
    """Attach to each point the measures over the entity's events dated <= the point."""
    keys = as_list(entity)
    if points is events and point_ts == event_ts:
        return points.join(running_by_instant(events, keys, event_ts, measures), [*keys, point_ts], "left")
    joint = "date" if _is_date(points, point_ts) and _is_date(events, event_ts) else "timestamp_ntz"
    ev = events.select(
        *keys, F.col(event_ts).cast(joint).alias("_at"), *[col.alias(n) for n, (_, col) in measures.items()]
    )
    empty = [F.lit(None).cast(ev.schema[n].dataType).alias(n) for n in measures]
    pt = points.select(*keys, F.col(point_ts).cast(joint).alias("_at"), *empty)
    run = running_by_instant(
        ev.unionByName(pt), keys, "_at", {n: (k, F.col(n)) for n, (k, _) in measures.items()}
    )
    return (
        points.withColumn("_at", F.col(point_ts).cast(joint)).join(run, [*keys, "_at"], "left").drop("_at")
    )


Bound = Callable[[Column], Column]


def count_in_intervals(
    index: DataFrame,
    entity: str,
    index_ts: str,
    intervals: dict[str, tuple[Bound, Bound, str]],
    events: DataFrame,
    event_ts: str,
    measures: dict[str, Column],
    *,
    lower_closed: bool = False,
) -> DataFrame:
    """Per distinct (entity, index instant): sums of event weights inside each interval.

    ``intervals`` maps an output name to (lower bound, upper bound, measure name);
    bounds are functions of the index instant, the interval is ``(lower, upper]`` or,
    with ``lower_closed``, ``[lower, upper]``.  A count is the difference of two running
    sums, so no (index, event) pair is ever produced.
    """
    joint = "date" if _is_date(index, index_ts) and _is_date(events, event_ts) else "timestamp_ntz"
    step = F.expr("INTERVAL '1' DAY") if joint == "date" else F.expr("INTERVAL '0.000001' SECOND")
    at = F.col(index_ts).cast(joint)

    def lower_edge(bound: Bound) -> Column:
        edge = bound(at).cast(joint)
        return (edge - step).cast(joint) if lower_closed else edge

    # an edge that ends one interval and begins the next is one point with both signs
    edges: dict[str, tuple[Column, dict[str, int]]] = {}
    for name, (low, high, _) in intervals.items():
        for sign, edge in ((-1, lower_edge(low)), (1, high(at).cast(joint))):
            edges.setdefault(str(edge), (edge, {}))[1][name] = sign
    which = {key: i for i, key in enumerate(edges)}
    points = (
        index.select(entity, index_ts)
        .distinct()
        .withColumn("_e", F.explode(F.array(*[F.struct(F.lit(which[k]).alias("at"), e.alias("edge")) for k, (e, _) in edges.items()])))
        .select(entity, index_ts, "_e.at", "_e.edge")
    )
    valued = as_of(
        points, events, entity, "edge", event_ts, {m: ("sum", c) for m, c in measures.items()}
    )
    def signed(name: str, measure: str) -> Column:
        upto = F.coalesce(F.col(measure), F.lit(0))
        begin, end = (which[k] for k in sorted((k for k, (_, names) in edges.items() if name in names), key=lambda k: edges[k][1][name]))
        return F.sum(F.when(F.col("at") == end, upto).when(F.col("at") == begin, -upto).otherwise(0))

    return valued.groupBy(entity, index_ts).agg(
        *[signed(name, measure).cast("bigint").alias(name) for name, (_, _, measure) in intervals.items()]
    )


def history_position(
    rows: DataFrame, entity: str, ts: str, key: str, name: str = "position", total: str | None = None,
    *, ties: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row in its entity's order (ts, key), optionally with the entity's row count.

    Rows that share (ts, key) are ordered by ``ties``, nulls last; without them their order is open.
    """
    totals = {total: ("sum", F.lit(1))} if total else {}
    run = running_by_instant(rows, entity, ts, {"_upto": ("sum", F.lit(1))}, totals)
    same = Window.partitionBy(entity, ts).orderBy(F.desc(key), *[F.desc_nulls_first(c) for c in ties])
    return (
        rows.join(run, [entity, ts])
        .withColumn(name, (F.col("_upto") - F.row_number().over(same) + 1).cast("bigint"))
        .drop("_upto")
    )

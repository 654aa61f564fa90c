"""Running aggregates, intervals and positions against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators.timeline import as_of, count_in_intervals, history_position, running_by_instant


def _rows(kind, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        entity = 0 if rng.random() < 0.4 else rng.randrange(1, 12)  # one hot entity
        ts = dt.datetime(2000, 1, 1) + dt.timedelta(days=rng.randrange(40), hours=rng.randrange(24) if kind == "time" else 0)
        rows.append((entity, i, ts if kind == "time" else ts.date(), rng.randrange(7)))
    return rows


def _frame(spark, rows, kind):
    ts = "timestamp_ntz" if kind == "time" else "date"
    return spark.createDataFrame(rows, f"e int, k int, ts {ts}, code int")


@pytest.mark.parametrize("kind", ["date", "time"])
def test_running_totals_match_brute_force(spark, kind):
    rows = _rows(kind)
    df = _frame(spark, rows, kind)
    run = running_by_instant(df, "e", "ts", {"n": ("sum", F.lit(1)), "hi": ("max", F.col("code")), "lo": ("min", F.col("k"))})
    got = {(r.e, r.ts): (r.n, r.hi, r.lo) for r in run.collect()}
    for e, _, ts, _ in rows:
        past = [r for r in rows if r[0] == e and r[2] <= ts]
        assert got[(e, ts)] == (len(past), max(r[3] for r in past), min(r[1] for r in past))


def test_as_of_mixes_dates_and_times(spark):
    events, points = _rows("time", seed=2), _rows("date", seed=3)
    out = as_of(
        _frame(spark, points, "date"), _frame(spark, events, "time").select("e", F.col("ts").alias("at"), "code"),
        "e", "ts", "at", {"total": ("sum", F.col("code"))},
    )
    for r in out.collect():
        limit = dt.datetime.combine(r.ts, dt.time())
        past = [v[3] for v in events if v[0] == r.e and v[2] <= limit]
        assert r.total == (sum(past) if past else None)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("kind", ["date", "time"])
def test_interval_counts(spark, kind, closed):
    rows = _rows(kind, 120)
    df = _frame(spark, rows, kind)
    day = F.expr("INTERVAL '1' DAY")
    out = count_in_intervals(
        df, "e", "ts", {"n": (lambda t: t + day * 3, lambda t: t + day * 10, "w")}, df, "ts", {"w": F.lit(1)}, lower_closed=closed
    )
    got = {(r.e, r.ts): r.n for r in out.collect()}
    for e, _, ts, _ in rows:
        low, high = ts + dt.timedelta(days=3), ts + dt.timedelta(days=10)
        want = sum(1 for r in rows if r[0] == e and (r[2] >= low if closed else r[2] > low) and r[2] <= high)
        assert got[(e, ts)] == want


def test_positions_and_pages_do_not_depend_on_partitioning(spark):
    rows = _rows("date")
    order = defaultdict(list)
    for e, k, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        order[e].append(k)
    for parts in (1, 7):
        df = _frame(spark, rows, "date").repartition(parts)
        for r in history_position(df, "e", "ts", "k").collect():
            assert order[r.e][r.position - 1] == r.k
        pages = H.history_pages(df, "e", "ts", "k", ["code"], page_rows=8).collect()
        assert max(len(p.events) for p in pages) <= 8
        for e, keys in order.items():
            flat = [ev.k for p in sorted((p for p in pages if p.e == e), key=lambda p: p.page) for ev in p.events]
            assert flat == keys


def test_rows_of_one_key_are_ordered_by_their_values(spark):
    day = dt.date(2000, 1, 1)
    for results in ([1, 0, None], [None, 1, 0], [0, None, 1]):
        df = spark.createDataFrame([(e, "1-2", day, r) for e in range(8) for r in results], "e int, k string, ts date, result int")
        pages = H.history_pages(df.coalesce(1), "e", "ts", "k", ["result"]).collect()
        assert [[ev.result for ev in p.events] for p in pages] == [[0, 1, None]] * 8


def test_truncation_and_same_day_peers(spark):
    d = dt.date
    rows = [
        (1, 10, d(2000, 1, 1), 2), (1, 11, d(2000, 1, 1), 1), (1, 12, d(2000, 2, 1), 5), (1, 13, d(2000, 3, 1), 1),
        (2, 20, d(2000, 1, 1), 4), (2, 21, d(2000, 2, 1), 1), (3, 30, d(2000, 1, 1), 0),
    ]
    df = spark.createDataFrame(rows, "e int, k int, ts date, code int")
    kept = {r.k for r in H.truncate_at_first_high(df, "e", "ts", "k", "code").collect()}
    assert kept == {10, 11, 30}
    index = {r.k: r for r in H.explode_index_exams(df, "e", "ts", "k", "code").collect()}
    assert set(index) == kept
    assert index[10].n_prior == index[11].n_prior == 2  # each sees the other
    assert index[10].n_complete == 4 and index[30].n_prior == 1


def test_point_in_time_features_distinguish_none_and_later(spark):
    d = dt.date
    exams = spark.createDataFrame([(1, d(2000, 1, 5)), (2, d(2000, 1, 5)), (3, d(2000, 1, 5))], "e int, ts date")
    answers = spark.createDataFrame([(1, d(2000, 1, 5), 3), (1, d(2000, 1, 6), 9), (2, d(2000, 2, 1), 4)], "e int, ts date, x int")
    got = {r.e: (r.n_answers, r.x) for r in H.point_in_time_features(exams, answers, "e", "ts", "ts", ["x"]).collect()}
    assert got == {1: (1, 3), 2: (0, None), 3: (None, None)}


def test_latest_padded(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [7]), (3, [])], "i int, a array<int>")
    out = H.latest_padded(F.col("a"), 3, F.lit(0))
    got = {r.i: (r.o["items"], r.o["mask"]) for r in df.select("i", out.alias("o")).collect()}
    assert got == {1: ([2, 3, 4], [1, 1, 1]), 2: ([0, 0, 7], [0, 0, 1]), 3: ([0, 0, 0], [0, 0, 0])}

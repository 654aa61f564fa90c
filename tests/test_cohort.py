"""Hand-made edge rows for event dates, labels, follow-up and eligibility."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort as C
from tidemark.plans import eligible_cohort as plan

D = dt.date
END = "2010-12-01"


def _exams(spark, rows):
    return spark.createDataFrame(rows, "entity_id int, exam_id int, ts date, code int")


def _conf(spark, rows):
    return spark.createDataFrame(rows, "entity_id int, ts date, result int")


@pytest.mark.parametrize("benign, valid", [
    (D(2000, 1, 17), False),  # exactly 7 days later
    (D(2000, 7, 10), False),  # exactly 6 months later
    (D(2000, 1, 16), True), (D(2000, 7, 11), True),
])
def test_code5_needs_no_benign_exam_in_the_interval(spark, benign, valid):
    exams = _exams(spark, [(1, 1, D(2000, 1, 10), 5), (1, 2, benign, 2)])
    out = C.valid_code5(exams, _conf(spark, []), "entity_id", "ts", "code", "result", version=1)
    assert (out.count() == 1) is valid
    conf = _conf(spark, [(1, benign, 0)])
    assert (C.valid_code5(exams.limit(1), conf, "entity_id", "ts", "code", "result", version=1).count() == 1) is valid


def test_code5_confirmed_on_the_same_day(spark):
    exams = _exams(spark, [(1, 1, D(2000, 1, 10), 5), (2, 2, D(2000, 1, 10), 5)])
    conf = _conf(spark, [(1, D(2000, 1, 10), 1), (2, D(2000, 1, 9), 1)])
    out = C.valid_code5(exams, conf, "entity_id", "ts", "code", "result", version=2)
    assert [r.exam_id for r in out.collect()] == [1]


def test_interval_labels_on_boundaries(spark):
    df = spark.createDataFrame([
        ("boundary", D(2001, 5, 1), D(2002, 5, 1)), ("none", D(2001, 5, 1), None),
        ("late", D(2010, 12, 1), D(2010, 12, 2)), ("leap", D(2004, 2, 29), D(2005, 2, 28)),
    ], "name string, ts date, event date")
    cols = [C.interval_event_label("ts", "event", 12 * (y - 1), 12 * y, END).alias(f"y{y}") for y in (1, 2)]
    got = {r.name: (r.y1, r.y2) for r in df.select("name", *cols).collect()}
    assert got == {"boundary": (1, 1), "none": (0, 0), "late": (0, 0), "leap": (1, 1)}


def test_followup_bounds_and_month_end(spark):
    index = _exams(spark, [(1, 1, D(2001, 1, 31), 1)])
    at = lambda day: _exams(spark, [(1, 2, day, 0)])
    count = lambda day: C.followup_counts(index, at(day), _conf(spark, []), "entity_id", "ts", "code", "result").first()
    assert count(D(2001, 2, 14)).n_followup_1yr == 0  # exactly at the lower bound
    assert count(D(2001, 2, 15)).n_followup_1yr == 1
    assert count(D(2002, 1, 31)).n_followup_1yr == 1 and count(D(2002, 1, 31)).n_followup_2yr == 0
    assert count(D(2002, 2, 1)).n_followup_2yr == 1
    dates = index.select(*[c.alias(n) for n, c in C.followup_dates(F.to_date(F.lit("2000-02-29"))).items()]).first()
    assert dates.followup_1yr == D(2001, 2, 28) and dates.followup_4yr == D(2004, 2, 29)


def test_first_year_counts_only_low_codes(spark):
    index = _exams(spark, [(1, 1, D(2001, 1, 1), 1)])
    high = _exams(spark, [(1, 2, D(2001, 6, 1), 5), (1, 3, D(2002, 6, 1), 5)])
    row = C.followup_counts(index, high, _conf(spark, []), "entity_id", "ts", "code", "result").first()
    assert (row.n_followup_1yr, row.n_followup_2yr) == (0, 1)


def test_survival_and_days(spark):
    df = spark.createDataFrame([
        (dt.datetime(2001, 1, 1, 12), dt.datetime(2001, 1, 1, 11)), (dt.datetime(2001, 1, 1), dt.datetime(2001, 3, 1)),
        (dt.datetime(2001, 1, 1), None),
    ], "ts timestamp_ntz, event timestamp_ntz")
    end = F.lit(END).cast("date")
    m = C.survival_months(F.col("ts"), F.col("event"), 60, end)
    got = df.select(
        C.days_to_event(F.col("ts"), F.col("event")).alias("d"), C.survival_days("ts", "event", 12, END).alias("s"),
        m["months"].alias("m"), m["event"].alias("e"),
    ).collect()
    assert [r.d for r in got] == [-1, 59, None]
    assert [r.s for r in got][1:] == [59.0, 365.0]
    assert [(r.m, r.e) for r in got][1:] == [(2, 1), (60, 0)]


def test_eligibility_columns(spark):
    df = spark.createDataFrame([(0, 0, 1, 0, 1, 0), (0, 0, 0, 1, 0, 0), (1, 0, 0, 0, 0, 1)], "e1 int, e2 int, e3 int, f1 int, f2 int, f3 int")
    cols = C.eligibility_columns(["e1", "e2", "e3"], ["f1", "f2", "f3"])
    assert [tuple(r) for r in df.select(*[c.alias(f"a{i}") for i, c in enumerate(cols)]).collect()] == [(1, 1, 1), (1, 0, 0), (1, 0, 0)]


def test_cohort_rules(spark):
    exams = _exams(spark, [
        (1, 1, D(2001, 1, 1), 1), (1, 2, D(2003, 1, 1), 1),        # followed, no event
        (2, 3, D(2001, 1, 1), 1),                                  # event before the index
        (3, 4, D(2001, 1, 1), 1),                                  # event on the index day
        (4, 5, D(2001, 1, 1), 1), (5, 5, D(2001, 1, 1), 1), (4, 6, D(2002, 1, 1), 1),  # id 5 twice
    ])
    conf = _conf(spark, [(2, D(2000, 6, 1), 1), (3, D(2001, 1, 1), 1)])
    rules = plan.CohortRules(cohort_end=END, grace_days=30)
    lab = plan.labelled_index_exams(exams, conf, rules)
    kept = {r.exam_id for r in plan.eligible_cohort(lab, rules).collect()}
    assert kept == {1}  # 2 and 6 have no later exam
    counts = plan.cohort_attrition(lab, rules).first()
    assert (counts.index_rows, counts.after_past_event, counts.after_grace_period, counts.after_unique_id, counts.eligible) == (7, 6, 5, 3, 1)
    row = plan.eligible_cohort(lab, rules).first()
    assert (row.eligible_1yr, row.eligible_2yr, row.eligible_3yr) == (1, 1, 0)

"""Histories, point-in-time views, event dates, follow-up and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import history as H
from ..operators.relational import unique_ids_only
from ..operators.timeline import count_in_intervals
from ..plans import eligible_cohort as plan
from .grounding import (
    ANSWERS, COHORT_END, CONF, EXAMS, PERSONS, REPORTS, answers, confirmations, day, exams, persons, reports, with_sql,
)
from .registry import query

RULES = plan.CohortRules(cohort_end=COHORT_END)

# ------------------------------------------------------------------ shared SQL
KEPT = """
cut AS (SELECT entity_id, min((ts, exam_id)) AS cut FROM exams WHERE code >= 4 GROUP BY 1),
kept AS (SELECT e.* FROM exams e LEFT JOIN cut USING (entity_id) WHERE cut IS NULL OR (ts, exam_id) < cut)"""

INDEX = """
idx AS (SELECT k.*, count(*) OVER w AS n_prior, min(ts) OVER w AS first_prior_date, max(code) OVER w AS max_prior_code,
  n_complete, first_exam_date
  FROM kept k JOIN (SELECT entity_id, count(*) AS n_complete, min(ts) AS first_exam_date FROM exams GROUP BY 1) USING (entity_id)
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _code5(version: int) -> str:
    if version == 0:
        return "valid5 AS (SELECT * FROM exams WHERE code = 5)"
    if version == 1:
        return """benign AS (SELECT entity_id, ts FROM exams WHERE code IN (1, 2, 3) UNION ALL SELECT entity_id, ts FROM conf WHERE result = 0),
valid5 AS (SELECT * FROM exams e WHERE code = 5 AND NOT EXISTS (SELECT 1 FROM benign b WHERE b.entity_id = e.entity_id
  AND b.ts >= e.ts + 7 AND b.ts <= e.ts + INTERVAL 6 MONTH))"""
    return """proof AS (SELECT entity_id, ts FROM exams WHERE code = 6 UNION ALL SELECT entity_id, ts FROM conf WHERE result = 1),
valid5 AS (SELECT * FROM exams e WHERE code = 5 AND EXISTS (SELECT 1 FROM proof p WHERE p.entity_id = e.entity_id AND e.ts <= p.ts))"""


EVENTS = _code5(1) + """,
ev AS (SELECT entity_id, min(f5) AS first_code5, min(f6) AS first_code6, min(fc) AS first_confirmation,
  least(min(f5), min(f6), min(fc)) AS event_date FROM (
    SELECT entity_id, ts AS f5, NULL::DATE AS f6, NULL::DATE AS fc FROM valid5
    UNION ALL SELECT entity_id, NULL, ts, NULL FROM exams WHERE code = 6
    UNION ALL SELECT entity_id, NULL, NULL, ts FROM conf WHERE result = 1) GROUP BY 1)"""

SEEN = """
seen AS (SELECT exam_id, y, count(*) FILTER (hit) AS n FROM (
  SELECT i.exam_id, y, ts2 > lo AND ts2 <= hi AND (kind = 0 OR (y = 1 AND c BETWEEN 0 AND 4) OR (y > 1 AND c BETWEEN 0 AND 9)) AS hit
  FROM (SELECT exam_id, entity_id, y, CASE WHEN y = 1 THEN CAST(ts + INTERVAL 14 DAY AS DATE) ELSE CAST(ts + to_months(12 * (y - 1)) AS DATE) END AS lo,
      CAST(ts + to_months(12 * y) AS DATE) AS hi FROM idx, (SELECT unnest(range(1, 11))::INTEGER AS y)) i
  LEFT JOIN (SELECT entity_id, ts AS ts2, 1 AS kind, code AS c FROM exams
      UNION ALL SELECT entity_id, ts, 0, 0 FROM conf WHERE result = 0) x ON x.entity_id = i.entity_id) GROUP BY 1, 2)"""

LABELS = """
lab AS (SELECT i.*, s.y, ev.event_date, ev.first_code5, ev.first_code6, ev.first_confirmation,
  CASE WHEN s.n > 0 THEN 1 ELSE 0 END AS followup,
  CASE WHEN CAST(i.ts + to_months(12 * (s.y - 1)) AS DATE) < DATE '2001-12-01'
    AND ev.event_date >= CAST(i.ts + to_months(12 * (s.y - 1)) AS DATE)
    AND ev.event_date <= least(CAST(i.ts + to_months(12 * s.y) AS DATE), DATE '2001-12-01') THEN 1 ELSE 0 END AS event,
  CAST(coalesce(ev.event_date, least(CAST(i.ts + to_months(12 * s.y) AS DATE), DATE '2001-12-01')) - i.ts AS DOUBLE) AS survival
  FROM idx i JOIN seen s USING (exam_id) LEFT JOIN ev USING (entity_id))"""

ELIG = """
elig AS (SELECT *, CASE WHEN coalesce(sum(event) OVER (PARTITION BY exam_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
    AND (max(event) OVER f = 1 OR max(followup) OVER f = 1) THEN 1 ELSE 0 END AS eligible
  FROM lab WHERE event_date IS NULL OR event_date >= ts
  WINDOW f AS (PARTITION BY exam_id ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cohort AS (SELECT * FROM elig WHERE exam_id IN (SELECT exam_id FROM elig WHERE eligible = 1))"""

BASE = with_sql(EXAMS, CONF, KEPT, INDEX, EVENTS, SEEN, LABELS)
FULL = BASE[:-1] + "," + ELIG


def _index(spark, d):
    return H.explode_index_exams(exams(spark, d), "entity_id", "ts", "exam_id", "code")


def _labelled(spark, d):
    return plan.labelled_index_exams(exams(spark, d), confirmations(spark, d), RULES)


def _cohort(spark, d):
    return plan.eligible_cohort(_labelled(spark, d), RULES)


def per_year(df, *names):
    """Ten yearly columns per name to one row per year."""
    rows = [f"named_struct('year', {y}, " + ", ".join(f"'{n}', {n}_{y}yr" for n in names) + ")" for y in C.YEARS]
    return F.expr(f"explode(array({', '.join(rows)}))")


# ------------------------------------------------------------------ flagship
@query("eligibility_cohort", FULL + """SELECT y AS year, count(*) AS n_exams, CAST(sum(event) AS BIGINT) AS n_events,
  CAST(sum(followup) AS BIGINT) AS n_followed, CAST(sum(eligible) AS BIGINT) AS n_eligible FROM cohort GROUP BY 1""")
def eligibility_cohort(spark, d):
    return plan.yearly_counts(_cohort(spark, d))


RULED = plan.CohortRules(cohort_end=COHORT_END, start_date="1996-01-01", min_age=30, max_age=70, grace_days=90)


@query("eligibility_cohort_all_rules", with_sql(EXAMS, CONF, PERSONS, KEPT, INDEX, EVENTS, SEEN, LABELS)[:-1] + """,
  early AS (SELECT exam_id FROM lab WHERE y = 1 AND event = 1 AND survival <= 90),
  aged AS (SELECT exam_id FROM idx JOIN persons ON entity_id = person_id WHERE floor((ts - person_birth) / 365.2425) BETWEEN 30 AND 70),
  """ + ELIG.strip().replace("FROM lab WHERE", """FROM lab WHERE ts >= DATE '1996-01-01' AND exam_id NOT IN (SELECT exam_id FROM early)
    AND exam_id IN (SELECT exam_id FROM aged) AND""").replace("event_date IS NULL OR event_date >= ts", "(event_date IS NULL OR event_date >= ts)") + """
  SELECT y AS year, count(*) AS n_exams, CAST(sum(event) AS BIGINT) AS n_events,
  CAST(sum(followup) AS BIGINT) AS n_followed, CAST(sum(eligible) AS BIGINT) AS n_eligible FROM cohort GROUP BY 1""")
def eligibility_cohort_all_rules(spark, d):
    births = persons(spark, d).select(F.col("person_id").alias("entity_id"), F.col("person_birth").alias("birth"))
    labelled = plan.labelled_index_exams(exams(spark, d), confirmations(spark, d), RULED, births)
    return plan.yearly_counts(plan.eligible_cohort(labelled, RULED))


@query("eligibility_multiyear", FULL + """SELECT exam_id, entity_id, y AS year, event, followup, eligible FROM cohort""")
def eligibility_multiyear(spark, d):
    df = _cohort(spark, d)
    return df.select("exam_id", "entity_id", per_year(df, "event", "followup", "eligible").alias("y")).select(
        "exam_id", "entity_id", "y.year", "y.event", "y.followup", "y.eligible"
    )


@query("cohort_attrition", FULL + """SELECT (SELECT count(*) FROM idx) AS index_rows,
  (SELECT count(*) FROM lab WHERE y = 1 AND ts >= DATE '1996-01-01') AS after_start_date,
  (SELECT count(*) FROM lab WHERE y = 1 AND ts >= DATE '1996-01-01' AND (event_date IS NULL OR event_date >= ts)) AS after_past_event,
  (SELECT count(*) FROM lab WHERE y = 1 AND ts >= DATE '1996-01-01' AND (event_date IS NULL OR event_date >= ts) AND NOT (event = 1 AND survival <= 90)) AS after_grace_period,
  (SELECT count(*) FROM lab WHERE y = 1 AND ts >= DATE '1996-01-01' AND (event_date IS NULL OR event_date >= ts) AND NOT (event = 1 AND survival <= 90)) AS after_unique_id,
  (SELECT count(*) FROM lab WHERE y = 1 AND ts >= DATE '1996-01-01' AND (event_date IS NULL OR event_date >= ts) AND NOT (event = 1 AND survival <= 90)
    AND exam_id IN (SELECT exam_id FROM elig WHERE eligible = 1)) AS eligible""")
def cohort_attrition(spark, d):
    rules = plan.CohortRules(cohort_end=COHORT_END, start_date="1996-01-01", grace_days=90)
    return plan.cohort_attrition(_labelled(spark, d), rules)


# ------------------------------------------------------------------ histories
@query("history_collect_sorted", with_sql(EXAMS) + """SELECT entity_id, CAST((rn - 1) // 1024 AS INTEGER) AS page, count(*) AS n_events,
  string_agg(CAST(exam_id AS VARCHAR), ',' ORDER BY rn) AS keys, string_agg(CAST(ts AS VARCHAR), ',' ORDER BY rn) AS dates,
  string_agg(CAST(code AS VARCHAR), ',' ORDER BY rn) AS codes
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, exam_id) AS rn FROM exams) GROUP BY 1, 2""")
def history_collect_sorted(spark, d):
    return _printed(H.history_pages(exams(spark, d), "entity_id", "ts", "exam_id", ["code"]), "exam_id", "code", "codes")


def _printed(pages, key, value, value_name):
    text = lambda f: F.array_join(F.transform("events", lambda e: e[f].cast("string")), ",")
    return pages.select(
        "entity_id", "page", F.size("events").cast("bigint").alias("n_events"),
        text(key).alias("keys"), text("ts").alias("dates"), text(value).alias(value_name),
    )


@query("confirmation_history", with_sql(CONF) + """SELECT entity_id, CAST((rn - 1) // 1024 AS INTEGER) AS page, count(*) AS n_events,
  string_agg(conf_key, ',' ORDER BY rn) AS keys, string_agg(CAST(ts AS VARCHAR), ',' ORDER BY rn) AS dates,
  string_agg(CAST(result AS VARCHAR), ',' ORDER BY rn) AS results
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, conf_key, result) AS rn FROM conf) GROUP BY 1, 2""")
def confirmation_history(spark, d):
    pages = H.history_pages(confirmations(spark, d), "entity_id", "ts", "conf_key", ["result"])
    return _printed(pages, "conf_key", "result", "results")


@query("questionnaire_history", with_sql(ANSWERS) + """SELECT entity_id, CAST((rn - 1) // 1024 AS INTEGER) AS page, count(*) AS n_events,
  string_agg(CAST(answer_id AS VARCHAR), ',' ORDER BY rn) AS keys,
  string_agg(coalesce(flag, '-'), ',' ORDER BY rn) AS flags, string_agg(coalesce(CAST(children AS VARCHAR), '-'), ',' ORDER BY rn) AS children
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, answer_id) AS rn FROM answers) GROUP BY 1, 2""")
def questionnaire_history(spark, d):
    pages = H.history_pages(answers(spark, d), "entity_id", "ts", "answer_id", ["flag", "children"])
    text = lambda f: F.array_join(F.transform("events", lambda e: F.coalesce(e[f].cast("string"), F.lit("-"))), ",")
    return pages.select(
        "entity_id", "page", F.size("events").cast("bigint").alias("n_events"),
        text("answer_id").alias("keys"), text("flag").alias("flags"), text("children").alias("children"),
    )


@query("truncate_at_first_high", with_sql(EXAMS, KEPT) + "SELECT entity_id, exam_id, CAST(ts AS VARCHAR) AS ts, code FROM kept")
def truncate_at_first_high(spark, d):
    kept = H.truncate_at_first_high(exams(spark, d), "entity_id", "ts", "exam_id", "code")
    return kept.select("entity_id", "exam_id", day("ts").alias("ts"), "code")


@query("explode_index_exams", with_sql(EXAMS, KEPT, INDEX) + """SELECT entity_id, exam_id, CAST(ts AS VARCHAR) AS ts, code, n_prior,
  CAST(first_prior_date AS VARCHAR) AS first_prior_date, max_prior_code, n_complete, CAST(first_exam_date AS VARCHAR) AS first_exam_date FROM idx""")
def explode_index_exams(spark, d):
    return _index(spark, d).select(
        "entity_id", "exam_id", day("ts").alias("ts"), "code", "n_prior", day("first_prior_date").alias("first_prior_date"),
        "max_prior_code", "n_complete", day("first_exam_date").alias("first_exam_date"),
    )


@query("point_in_time_self_join", with_sql(EXAMS) + """SELECT exam_id, count(*) OVER w AS n_prior, CAST(min(ts) OVER w AS VARCHAR) AS first_prior,
  CAST(sum(code) OVER w AS BIGINT) AS sum_prior_codes, CAST(max(exam_id) OVER w AS BIGINT) AS max_prior_key,
  CAST(count(*) FILTER (code = 5) OVER w AS BIGINT) AS n_prior_5
  FROM exams WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def point_in_time_self_join(spark, d):
    ex = exams(spark, d)
    out = H.prior_history(
        ex, ex, "entity_id", "ts", "ts",
        {
            "first_prior": ("min", F.col("ts")), "sum_prior_codes": ("sum", F.col("code")),
            "max_prior_key": ("max", F.col("exam_id")), "n_prior_5": ("sum", (F.col("code") == 5).cast("int")),
        },
    )
    return out.select("exam_id", "n_prior", day("first_prior").alias("first_prior"), "sum_prior_codes", "max_prior_key", "n_prior_5")


PIT = """
pit AS (SELECT e.exam_id, CASE WHEN max(h.entity_id) IS NULL THEN NULL ELSE count(a.answer_id) END AS n_answers, max(a.children) AS children,
  max(CASE coalesce(a.flag, 'N') WHEN 'S' THEN 1 WHEN 'N' THEN 0 END) FILTER (a.answer_id IS NOT NULL) AS flag
  FROM exams e LEFT JOIN (SELECT DISTINCT entity_id FROM answers) h ON h.entity_id = e.entity_id
  LEFT JOIN answers a ON a.entity_id = e.entity_id AND a.ts <= e.ts GROUP BY 1)"""


def _pit(spark, d):
    from ..functions.text import flag_map

    ans = answers(spark, d).withColumn("flag", flag_map(F.col("flag")))
    return H.point_in_time_features(exams(spark, d), ans, "entity_id", "ts", "ts", ["children", "flag"])


@query("point_in_time_features", with_sql(EXAMS, ANSWERS, PIT) + "SELECT exam_id, n_answers, children, flag FROM pit")
def point_in_time_features(spark, d):
    return _pit(spark, d).select("exam_id", "n_answers", "children", "flag")


@query("min_max_list_features", with_sql(EXAMS, ANSWERS, PIT) + """SELECT exam_id, CASE WHEN children >= 6 THEN 6 ELSE children END AS children_max,
  CASE WHEN children >= 5 THEN 5 ELSE children END AS losses_max, flag AS flag_max FROM pit""")
def min_max_list_features(spark, d):
    # a null list or an empty one gives null; the caps are the two top groups
    capped = lambda n: F.when(F.col("children").isNotNull(), F.least("children", F.lit(n)))
    return _pit(spark, d).select(
        "exam_id", capped(6).alias("children_max"), capped(5).alias("losses_max"), F.col("flag").alias("flag_max")
    )


@query("history_flag_any", with_sql(EXAMS, REPORTS) + """, flagged AS (SELECT report_id AS exam_id FROM reports WHERE text IS NOT NULL AND text ILIKE '%mastectomia%')
  SELECT exam_id, bool_or(f) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flag
  FROM (SELECT e.*, e.exam_id IN (SELECT exam_id FROM flagged) AS f FROM exams e)""")
def history_flag_any(spark, d):
    ex = exams(spark, d)
    flagged = reports(spark, d).where(F.col("text").rlike("(?iu)mastectomia")).select(F.col("report_id").alias("exam_id"))
    return H.history_flag_any(ex, ex, flagged, "entity_id", "ts", "ts", "exam_id").select("exam_id", "flag")


@query("first_last_date", with_sql(EXAMS, KEPT, ANSWERS) + """SELECT e.entity_id, CAST(min(e.ts) AS VARCHAR) AS first_exam_date,
  CAST(max(k.last_benign) AS VARCHAR) AS last_benign_date, CAST(CAST(max(a.first_answer) AS DATE) AS VARCHAR) AS first_answer_date
  FROM exams e LEFT JOIN (SELECT entity_id, max(ts) AS last_benign FROM kept GROUP BY 1) k ON k.entity_id = e.entity_id
  LEFT JOIN (SELECT entity_id, min(ts) AS first_answer FROM answers GROUP BY 1) a ON a.entity_id = e.entity_id GROUP BY 1""")
def first_last_date(spark, d):
    ex = exams(spark, d)
    kept = H.truncate_at_first_high(ex, "entity_id", "ts", "exam_id", "code")
    return (
        ex.groupBy("entity_id").agg(day(F.min("ts")).alias("first_exam_date"))
        .join(kept.groupBy("entity_id").agg(day(F.max("ts")).alias("last_benign_date")), "entity_id", "left")
        .join(answers(spark, d).groupBy("entity_id").agg(day(F.min("ts")).alias("first_answer_date")), "entity_id", "left")
    )


@query("indices_where_code", with_sql(EXAMS) + """, pos AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, exam_id) - 1 AS i FROM exams)
  SELECT entity_id, CAST(i // 1024 AS INTEGER) AS page, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (code = 5), '') AS at_5,
  coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (code IN (1, 2, 3)), '') AS at_benign FROM pos GROUP BY 1, 2""")
def indices_where_code(spark, d):
    pages = H.history_pages(exams(spark, d), "entity_id", "ts", "exam_id", ["code"])
    codes = F.transform("events", lambda e: e["code"])
    shift = F.col("page") * H.PAGE_ROWS
    at = lambda v: F.array_join(F.transform(H.indices_where(codes, v), lambda i: (i + shift).cast("string")), ",")
    return pages.select("entity_id", "page", at([5]).alias("at_5"), at([1, 2, 3]).alias("at_benign"))


@query("dates_where_flag_set", with_sql(ANSWERS) + """SELECT entity_id, CAST((rn - 1) // 1024 AS INTEGER) AS page,
  string_agg(CASE WHEN flag = 'S' THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE '-' END, ',' ORDER BY rn) AS dates
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, answer_id) AS rn FROM answers) GROUP BY 1, 2""")
def dates_where_flag_set(spark, d):
    pages = H.history_pages(answers(spark, d), "entity_id", "ts", "answer_id", ["flag"])
    dated = F.transform("events", lambda e: F.when(e["flag"] == "S", e["ts"]))
    return pages.select(
        "entity_id", "page",
        F.array_join(F.transform(dated, lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit("-"))), ",").alias("dates"),
    )


@query("latest_k_pad_mask", with_sql(EXAMS) + """, pos AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, exam_id DESC) AS back FROM exams),
  slots AS (SELECT entity_id, slot FROM (SELECT DISTINCT entity_id FROM exams), (SELECT unnest(range(1, 6)) AS slot))
  SELECT s.entity_id, string_agg(coalesce(CAST(p.code AS VARCHAR), '0'), ',' ORDER BY slot DESC) AS codes,
  string_agg(CASE WHEN p.code IS NULL THEN '0' ELSE '1' END, ',' ORDER BY slot DESC) AS mask
  FROM slots s LEFT JOIN pos p ON p.entity_id = s.entity_id AND p.back = s.slot GROUP BY 1""")
def latest_k_pad_mask(spark, d):
    k = 5
    placed = H.history_position(exams(spark, d), "entity_id", "ts", "exam_id", total="n")
    last = placed.where(F.col("position") > F.col("n") - k)
    lists = last.groupBy("entity_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda e: e["code"]).alias("codes")
    )
    out = H.latest_padded(F.col("codes"), k, F.lit(0))
    return lists.select(
        "entity_id", F.array_join(out["items"].cast("array<string>"), ",").alias("codes"),
        F.array_join(out["mask"].cast("array<string>"), ",").alias("mask"),
    )


# ------------------------------------------------------------------ event dates and intervals
def _valid5(version):
    def run(spark, d):
        return C.valid_code5(
            exams(spark, d), confirmations(spark, d), "entity_id", "ts", "code", "result", version=version
        ).select("entity_id", "exam_id", day("ts").alias("ts"))

    return run


for _name, _version in (("validate_code5_none", 0), ("validate_code5_no_benign", 1), ("validate_code5_confirmed", 2)):
    query(_name, with_sql(EXAMS, CONF, _code5(_version)) + "SELECT entity_id, exam_id, CAST(ts AS VARCHAR) AS ts FROM valid5")(
        _valid5(_version)
    )


@query("earliest_event_date", with_sql(EXAMS, CONF, EVENTS) + """SELECT entity_id, CAST(first_code5 AS VARCHAR) AS first_code5,
  CAST(first_code6 AS VARCHAR) AS first_code6, CAST(first_confirmation AS VARCHAR) AS first_confirmation, CAST(event_date AS VARCHAR) AS event_date FROM ev""")
def earliest_event_date(spark, d):
    out = C.earliest_event_date(exams(spark, d), confirmations(spark, d), "entity_id", "ts", "code", "result")
    return out.select("entity_id", *[day(c).alias(c) for c in ("first_code5", "first_code6", "first_confirmation", "event_date")])


@query("interval_count_join", with_sql(EXAMS, CONF) + """SELECT e.exam_id, count(c.conf_key) FILTER (c.result = 0) AS n_benign,
  CASE WHEN count(c.conf_key) FILTER (c.result = 0) > 0 THEN 1 ELSE 0 END AS any_benign
  FROM exams e LEFT JOIN conf c ON c.entity_id = e.entity_id AND c.ts > e.ts + 30 AND c.ts <= CAST(e.ts + INTERVAL 18 MONTH AS DATE) GROUP BY 1""")
def interval_count_join(spark, d):
    ex = exams(spark, d)
    counts = count_in_intervals(
        ex, "entity_id", "ts",
        {"n_benign": (lambda t: C.plus_days(t, 30), lambda t: C.plus_months(t, 18), "benign")},
        confirmations(spark, d), "ts", {"benign": (F.col("result") == 0).cast("int")},
    )
    return ex.join(counts, ["entity_id", "ts"]).select(
        "exam_id", "n_benign", (F.col("n_benign") > 0).cast("int").alias("any_benign")
    )


@query("followup_dates", with_sql(EXAMS) + "SELECT exam_id, CAST(CAST(ts + INTERVAL 14 DAY AS DATE) AS VARCHAR) AS followup_14d, "
       + ", ".join(f"CAST(CAST(ts + INTERVAL {12 * y} MONTH AS DATE) AS VARCHAR) AS followup_{y}yr" for y in range(1, 11)) + " FROM exams")
def followup_dates(spark, d):
    cols = C.followup_dates(F.col("ts"))
    return exams(spark, d).select("exam_id", *[day(c.cast("date")).alias(n) for n, c in cols.items()])


@query("followup_flags", BASE + "SELECT exam_id, y AS year, n AS n_followup, CASE WHEN n > 0 THEN 1 ELSE 0 END AS followup FROM seen")
def followup_flags(spark, d):
    index = _index(spark, d)
    counts = C.followup_counts(index, exams(spark, d), confirmations(spark, d), "entity_id", "ts", "code", "result")
    joined = index.select("entity_id", "ts", "exam_id").join(counts, ["entity_id", "ts"])
    years = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"n_followup_{y}yr").alias("n_followup")) for y in C.YEARS]))
    return joined.select("exam_id", years.alias("y")).select(
        "exam_id", "y.year", "y.n_followup", (F.col("y.n_followup") > 0).cast("int").alias("followup")
    )


def _dated(spark, d):
    ev = C.earliest_event_date(exams(spark, d), confirmations(spark, d), "entity_id", "ts", "code", "result")
    return _index(spark, d).join(ev.select("entity_id", "event_date"), "entity_id", "left")


DATED = with_sql(EXAMS, CONF, KEPT, INDEX, EVENTS)
Y = "(SELECT unnest(range(1, 11))::INTEGER AS y)"


@query("interval_event_label", DATED + f"""SELECT exam_id, y AS year, CASE WHEN CAST(ts + to_months(12 * (y - 1)) AS DATE) < DATE '{COHORT_END}'
  AND event_date >= CAST(ts + to_months(12 * (y - 1)) AS DATE) AND event_date <= least(CAST(ts + to_months(12 * y) AS DATE), DATE '{COHORT_END}')
  THEN 1 ELSE 0 END AS event FROM idx LEFT JOIN ev USING (entity_id), {Y}""")
def interval_event_label(spark, d):
    lab = lambda y: C.interval_event_label("ts", "event_date", 12 * (y - 1), 12 * y, COHORT_END)
    years = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), lab(y).alias("event")) for y in C.YEARS]))
    return _dated(spark, d).select("exam_id", years.alias("y")).select("exam_id", "y.year", "y.event")


@query("survival_days", DATED + f"""SELECT exam_id, y AS year, CAST(coalesce(event_date, least(CAST(ts + to_months(12 * y) AS DATE), DATE '{COHORT_END}')) - ts AS DOUBLE) AS survival
  FROM idx LEFT JOIN ev USING (entity_id), {Y}""")
def survival_days(spark, d):
    years = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), C.survival_days("ts", "event_date", 12 * y, COHORT_END).alias("survival")) for y in C.YEARS]))
    return _dated(spark, d).select("exam_id", years.alias("y")).select("exam_id", "y.year", "y.survival")


@query("survival_months", DATED + f"""SELECT exam_id, CAST(least(CASE WHEN em <= om THEN em ELSE om END - mm, 60) AS INTEGER) AS months, CASE WHEN em <= om THEN 1 ELSE 0 END AS event
  FROM (SELECT exam_id, year(ts) * 12 + month(ts) AS mm, year(event_date) * 12 + month(event_date) AS em,
  year(o) * 12 + month(o) AS om FROM (SELECT *, least(CAST(ts + INTERVAL 60 MONTH AS DATE), DATE '{COHORT_END}') AS o FROM idx LEFT JOIN ev USING (entity_id)))""")
def survival_months(spark, d):
    out = C.survival_months(F.col("ts"), F.col("event_date"), 60, F.lit(COHORT_END).cast("date"))
    return _dated(spark, d).select("exam_id", out["months"].alias("months"), out["event"].alias("event"))


@query("days_to_event", DATED + "SELECT exam_id, CAST(event_date - ts AS BIGINT) AS days FROM idx LEFT JOIN ev USING (entity_id)")
def days_to_event(spark, d):
    return _dated(spark, d).select("exam_id", C.days_to_event(F.col("ts"), F.col("event_date")).alias("days"))


@query("grace_period_exclusion", BASE + "SELECT exam_id FROM lab WHERE y = 1 AND NOT (event = 1 AND survival <= 120)")
def grace_period_exclusion(spark, d):
    return _labelled(spark, d).where(C.grace_period_keep(F.col("event_1yr"), F.col("survival_1yr"), 120)).select("exam_id")


@query("drop_all_duplicated_ids", with_sql(CONF) + "SELECT entity_id, conf_key, CAST(ts AS VARCHAR) AS ts, result FROM conf WHERE conf_key IN (SELECT conf_key FROM conf GROUP BY 1 HAVING count(*) = 1)")
def drop_all_duplicated_ids(spark, d):
    return unique_ids_only(confirmations(spark, d), "conf_key").select("entity_id", "conf_key", day("ts").alias("ts"), "result")


# ------------------------------------------------------------------ eligibility pieces
@query("event_free_before", BASE + """SELECT exam_id, y AS year, CASE WHEN coalesce(sum(event) OVER (PARTITION BY exam_id ORDER BY y
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS free FROM lab""")
def event_free_before(spark, d):
    df = _labelled(spark, d)
    ev = [f"event_{y}yr" for y in C.YEARS]
    years = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), C.event_free_before(ev, y).alias("free")) for y in C.YEARS]))
    return df.select("exam_id", years.alias("y")).select("exam_id", "y.year", "y.free")


def _later(flag, name):
    def run(spark, d):
        cols = [f"{flag}_{y}yr" for y in C.YEARS]
        years = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), C.seen_at_or_after(cols, y).alias(name)) for y in C.YEARS]))
        return _labelled(spark, d).select("exam_id", years.alias("y")).select("exam_id", "y.year", f"y.{name}")

    return run


for _id, _flag, _out in (("event_at_or_after", "event", "event_later"), ("observed_at_or_after", "followup", "seen_later")):
    query(_id, BASE + f"""SELECT exam_id, y AS year, max({_flag}) OVER (PARTITION BY exam_id ORDER BY y
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {_out} FROM lab""")(_later(_flag, _out))


@query("eligibility_singleyear", BASE + """SELECT exam_id, CASE WHEN max(followup) FILTER (y >= 3) = 1 OR max(event) FILTER (y <= 3) = 1 THEN 1 ELSE 0 END AS eligibility,
  max(event) FILTER (y <= 3) AS event_indicator FROM lab GROUP BY 1""")
def eligibility_singleyear(spark, d):
    df = _labelled(spark, d)
    return C.eligibility_singleyear(df, [f"event_{y}yr" for y in C.YEARS], [f"followup_{y}yr" for y in C.YEARS], 3).select(
        "exam_id", "eligibility", "event_indicator"
    )


@query("days_before_index", with_sql(EXAMS) + """SELECT exam_id, CAST(n * (ts - DATE '1970-01-01') - s AS BIGINT) AS sum_days_before, CAST(ts - f AS INTEGER) AS max_days_before
  FROM (SELECT exam_id, ts, count(*) OVER w AS n, sum(ts - DATE '1970-01-01') OVER w AS s, min(ts) OVER w AS f FROM exams
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def days_before_index(spark, d):
    ex = exams(spark, d)
    out = H.prior_history(ex, ex, "entity_id", "ts", "ts", {"day_sum": ("sum", F.unix_date("ts")), "first": ("min", F.col("ts"))})
    return out.select(
        "exam_id", (F.col("n_prior") * F.unix_date("ts") - F.col("day_sum")).alias("sum_days_before"),
        F.datediff("ts", "first").alias("max_days_before"),
    )


@query("lookback_limit", with_sql(EXAMS) + """SELECT e.exam_id, count(*) AS n_prior, CAST(sum(p.code) AS BIGINT) AS sum_codes FROM exams e
  JOIN exams p ON p.entity_id = e.entity_id AND p.ts <= e.ts AND p.ts >= CAST(e.ts - INTERVAL 36 MONTH AS DATE) GROUP BY 1""")
def lookback_limit(spark, d):
    ex = exams(spark, d)
    span = (lambda t: F.add_months(t, -36), lambda t: t)
    counts = count_in_intervals(
        ex, "entity_id", "ts", {"n_prior": (*span, "one"), "sum_codes": (*span, "code")}, ex, "ts",
        {"one": F.lit(1), "code": F.col("code")}, lower_closed=True,
    )
    return ex.join(counts, ["entity_id", "ts"]).select("exam_id", "n_prior", "sum_codes")


@query("age_in_years", with_sql(EXAMS, PERSONS) + """SELECT exam_id, CAST(floor((ts - person_birth) / 365.2425) AS INTEGER) AS age_at_exam,
  CAST(floor((f - person_birth) / 365.2425) AS INTEGER) AS age_at_first
  FROM (SELECT *, min(ts) OVER (PARTITION BY entity_id) AS f FROM exams) JOIN persons ON person_id = entity_id""")
def age_in_years(spark, d):
    ex = exams(spark, d)
    first = ex.groupBy("entity_id").agg(F.min("ts").alias("first_ts"))
    people = persons(spark, d).select(F.col("person_id").alias("entity_id"), "person_birth").join(first, "entity_id")
    return ex.join(people, "entity_id").select(
        "exam_id", C.age_in_years(F.col("person_birth"), F.col("ts")).alias("age_at_exam"),
        C.age_in_years(F.col("person_birth"), F.col("first_ts")).alias("age_at_first"),
    )

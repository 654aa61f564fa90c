"""The two whole jobs, with check SQL over all that is not a fuzzy score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import topics as T
from ..plans import masters as M
from ..plans.report_coding import confirmation_reports, report_outcomes
from ..session import stage_path
from ..sources import writers
from .grounding import PATIENTS, PERSONS, REPORTS, USERS, day, patients, persons, reports, table, users, with_sql
from .registry import query
from .text_queries import KEYWORD_SQL, PREFIXED_SQL, SIGNATURE_SQL, words_or


@query("confirmation_pipeline", with_sql(REPORTS) + f"""SELECT person_id, count(*) AS n_reports, strftime(min(ts), '%Y-%m-%d') AS first_date,
  CAST(max(CASE content WHEN 'maligno' THEN 1 ELSE 0 END) AS INTEGER) AS any_positive, count(*) FILTER (content = 'benigno') AS n_benign FROM
  (SELECT entity_id, ts, CASE WHEN regexp_matches(p, '{words_or(T.MALIGNANT_WORDS)}') THEN 'maligno' WHEN regexp_matches(p, '{words_or(T.BENIGN_WORDS)}') THEN 'benigno' ELSE 'indeterminado' END AS content FROM
    (SELECT entity_id, ts, regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(text, {SIGNATURE_SQL}, '', 'g'), {PREFIXED_SQL}, '', 'g'))), '[^\\x00-\\x7F]', '', 'g') AS p FROM
      (SELECT DISTINCT ON (visit_id, entity_id, text) * FROM reports WHERE text IS NOT NULL AND {KEYWORD_SQL} ORDER BY report_id)))
  LEFT JOIN (SELECT c_custkey AS entity_id, c_custkey + 1 AS person_id FROM customer) USING (entity_id) GROUP BY person_id""")
def confirmation_pipeline(spark, d):
    """Confirmation reports of each person: staged, linked and coded; the kind of report is in ``confirmation_stages``."""
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") + 1).alias("person_id"))
    staged = writers.write_stage(
        confirmation_reports(reports(spark, d), links, visit="visit_id", entity="entity_id", text="text"), stage_path(spark, "confirmations")
    )
    labelled = staged.join(report_outcomes(staged, "key", "text"), "key").withColumn("result", T.outcome_code(F.col("content")))
    return labelled.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_reports"), F.min(day("ts")).alias("first_date"), F.max("result").alias("any_positive"),
        F.count_if(F.col("content") == "benigno").alias("n_benign"),
    )


@query("master_pipeline", with_sql(PERSONS, PATIENTS, USERS) + """SELECT person_id, CASE upper(coalesce(sex, 'F')) WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS sex_code,
  CASE WHEN length(zip) = 8 THEN substr(trim(zip), 1, 3) ELSE 'no_zip_code' END AS zip_category, n_users, CAST(reference_date AS VARCHAR) AS reference_date, payment_min, payment_max, n_candidates
  FROM persons LEFT JOIN (SELECT person_id, count(DISTINCT user_code) AS n_users, min(reference_date) AS reference_date, min(payment) AS payment_min, max(payment) AS payment_max FROM users GROUP BY 1) USING (person_id)
  LEFT JOIN (SELECT person_id, count(*) AS n_candidates FROM (SELECT DISTINCT person_id, patient_id FROM patients) GROUP BY 1) USING (person_id)""")
def master_pipeline(spark, d):
    """The master tables of each person; the linkage scores and valid pairs are in ``record_linkage_similarity`` and ``master_stages``."""
    out = M.masters(persons(spark, d), patients(spark, d), users(spark, d))
    stages = {name: writers.write_stage(df, stage_path(spark, name)) for name, df in out.items()}
    candidates = stages["similarity"].groupBy("person_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return stages["persons"].join(stages["users"], "person_id", "left").join(candidates, "person_id", "left").select(
        "person_id", "sex_code", "zip_category", "n_users", day("reference_date").alias("reference_date"), "payment_min", "payment_max", "n_candidates"
    )

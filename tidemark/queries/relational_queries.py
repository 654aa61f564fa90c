"""Scans, sinks, deduplication, joins, aggregations and unions over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import topics
from ..functions.names import birthdate_similarity, name_initials, normalize_name, pair_score
from ..operators import relational as R
from ..operators.history import truncate_at_first_high
from ..operators.linkage import EXAM_THRESHOLD, score_pairs
from ..operators.ordering import quantiles, score_rank
from ..plans import masters as M
from ..plans.report_coding import confirmation_reports, report_outcomes
from ..session import stage_path
from ..sources import readers, validation, vector_store, writers
from ..streaming.ingest import ingest_available
from .cohort_queries import KEPT
from .grounding import (
    ANSWERS, CONF, EXAMS, PATIENTS, PERSONS, REPORTS, SCORES, USERS, answers, confirmations, day, exams, patients,
    persons, reports, scores, table, users, with_sql,
)
from .registry import query

STRIP = "trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
TS = "CAST(ts AS VARCHAR) AS ts"


# ------------------------------------------------------------------ scans
# sha1 over Latin-1 bytes: DuckDB hashes UTF-8, so only the pure-ASCII texts carry the hash in the check.
@query("scan_exam_reports", with_sql(REPORTS) + f"""SELECT report_id, length({STRIP}) AS n,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN NULL ELSE CAST(visit_id AS VARCHAR) || sha1({STRIP}) END AS key
  FROM reports WHERE text IS NOT NULL""")
def scan_exam_reports(spark, d):
    out = readers.with_report_key(reports(spark, d), "visit_id", "text")
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return out.select("report_id", F.length("report_text").cast("bigint").alias("n"), F.when(ascii_only, F.col("key")).alias("key"))


@query("report_key", with_sql(REPORTS) + f"""SELECT report_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 40 ELSE NULL END AS latin1_hash_length,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN NULL ELSE CAST(visit_id AS VARCHAR) || sha1({STRIP}) END AS key FROM reports WHERE text IS NOT NULL""")
def report_key(spark, d):
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    key = X.report_key(F.col("visit_id"), F.col("text"))
    return reports(spark, d).where(F.col("text").isNotNull()).select(
        "report_id",
        F.when(~ascii_only, F.length(key) - F.length(F.col("visit_id").cast("string"))).alias("latin1_hash_length"),
        F.when(ascii_only, key).alias("key"),
    )


@query("scan_questionnaires_clamped", with_sql(ANSWERS) + """SELECT answer_id, CASE WHEN ts > TIMESTAMP '1997-01-05' AND ts < TIMESTAMP '1997-01-20'
  THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts FROM answers""")
def scan_questionnaires_clamped(spark, d):
    out = readers.clamp_dates(answers(spark, d), ["ts"], "1997-01-05", "1997-01-20")
    return out.select("answer_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("scan_confirmations_bounded", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ts FROM lineitem
  WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""")
def scan_confirmations_bounded(spark, d):
    out = readers.bound_dates(
        readers.read_projected(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_shipdate"]),
        ["l_shipdate"], "1996-01-01", "1999-12-31",
    )
    return out.select("l_orderkey", "l_linenumber", day("l_shipdate").alias("ts"))


@query("scan_master_dedup", """SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2""")
def scan_master_dedup(spark, d):
    return readers.read_master(spark, d, "orders", ["o_custkey", "o_orderpriority", "o_orderkey"], ["o_custkey", "o_orderpriority"])


@query("patient_person_map", with_sql(PERSONS, PATIENTS) + "SELECT DISTINCT patient_id, person_id FROM patients")
def patient_person_map(spark, d):
    return patients(spark, d).select("patient_id", "person_id").distinct()


@query("scan_by_ids", with_sql(EXAMS) + """SELECT exam_id, entity_id FROM exams WHERE entity_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
  AND CAST('0x' || substr(md5('42:' || exam_id), 1, 8) AS BIGINT) < CAST(floor(0.5 * 4294967296) AS BIGINT)""")
def scan_by_ids(spark, d):
    ids = table(spark, d, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("entity_id"))
    kept = readers.read_by_ids(exams(spark, d), ids, "entity_id", ["exam_id", "entity_id"])
    return readers.hash_fraction(kept, "exam_id", 0.5)


@query("scan_projected_batches", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_projected_batches(spark, d):
    return readers.read_projected(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("load_rows_for_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def load_rows_for_ids(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return readers.read_by_ids(table(spark, d, "orders"), ids, "o_custkey", ["o_orderkey", "o_totalprice", "o_custkey"]).drop("o_custkey")


@query("resumable_chunk_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def resumable_chunk_ingest(spark, d):
    target, state = stage_path(spark, "ingest"), stage_path(spark, "ingest-state")
    schema = table(spark, d, "events").schema
    for _ in range(2):  # the second run finds nothing left to do
        ingest_available(spark, d, schema, target, state, glob="events*.parquet")
    return spark.read.schema(schema).parquet(target).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("sink_parquet_stage", with_sql(EXAMS) + "SELECT code, count(*) AS n, CAST(max(ts) AS VARCHAR) AS last FROM exams GROUP BY 1")
def sink_parquet_stage(spark, d):
    back = writers.write_stage(exams(spark, d), stage_path(spark, "exams"), partition_by=["code"])
    return back.groupBy("code").agg(F.count(F.lit(1)).alias("n"), day(F.max("ts")).alias("last"))


def _outcome_texts(spark, d):
    labels = table(spark, d, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("key"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "benigno, antes maligno").when(F.col("toxic") == 1, 'maligno: "câncer"\ngrau 2')
        .when(F.col("quality") == 0, "indeterminado").otherwise("benigno(fibroadenoma)").alias("content"),
    )


OUTCOME_TEXTS = """
outc AS (SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN toxic = 1 AND quality = 1 THEN 'benigno, antes maligno' WHEN toxic = 1 THEN 'maligno: "câncer"' || chr(10) || 'grau 2'
  WHEN quality = 0 THEN 'indeterminado' ELSE 'benigno(fibroadenoma)' END AS content FROM labels)"""


@query("csv_labels_scan", with_sql(OUTCOME_TEXTS) + "SELECT key, content FROM outc")
def csv_labels_scan(spark, d):
    path = stage_path(spark, "labels-csv")
    writers.write_csv(_outcome_texts(spark, d), path, encoding="ISO-8859-1")
    return readers.read_label_csv(spark, path)


@query("csv_sink", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_sink(spark, d):
    path = stage_path(spark, "suppliers-csv")
    writers.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")), path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").option("header", True).csv(path)


@query("vector_store_sink", "SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_store_sink(spark, d):
    back = writers.write_vectors(table(spark, d, "embeddings"), stage_path(spark, "vectors"), "vec_id", "embedding")
    return back.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("vector_store_lookup", "SELECT c_custkey AS vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM customer LEFT JOIN embeddings ON vec_id = c_custkey")
def vector_store_lookup(spark, d):
    path = stage_path(spark, "vectors")
    vector_store.append_vectors(table(spark, d, "embeddings"), path, "vec_id", "embedding", 1)
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"))
    return vector_store.lookup_vectors(ids, path, "vec_id", "embedding").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("vector_store_append", """SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings""")
def vector_store_append(spark, d):
    """Two batches of one store: the second replaces a third of the vectors."""
    path, rows = stage_path(spark, "vectors"), table(spark, d, "embeddings").select("vec_id", "embedding")
    vector_store.append_vectors(rows, path, "vec_id", "embedding", 1)
    newer = rows.where(F.col("vec_id") % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    vector_store.append_vectors(newer, path, "vec_id", "embedding", 2)
    latest = vector_store.all_vectors(spark, path, "vec_id", "embedding")
    return latest.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


# ------------------------------------------------------------------ logs
def _tuning_lines(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.when(F.col("event_id") % 50 != 0, F.col("event_id").cast("int")).alias("trial_number"),
        F.date_format("ts", "yyyy-MM-dd").alias("init_date"), F.lit("load-1").alias("load_id"),
        F.col("event_type").alias("dataset_name"), F.concat(F.lit("split-"), (k % 2).cast("string")).alias("split_config_name"),
        (F.col("user_id") % 5 + 1).cast("int").alias("target_year"), F.lit(15).alias("total_epochs_per_trial"),
        F.col("value").alias("result"),
        F.struct((k / 100.0).alias("dropout"), (k % 4 + 1).alias("depth"), (k * 8).alias("layer_0_units"),
                 F.lit(0.01).alias("weight_decay"), F.lit(0.001).alias("learning_rate"), F.lit("adam").alias("optimizer")).alias("params"),
    )


TUNING = """
tun AS (SELECT CASE WHEN event_id % 50 <> 0 THEN CAST(event_id AS INTEGER) END AS trial_number, event_type AS dataset_name, 'split-' || (k % 2) AS split_config_name,
  CAST(user_id % 5 + 1 AS INTEGER) AS target_year, value AS result, k % 4 + 1 AS depth, k * 8 AS units
  FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))"""


def _tuning_log(spark, d):
    from ..schemas import TUNING_LOG

    path = stage_path(spark, "tuning-log")
    writers.write_json_lines(_tuning_lines(spark, d), path)
    return readers.read_log(spark, path, TUNING_LOG)


@query("jsonl_log_scan", with_sql(TUNING) + "SELECT trial_number, split_config_name, round(result, 6) AS result, depth FROM tun WHERE dataset_name = 'click' AND target_year = 5")
def jsonl_log_scan(spark, d):
    log = _tuning_log(spark, d).where((F.col("dataset_name") == "click") & (F.col("target_year") == 5))
    return log.select("trial_number", "split_config_name", F.round("result", 6).alias("result"), F.col("params.depth").alias("depth"))


@query("tuning_results", with_sql(TUNING) + "SELECT dataset_name, target_year, split_config_name, trial_number, round(result, 6) AS result FROM tun")
def tuning_results(spark, d):
    return _tuning_log(spark, d).select("dataset_name", "target_year", "split_config_name", "trial_number", F.round("result", 6).alias("result"))


@query("best_trial", with_sql(TUNING) + """SELECT dataset_name, target_year, split_config_name, trial_number, round(result, 6) AS result, units FROM
  (SELECT *, row_number() OVER (PARTITION BY dataset_name, target_year, split_config_name ORDER BY result DESC, trial_number) AS rn FROM tun WHERE trial_number IS NOT NULL) WHERE rn = 1""")
def best_trial(spark, d):
    log = _tuning_log(spark, d).where(F.col("trial_number").isNotNull())
    best = F.max(F.struct("result", (-F.col("trial_number")).alias("neg"), "params"))
    return log.groupBy("dataset_name", "target_year", "split_config_name").agg(best.alias("b")).select(
        "dataset_name", "target_year", "split_config_name", (-F.col("b.neg")).alias("trial_number"),
        F.round("b.result", 6).alias("result"), F.col("b.params.layer_0_units").alias("units"),
    )


@query("validate_log_rows", with_sql(TUNING) + """SELECT count(*) AS n_lines, count(*) FILTER (trial_number IS NOT NULL) AS n_valid FROM tun""")
def validate_log_rows(spark, d):
    required = ["trial_number", "init_date", "load_id", "dataset_name", "target_year", "total_epochs_per_trial", "result", "params.dropout", "params.depth"]
    checked = validation.log_errors(_tuning_log(spark, d), required)
    return checked.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("errors") == 0).alias("n_valid"))


@query("epoch_metrics_table", """SELECT event_id AS epoch, CAST(user_id % 3 AS INTEGER) AS fold, round(value / 100, 6) AS train_loss, round(value / 200, 6) AS valid_auroc FROM events WHERE user_id % 3 = 1""")
def epoch_metrics_table(spark, d):
    from ..schemas import TRAINING_LOG

    metrics = lambda s: F.struct(
        (F.col("user_id") % 3).cast("int").alias("CV"), (F.col("value") / 100).alias("Loss"),
        (F.col("value") / s).alias("AUROC"), (F.col("value") / 300).alias("Average Precision"))
    lines = table(spark, d, "events").select(
        F.lit("conf").alias("config_dir_path"), F.lit("s").alias("split_config_name"), F.lit("t").alias("training_config_name"),
        F.col("event_id").cast("int").alias("epoch"), F.lit(5).alias("target year"),
        metrics(150).alias("training metrics"), metrics(200).alias("validation metrics"),
    )
    path = stage_path(spark, "training-log")
    writers.write_json_lines(lines, path)
    log = readers.read_log(spark, path, TRAINING_LOG)
    return log.where(F.col("`training metrics`.CV") == 1).select(
        F.col("epoch").cast("bigint").alias("epoch"), F.col("`training metrics`.CV").alias("fold"),
        F.round("`training metrics`.Loss", 6).alias("train_loss"), F.round("`validation metrics`.AUROC", 6).alias("valid_auroc"),
    )


@query("validate_rows", with_sql(REPORTS, ANSWERS) + """SELECT answer_id, CASE WHEN flag IS NULL AND complaint IS NULL THEN 'complaint: not bigint' END AS none, n_errors, first_error FROM (
  SELECT answer_id, flag, complaint, CAST((CASE WHEN flag IS NULL THEN 1 ELSE 0 END) + (CASE WHEN complaint IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS n_errors,
  CASE WHEN flag IS NULL THEN 'flag: required' WHEN complaint IS NOT NULL THEN 'complaint: not bigint' END AS first_error FROM answers)""".replace(
    "CASE WHEN flag IS NULL AND complaint IS NULL THEN 'complaint: not bigint' END AS none, ", ""))
def validate_rows(spark, d):
    contract = T.StructType([
        T.StructField("answer_id", T.LongType(), False), T.StructField("flag", T.StringType(), False),
        T.StructField("complaint", T.LongType(), True), T.StructField("value", T.DoubleType(), True),
    ])
    checked = validation.validate_rows(answers(spark, d), contract, with_file=True)
    return checked.select("answer_id", F.size("errors").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_error"))


# ------------------------------------------------------------------ dedup, filters, projections
@query("dedup_by_key", """SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)).o_orderkey AS o_orderkey FROM
  (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey FROM orders) GROUP BY 1, 2""".replace(
    "min((o_orderdate, o_orderkey)).o_orderkey", "arg_min(o_orderkey, (o_orderdate, o_orderkey))"))
def dedup_by_key(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    return R.first_row(df, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("two_phase_dedup", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def two_phase_dedup(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").dropDuplicates()


@query("split_single_multi", """SELECT l_orderkey, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'single' ELSE 'multi' END AS part FROM lineitem""")
def split_single_multi(spark, d):
    single, multi = R.split_single_multi(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    return single.withColumn("part", F.lit("single")).unionByName(multi.withColumn("part", F.lit("multi")))


@query("range_filter_inclusive", with_sql(EXAMS, PERSONS) + "SELECT person_id FROM persons WHERE person_birth BETWEEN DATE '1930-01-01' AND DATE '1960-12-31'")
def range_filter_inclusive(spark, d):
    lo, hi = F.lit("1930-01-01").cast("date"), F.lit("1960-12-31").cast("date")
    return persons(spark, d).where(F.col("person_birth").between(lo, hi)).select("person_id")


@query("coalesce_sources", with_sql(EXAMS) + """SELECT exam_id, code FROM exams WHERE code <> 3
  UNION ALL SELECT doc_id AS exam_id, quality AS code FROM labels""")
def coalesce_sources(spark, d):
    by_rule = exams(spark, d).select("exam_id", F.when(F.col("code") != 3, F.col("code")).alias("code"))
    by_model = table(spark, d, "labels").select(F.col("doc_id").alias("exam_id"), F.col("quality").cast("int").alias("predicted"))
    return R.coalesce_sources([by_rule, by_model], "code", ["code", "predicted"])


@query("topic_row_filter", with_sql(REPORTS) + "SELECT report_id FROM reports WHERE regexp_matches(text, '(?i)\\b(mama(s)?|mam[áa]ria(s)?|mam[áa]rio(s)?)\\b')")
def topic_row_filter(spark, d):
    return reports(spark, d).where(topics.keyword_flag(F.col("text"))).select("report_id")


@query("split_labelled", with_sql(EXAMS) + "SELECT entity_id, count(*) FILTER (code >= 4) AS with_code, count(*) FILTER (code < 4) AS without_code FROM exams GROUP BY 1")
def split_labelled(spark, d):
    ex = exams(spark, d).select("entity_id", F.when(F.col("code") >= 4, F.col("code")).alias("found"))
    with_code, without = R.split_labelled(ex, "found")
    both = with_code.withColumn("w", F.lit(1)).unionByName(without.withColumn("w", F.lit(0)))
    return both.groupBy("entity_id").agg(F.count_if(F.col("w") == 1).alias("with_code"), F.count_if(F.col("w") == 0).alias("without_code"))


@query("flag_filter_drop", with_sql(CONF) + "SELECT entity_id, conf_key, CAST(ts AS VARCHAR) AS ts FROM conf WHERE result = 0")
def flag_filter_drop(spark, d):
    flagged = confirmations(spark, d).withColumn("flag", F.col("result") == 1).drop("result")
    return R.drop_flagged(flagged, "flag").withColumn("ts", day("ts"))


@query("code_in_list_filter", with_sql(EXAMS) + "SELECT exam_id, code FROM exams WHERE code IN (1, 3)")
def code_in_list_filter(spark, d):
    return exams(spark, d).where(F.col("code").isin(1, 3)).select("exam_id", "code")


@query("rename_suffix_project", "SELECT o_orderkey AS exam_key, o_totalprice AS price_exam FROM orders")
def rename_suffix_project(spark, d):
    return R.select_existing(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "no_such_column"], {"o_orderkey": "exam_key", "o_totalprice": "price_exam"})


@query("null_out_of_range", "SELECT p_partkey, CASE WHEN p_size > 10 AND p_size < 40 THEN p_size END AS p_size FROM part")
def null_out_of_range(spark, d):
    return table(spark, d, "part").select("p_partkey", R.inside_open(F.col("p_size"), 10, 40).alias("p_size"))


@query("percentile_trim", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > lo AND l_extendedprice < hi THEN l_extendedprice END AS price FROM lineitem,
  (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem)""")
def percentile_trim(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    bounds = quantiles(items, "l_extendedprice", {"lo": 0.02, "hi": 0.98})
    ends = bounds.select(F.struct("lo", "hi")).scalar()
    return items.select("l_orderkey", "l_linenumber", "l_partkey", R.inside_open(F.col("l_extendedprice"), ends["lo"], ends["hi"]).alias("price"))


PRIOR_N = """
pn AS (SELECT exam_id, entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_prior FROM exams)"""


def _prior_n(spark, d):
    from ..operators.history import prior_history

    ex = exams(spark, d)
    return prior_history(ex, ex, "entity_id", "ts", "ts", {}).select("exam_id", "entity_id", "n_prior")


@query("sequence_length_outliers", with_sql(EXAMS, PRIOR_N) + "SELECT exam_id, n_prior FROM pn WHERE n_prior <= (SELECT quantile_cont(n_prior, 0.99) FROM pn)")
def sequence_length_outliers(spark, d):
    pn = _prior_n(spark, d)
    limit = quantiles(pn, "n_prior", {"limit": 0.99}).scalar()
    return pn.where(F.col("n_prior") <= limit).select("exam_id", "n_prior")


# ------------------------------------------------------------------ joins
@query("left_join_master", with_sql(EXAMS, PERSONS) + "SELECT exam_id, CAST(person_birth AS VARCHAR) AS birth, payment FROM exams LEFT JOIN persons ON person_id = entity_id")
def left_join_master(spark, d):
    people = persons(spark, d).select(F.col("person_id").alias("entity_id"), day("person_birth").alias("birth"), "payment")
    return exams(spark, d).join(people, "entity_id", "left").select("exam_id", "birth", "payment")


@query("merge_sources", with_sql(EXAMS, CONF, ANSWERS, PERSONS, USERS) + """SELECT h.entity_id, h.n_exams, CAST(h.first_exam_date AS VARCHAR) AS first_exam_date,
  CAST(floor((first_exam_date - person_birth) / 365.2425) AS INTEGER) AS age_at_first, payment_min, payment_max, n_positive, n_answers
  FROM (SELECT entity_id, count(*) AS n_exams, min(ts) AS first_exam_date FROM exams GROUP BY 1) h
  LEFT JOIN (SELECT person_id, min(payment) AS payment_min, max(payment) AS payment_max FROM users GROUP BY 1) u ON u.person_id = h.entity_id
  JOIN persons p ON p.person_id = h.entity_id
  LEFT JOIN (SELECT entity_id, count(*) FILTER (result = 1) AS n_positive FROM conf GROUP BY 1) c ON c.entity_id = h.entity_id
  LEFT JOIN (SELECT entity_id, count(*) AS n_answers FROM answers GROUP BY 1) a ON a.entity_id = h.entity_id""")
def merge_sources(spark, d):
    histories = exams(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_exams"), F.min("ts").alias("first_exam_date"))
    pay = M.user_payments(users(spark, d)).withColumnRenamed("person_id", "entity_id").select("entity_id", "payment_min", "payment_max")
    people = persons(spark, d).select(F.col("person_id").alias("entity_id"), F.col("person_birth").alias("birth"))
    conf = confirmations(spark, d).groupBy("entity_id").agg(F.count_if(F.col("result") == 1).alias("n_positive"))
    ans = answers(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_answers"))
    return M.merge_sources(histories, pay, people, conf, ans).drop("birth").withColumn("first_exam_date", day("first_exam_date"))


@query("confirmation_stages")
def confirmation_stages(spark, d):
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") + 1).alias("person_id"))
    staged = writers.write_stage(
        confirmation_reports(reports(spark, d), links, visit="visit_id", entity="entity_id", text="text"), stage_path(spark, "confirmations")
    )
    outcomes = report_outcomes(staged, "key", "text")
    labelled = staged.join(outcomes, "key").withColumn("result", topics.outcome_code(F.col("content")))
    return labelled.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_reports"), F.min(day("ts")).alias("first_date"), F.max("result").alias("any_positive"),
        F.count_if(F.col("kind") == "procedure").alias("n_procedure"),
    )


@query("master_stages")
def master_stages(spark, d):
    out = M.masters(persons(spark, d), patients(spark, d), users(spark, d))
    stages = {name: writers.write_stage(df, stage_path(spark, name)) for name, df in out.items()}
    pairs = stages["valid_pairs"].groupBy("person_id").agg(F.count(F.lit(1)).alias("n_patients"))
    return stages["persons"].join(stages["users"], "person_id", "left").join(pairs, "person_id", "left").select(
        "person_id", "sex_code", "zip_category", "n_users", "payment_min", "payment_max", "n_patients"
    )


@query("inner_join_keys", with_sql(EXAMS, REPORTS) + "SELECT report_id, entity_id FROM reports WHERE text IS NOT NULL AND report_id IN (SELECT exam_id FROM exams WHERE code >= 4)")
def inner_join_keys(spark, d):
    need = exams(spark, d).where(F.col("code") >= 4).select(F.col("exam_id").alias("report_id")).distinct()
    return reports(spark, d).where(F.col("text").isNotNull()).join(need, "report_id").select("report_id", "entity_id")


@query("semi_join_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def semi_join_ids(spark, d):
    return R.keep_ids(table(spark, d, "customer").select("c_custkey"), table(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey")


@query("anti_join_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def anti_join_ids(spark, d):
    return R.drop_ids(table(spark, d, "customer").select("c_custkey"), table(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey")


@query("except_ids", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def except_ids(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, d, "events").select(F.col("user_id").alias("id")))


@query("pair_semi_join", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS
  (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)""")
def pair_semi_join(spark, d):
    items = table(spark, d, "lineitem")
    pairs = items.where(F.col("l_returnflag") == "R").select("l_partkey", "l_suppkey").distinct()
    return R.keep_ids(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), pairs, ["l_partkey", "l_suppkey"])


@query("vector_join", with_sql(EXAMS) + "SELECT exam_id, round(CAST(embedding[1] AS DOUBLE), 6) AS v0 FROM exams LEFT JOIN embeddings ON vec_id = exam_id")
def vector_join(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("exam_id"), "embedding")
    return exams(spark, d).join(vectors, "exam_id", "left").select("exam_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("v0"))


# ------------------------------------------------------------------ record linkage
def _scored(spark, d):
    pts = patients(spark, d)
    return score_pairs(pts, persons(spark, d), pts)


@query("record_linkage_similarity")
def record_linkage_similarity(spark, d):
    scored = _scored(spark, d)
    return scored.where(F.col("similarity") >= EXAM_THRESHOLD).select(
        "person_id", "patient_id", *[F.round(c, 6).alias(c) for c in ("name_similarity", "birth_similarity", "similarity")]
    )


@query("name_similarity")
def name_similarity_query(spark, d):
    return _scored(spark, d).select("person_id", "patient_id", F.round("name_similarity", 6).alias("name_similarity"))


NORMAL = """regexp_replace(trim(regexp_replace(' ' || regexp_replace(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z'']+', ' ', 'g'), ' ', '  ', 'g') || ' ', ' (da|de|do|das|dos|e|du|d) ', ' ', 'g')), ' +', ' ', 'g')"""


@query("normalize_name", with_sql(PERSONS, PATIENTS) + f"SELECT patient_id, {NORMAL.format('patient_name')} AS name, {NORMAL.format('person_name')} AS person FROM patients JOIN persons USING (person_id)")
def normalize_name_query(spark, d):
    people = persons(spark, d).select("person_id", "person_name")
    return patients(spark, d).join(people, "person_id").select(
        "patient_id", normalize_name(F.col("patient_name")).alias("name"), normalize_name(F.col("person_name")).alias("person")
    )


@query("name_initials", with_sql(PERSONS, PATIENTS) + f"""SELECT patient_id, substr(split_part(n, ' ', 1), 1, 1) AS first, substr(split_part(n, ' ', -1), 1, 1) AS last
  FROM (SELECT patient_id, {NORMAL.format('patient_name')} AS n FROM patients)""")
def name_initials_query(spark, d):
    both = name_initials(normalize_name(F.col("patient_name")))
    return patients(spark, d).select("patient_id", both["first"].alias("first"), both["last"].alias("last"))


BIRTH = """CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN a = b THEN 1.0 WHEN abs(a - b) <= 1 THEN 0.95
  WHEN year(a) = year(b) AND month(a) = month(b) THEN 0.8 WHEN year(a) = year(b) THEN 0.6
  WHEN abs(year(a) - year(b)) = 1 AND month(a) = month(b) AND day(a) = day(b) THEN 0.85
  WHEN abs(year(a) - year(b)) = 1 AND month(a) = month(b) THEN 0.5 ELSE 0.0 END::DOUBLE"""


@query("birthdate_similarity", with_sql(PERSONS, PATIENTS) + f"""SELECT patient_id, {BIRTH} AS similarity FROM (SELECT patient_id, person_birth AS a, patient_birth AS b
  FROM patients JOIN persons USING (person_id))""")
def birthdate_similarity_query(spark, d):
    people = persons(spark, d).select("person_id", "person_birth")
    return patients(spark, d).join(people, "person_id").select(
        "patient_id", birthdate_similarity(F.col("person_birth"), F.col("patient_birth")).alias("similarity")
    )


@query("pair_score", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN n >= 0.8 AND b >= 0.8 THEN least(1.0, s + 0.05) ELSE s END, 6) AS score FROM (SELECT *,
  CASE WHEN b >= 0.95 THEN 0.45 * n + 0.55 * b WHEN b = 0 THEN 0.85 * n + 0.15 * b ELSE 0.7 * n + 0.3 * b END AS s FROM (SELECT l_orderkey, l_linenumber, l_partkey,
  l_quantity / 50 AS n, CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 WHEN 5 THEN 0.0 END::DOUBLE AS b0, coalesce(b0, 0.0) AS b FROM lineitem))""")
def pair_score_query(spark, d):
    line = F.col("l_linenumber")
    birth = F.when(line == 1, 1.0).when(line == 2, 0.95).when(line == 3, 0.8).when(line == 4, 0.6).when(line == 5, 0.0)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(pair_score(F.col("l_quantity") / 50, birth), 6).alias("score")
    )


# ------------------------------------------------------------------ aggregations
@query("user_payment_minmax", with_sql(USERS) + """SELECT person_id, count(*) AS n_users, min(user_code) AS first_user, string_agg(user_code, ',' ORDER BY user_code) AS user_codes, CAST(min(reference_date) AS VARCHAR) AS reference_date,
  min(payment) AS payment_min, max(payment) AS payment_max FROM users GROUP BY 1""")
def user_payment_minmax(spark, d):
    return M.user_payments(users(spark, d)).withColumns({"reference_date": day("reference_date"), "user_codes": F.array_join("user_codes", ",")})


@query("class_counts", with_sql(EXAMS) + "SELECT code, count(*) AS n FROM exams GROUP BY 1")
def class_counts(spark, d):
    return exams(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("collect_distinct_keys", with_sql(EXAMS, KEPT) + """SELECT DISTINCT exam_id FROM (SELECT exam_id FROM kept WHERE code >= 2 UNION ALL
  SELECT p.exam_id FROM kept p JOIN (SELECT entity_id, max(ts) AS last FROM kept WHERE code >= 2 GROUP BY 1) i ON i.entity_id = p.entity_id AND p.ts <= i.last)""")
def collect_distinct_keys(spark, d):
    kept = truncate_at_first_high(exams(spark, d), "entity_id", "ts", "exam_id", "code")
    index = kept.where(F.col("code") >= 2)
    # Prior lists are prefixes, so their union is the prefix up to the entity's last index exam.
    last = index.groupBy("entity_id").agg(F.max("ts").alias("last"))
    days = kept.select("entity_id", "ts").distinct().join(last, "entity_id").where(F.col("ts") <= F.col("last"))
    prior = R.keep_ids(kept, days, ["entity_id", "ts"]).select("exam_id")
    return index.select("exam_id").union(prior).distinct()


@query("breast_flag_share", with_sql(REPORTS) + """SELECT count(*) FILTER (f) AS n_true, count(*) AS n_total, round(100.0 * count(*) FILTER (f) / count(*), 4)::DOUBLE AS pct FROM
  (SELECT coalesce(regexp_matches(text, '(?i)\\b(mama(s)?|mam[áa]ria(s)?|mam[áa]rio(s)?)\\b'), false) AS f FROM reports)""")
def breast_flag_share(spark, d):
    flag = topics.keyword_flag(F.col("text"))
    return reports(spark, d).agg(
        F.count_if(flag).alias("n_true"), F.count(F.lit(1)).alias("n_total"),
        F.round(100 * F.count_if(flag) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("pct"),
    )


@query("mean_feature_baseline", """SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def mean_feature_baseline(spark, d):
    ids = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    cols = ["l_quantity", "l_discount", "l_tax"]
    return R.keep_ids(table(spark, d, "lineitem").select("l_orderkey", *cols), ids, "l_orderkey").agg(*[F.round(F.avg(c), 6).alias(c) for c in cols])


# ------------------------------------------------------------------ sorts, top-k, unions
@query("sort_then_first", with_sql(REPORTS) + "SELECT source, arg_min(report_id, (text, report_id)) AS report_id FROM reports WHERE text IS NOT NULL GROUP BY 1")
def sort_then_first(spark, d):
    return R.first_row(reports(spark, d).where(F.col("text").isNotNull()).select("source", "text", "report_id"), "source", ["text", "report_id"]).drop("text")


@query("first_rows_per_group", with_sql(CONF) + "SELECT conf_key, min(entity_id) AS entity_id FROM conf GROUP BY 1")
def first_rows_per_group(spark, d):
    return R.first_row(confirmations(spark, d).select("conf_key", "entity_id"), "conf_key", ["entity_id"])


@query("topk_flag_by_score", with_sql(SCORES) + """SELECT exam_id, row_number() OVER (ORDER BY score DESC, md5('42:' || exam_id)) AS rank,
  CASE WHEN row_number() OVER (ORDER BY score DESC, md5('42:' || exam_id)) <= 50 THEN 1 ELSE 0 END AS flag FROM scores""")
def topk_flag_by_score(spark, d):
    return score_rank(scores(spark, d), "score", "exam_id").select("exam_id", "rank", (F.col("rank") <= 50).cast("int").alias("flag"))


@query("union_all_chunks", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_all_chunks(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return reduce(lambda x, y: x.unionByName(y), [a, b])


@query("union_missing_cols", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_missing_cols(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("upsert_last_wins", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def upsert_last_wins(spark, d):
    return R.last_value(table(spark, d, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts")


# ------------------------------------------------------------------ exploration tables
@query("eda_key_info", with_sql(EXAMS, PERSONS) + "SELECT exam_id, CAST(person_birth AS VARCHAR) AS birth, zip, CAST(ts AS VARCHAR) AS ts, code FROM exams JOIN persons ON person_id = entity_id")
def eda_key_info(spark, d):
    people = persons(spark, d).select(F.col("person_id").alias("entity_id"), day("person_birth").alias("birth"), "zip")
    return exams(spark, d).join(people, "entity_id").select("exam_id", "birth", "zip", day("ts").alias("ts"), "code")


@query("eda_base_columns", with_sql(EXAMS, PERSONS) + """SELECT exam_id, entity_id, code, payment FROM exams LEFT JOIN persons ON person_id = entity_id
  WHERE exam_id IN (SELECT doc_id FROM labels)""")
def eda_base_columns(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("exam_id"))
    people = persons(spark, d).select(F.col("person_id").alias("entity_id"), "payment")
    base = exams(spark, d).join(people, "entity_id", "left")
    return readers.read_by_ids(base, ids, "exam_id", ["exam_id", "entity_id", "code", "payment"])


@query("fraction_sample", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CAST('0x' || substr(md5('7:' || l_orderkey), 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT)")
def fraction_sample(spark, d):
    return readers.hash_fraction(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 0.2, seed=7)

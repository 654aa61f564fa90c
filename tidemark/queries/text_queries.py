"""Report text: cleaning, severity extraction, topic and keyword rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions import text as X
from ..functions import topics as T
from ..plans.report_coding import coded_reports, report_outcomes
from .grounding import ANSWERS, PERSONS, REPORTS, answers, persons, reports, table, with_sql
from .registry import query

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TEXT = F.col


def _with_text(spark, d):
    return reports(spark, d).where(F.col("text").isNotNull())


@query("blank_if_null_trim", with_sql(REPORTS) + f"SELECT report_id, md5(trim(coalesce(text, ''), {WS})) AS clean FROM reports")
def blank_if_null_trim(spark, d):
    return reports(spark, d).select("report_id", F.md5(X.blank_if_null_trim(F.col("text"))).alias("clean"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_accents(F.col("text"))).alias("plain"))


@query("content_id", f"SELECT doc_id, substr(sha256(regexp_replace(trim(nfc_normalize(text), {WS}), '\\s+', ' ', 'g')), 1, 32) AS content_id FROM documents")
def content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id(F.col("text")).alias("content_id"))


# ------------------------------------------------------------------ severity
# The patterns need look-ahead, which the checking engine lacks.  Document prose holds no
# report token, so the expected code follows from the clinical line that each text ends with.
def _expected(cases: str, extra: str = "") -> str:
    return f"""WITH r AS (SELECT *, doc_id % 12 AS kind, CAST((doc_id // 12) % 7 AS VARCHAR) AS n FROM documents
  WHERE NOT (doc_id % 12 = 11 AND (doc_id // 12) % 7 = 0))
SELECT doc_id AS report_id, {cases} AS value{extra} FROM r"""


@query("severity_extract_direct", _expected("CASE kind WHEN 0 THEN n WHEN 3 THEN '2' WHEN 6 THEN '0' WHEN 7 THEN '4' END"))
def severity_extract_direct(spark, d):
    return _with_text(spark, d).select("report_id", S.extract_direct(F.col("text"))["value"].alias("value"))


@query("severity_extract_nearby", _expected("CASE kind WHEN 1 THEN n WHEN 2 THEN n END", ", CASE kind WHEN 1 THEN 'Categoria: ' || n WHEN 2 THEN 'Classificação ' || n END AS clause"))
def severity_extract_nearby(spark, d):
    found = S.extract_nearby(F.col("text"))
    return _with_text(spark, d).select("report_id", found["value"].alias("value"), found["clause"].alias("clause"))


@query("severity_extract_flex_max", _expected(
    "CASE kind WHEN 0 THEN n WHEN 2 THEN '5' WHEN 3 THEN '4' || substr('ABC', CAST(doc_id % 5 % 3 + 1 AS INTEGER), 1) WHEN 4 THEN n WHEN 6 THEN '0' WHEN 7 THEN '4' END",
    """, CASE kind WHEN 0 THEN n::DOUBLE WHEN 2 THEN 5.0 WHEN 3 THEN 4.1 + 0.1 * (doc_id % 5 % 3) WHEN 4 THEN n::DOUBLE WHEN 6 THEN 0.0 WHEN 7 THEN 4.0 END::DOUBLE AS rank,
    CASE kind WHEN 0 THEN 'Mamografia digital bilateral. Conclusao: BI-RADS: ' || n || '.' WHEN 2 THEN 'Laudo conforme BI-RADS® 5ª edição.'
    WHEN 3 THEN 'Categoria: Mama direita BI RADS 2. Mama esquerda BI-RADS 4' || substr('ABC', CAST(doc_id % 5 % 3 + 1 AS INTEGER), 1)
    WHEN 4 THEN 'I.D.: b1-rahdz ' || n WHEN 6 THEN 'Mamografia: BI-RADS 0 exame 02 comparar.' WHEN 7 THEN 'Mama esquerda com nodulo. BIRADS IV' END AS clause"""))
def severity_extract_flex_max(spark, d):
    found = S.extract_flex(F.col("text"))
    return _with_text(spark, d).select(
        "report_id", found["value"].alias("value"), F.round(found["rank"], 6).alias("rank"), found["clause"].alias("clause")
    )


@query("severity_side", _expected("CASE kind WHEN 3 THEN 'left' WHEN 7 THEN 'left' END"))
def severity_side(spark, d):
    return _with_text(spark, d).select("report_id", S.extract_flex(F.col("text"))["side"].alias("value"))


@query("severity_v1_else_v2", _expected("CASE WHEN kind IN (0, 1, 2, 4) THEN n WHEN kind = 3 THEN '2' WHEN kind = 6 THEN '0' WHEN kind = 7 THEN '4' END"))
def severity_v1_else_v2(spark, d):
    return _with_text(spark, d).select("report_id", S.extract_value(F.col("text"))["value"].alias("value"))


@query("severity_zero_refine", _expected("CASE WHEN kind IN (0, 1, 2, 4) THEN n WHEN kind = 3 THEN '2' WHEN kind = 6 THEN '02' WHEN kind = 7 THEN '4' END"))
def severity_zero_refine(spark, d):
    found = _with_text(spark, d).withColumn("f", S.extract_value(F.col("text")))
    return found.select("report_id", S.refine_zero(F.col("f.value"), F.col("f.clause")).alias("value"))


@query("severity_normalize", """SELECT p_partkey, CASE p_size % 13 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4A' WHEN 5 THEN '4C'
  WHEN 6 THEN '5' WHEN 7 THEN '4' WHEN 8 THEN '6B' WHEN 9 THEN 'XX' WHEN 10 THEN '1' WHEN 11 THEN '9' ELSE '' END AS value,
  CASE p_size % 13 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 4 WHEN 10 THEN 1 END AS code FROM part""")
def severity_normalize(spark, d):
    raw = F.element_at(
        F.array(*[F.lit(v) for v in ("0", "I", "II", "iii", "IVa", "4c", "V", "IV", "VIb", "XX", " 1 ", "9", "")]),
        F.col("p_size") % 13 + 1,
    )
    value = S.normalize_value(raw)
    return table(spark, d, "part").select("p_partkey", value.alias("value"), S.normalize_code(value).alias("code"))


@query("severity_manual_override", """SELECT o_orderkey AS exam_id, CASE WHEN coalesce(quality, code) >= 0 THEN coalesce(quality, code) END AS code FROM
  (SELECT o_orderkey, 6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code FROM orders) LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 ELSE quality END AS quality FROM labels) ON doc_id = o_orderkey""")
def severity_manual_override(spark, d):
    # Manual corrections win over extracted codes; -1 marks an unusable report.
    fixes = table(spark, d, "labels").select(
        F.col("doc_id").alias("exam_id"), F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("fixed")
    )
    codes = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("code"))
    best = F.coalesce(F.col("fixed"), F.col("code")).cast("int")
    return codes.join(fixes, "exam_id", "left").select("exam_id", F.when(best >= 0, best).alias("code"))


@query("line_containing", with_sql(REPORTS) + f"SELECT report_id, trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'BI-?RADS'))[1], {WS}) AS line FROM reports WHERE text IS NOT NULL")
def line_containing(spark, d):
    return _with_text(spark, d).select("report_id", X.line_containing(F.col("text"), "BI-?RADS").alias("line"))


def _coded(spark, d):
    return coded_reports(_with_text(spark, d), "text", "visit_id")


# ------------------------------------------------------------------ topics and terms
def _sum_counts(patterns, weight=1, text="p"):
    return "(" + " + ".join("len(regexp_extract_all({}, '(?i){}'))".format(text, p.replace("'", "''")) for p in patterns) + f") * {weight}"


TOPIC_SQL = f"""
plain AS (SELECT *, strip_accents(lower(text)) AS p FROM reports WHERE text IS NOT NULL),
parts AS (SELECT *, {_sum_counts(T.ANCHORS, 3)} AS a, {_sum_counts(T.MILD_POSITIVE)} AS m, {_sum_counts(T.STRONG_NEGATIVE, -3)} + {_sum_counts(T.MILD_NEGATIVE, -1)} AS g FROM plain),
topic AS (SELECT report_id, CASE WHEN trim(text, {WS}) = '' THEN false ELSE (a > 0 AND a + m + g >= 1) OR (a > 0 AND g >= -2) OR (a = 0 AND a + m + g >= 3) END AS on_topic,
  CAST(CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE a + m + g END AS INTEGER) AS score FROM parts)"""


@query("topic_score_classify", with_sql(REPORTS, TOPIC_SQL) + "SELECT report_id, on_topic, score FROM topic")
def topic_score_classify(spark, d):
    scored = _with_text(spark, d).withColumn("t", T.topic_score(F.col("text")))
    return scored.select("report_id", "t.on_topic", "t.score")


def _first_position(patterns):
    spot = lambda p: f"CASE WHEN regexp_matches(p, '(?i){p}') THEN length(regexp_extract(p, '(?is)^(.*?)(?:{p})', 1)) + 1 END"
    return "coalesce(" + ", ".join(spot(p) for p in patterns) + ")"


@query("topic_evidence", with_sql(REPORTS, TOPIC_SQL) + f""", pos AS (SELECT report_id, text, CASE WHEN on_topic THEN {_first_position([*T.ANCHORS, *T.MILD_POSITIVE])}
  ELSE {_first_position([*T.STRONG_NEGATIVE, *T.MILD_NEGATIVE])} END AS i FROM plain JOIN topic USING (report_id))
  SELECT report_id, CASE WHEN i IS NOT NULL THEN trim(regexp_extract(text[1:i - 1], '[^\\n]*$') || split_part(text[i:], chr(10), 1), {WS}) END AS evidence FROM pos""")
def topic_evidence(spark, d):
    scored = _with_text(spark, d).withColumn("on_topic", T.topic_score(F.col("text"))["on_topic"])
    return scored.select("report_id", T.topic_evidence(F.col("text"), F.col("on_topic")).alias("evidence"))


KEYWORD_SQL = "regexp_matches(text, '(?i)\\b(mama(s)?|mam[áa]ria(s)?|mam[áa]rio(s)?)\\b')"


@query("keyword_flag", with_sql(REPORTS) + f"SELECT report_id, coalesce({KEYWORD_SQL}, false) AS flag FROM reports")
def keyword_flag(spark, d):
    return reports(spark, d).select("report_id", T.keyword_flag(F.col("text")).alias("flag"))


def _two_class(spark, d):
    folded = _with_text(spark, d).select("report_id", T.folded(F.col("text")).alias("folded"))
    return folded.select(
        "report_id", T.procedure_points(F.col("folded")).alias("procedure_points"),
        T.screening_points(F.col("folded")).alias("screening_points"),
    )


@query("two_class_keyword_score")
def two_class_keyword_score(spark, d):
    return _two_class(spark, d).withColumn("kind", T.two_class_label(F.col("procedure_points"), F.col("screening_points")))


@query("score_difference")
def score_difference(spark, d):
    return _two_class(spark, d).select(
        "report_id", "procedure_points", "screening_points",
        (F.col("procedure_points") - F.col("screening_points")).alias("point_difference"),
    )


SURGICAL_SQL = "(?i)(" + "|".join(T.SURGICAL_TERMS) + ")"


@query("surgical_terms", with_sql(REPORTS) + f"""SELECT report_id, coalesce(len(t) > 0, false) AS has_term, coalesce(array_to_string(t, '|'), '') AS terms FROM
  (SELECT report_id, regexp_extract_all(text, '{SURGICAL_SQL}') AS t FROM reports)""")
def surgical_terms(spark, d):
    terms = T.surgical_terms(F.col("text"))
    return reports(spark, d).select("report_id", (F.size(terms) > 0).alias("has_term"), F.array_join(terms, "|").alias("terms"))


SIGNATURE_SQL = r"""'(?im)^[^\n]*\n\s*CRM(?:\s*[/\-]?\s*(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO))?\s*\n\s*(?:\d+|(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)(?:\s*[/\-]?\s*\d+)?)\s*\n?'"""


@query("strip_signature_blocks", with_sql(REPORTS) + f"SELECT report_id, md5(regexp_replace(text, {SIGNATURE_SQL}, '', 'g')) AS clean FROM reports WHERE text IS NOT NULL")
def strip_signature_blocks(spark, d):
    return _with_text(spark, d).select("report_id", F.md5(X.strip_signature_blocks(F.col("text"))).alias("clean"))


PREFIXED_SQL = r"'(?im)^[ \t]*cassete\b.*\n?'"


@query("strip_prefixed_lines", with_sql(REPORTS) + f"SELECT report_id, md5(regexp_replace(text, {PREFIXED_SQL}, '', 'g')) AS clean FROM reports WHERE text IS NOT NULL")
def strip_prefixed_lines(spark, d):
    return _with_text(spark, d).select("report_id", F.md5(X.strip_prefixed_lines(F.col("text"))).alias("clean"))


@query("outcome_label", """SELECT doc_id, CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END AS code FROM
  (SELECT d.doc_id, toxic, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def outcome_label(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    content = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "benigno (antes maligno)").when(F.col("toxic") == 1, "maligno")
        .when(F.col("toxic") == 0, "indeterminado")
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", T.outcome_code(content).alias("code"))


def words_or(words):
    return "\\b(" + "|".join("[\\s-]+".join(w.split()) for w in words) + ")\\b"


@query("report_outcome_rules", with_sql(REPORTS) + f"""SELECT report_id, CASE WHEN regexp_matches(p, '{words_or(T.MALIGNANT_WORDS)}') THEN 'maligno'
  WHEN regexp_matches(p, '{words_or(T.BENIGN_WORDS)}') THEN 'benigno' ELSE 'indeterminado' END AS content FROM
  (SELECT report_id, regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g') AS p FROM reports WHERE text IS NOT NULL
  AND report_id NOT IN (SELECT doc_id FROM labels))""")
def report_outcome_rules(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("report_id"))
    return report_outcomes(_with_text(spark, d), "report_id", "text", done)


# ------------------------------------------------------------------ questionnaire fields
@query("children_count_from_text", with_sql(ANSWERS) + """SELECT answer_id, CASE WHEN complaint LIKE 'Filhos-%' THEN CAST(substr(complaint, 8) AS INTEGER) WHEN complaint = 'filhos NAO' THEN 0 END AS stated,
  coalesce(children, CASE WHEN complaint LIKE 'Filhos-%' THEN CAST(substr(complaint, 8) AS INTEGER) WHEN complaint = 'filhos NAO' THEN 0 END) AS children FROM answers""")
def children_count_from_text(spark, d):
    stated = X.children_count_from_text(F.col("complaint"))
    return answers(spark, d).select("answer_id", stated.alias("stated"), F.coalesce("children", stated).alias("children"))


@query("numbers_in_text", with_sql(ANSWERS) + "SELECT answer_id, array_to_string(regexp_extract_all(age_text, '\\d+'), ',') AS numbers FROM answers")
def numbers_in_text(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(X.integers_in(F.col("age_text")).cast("array<string>"), ",").alias("numbers"))


@query("flag_map", with_sql(ANSWERS) + "SELECT answer_id, CASE coalesce(flag, 'N') WHEN 'S' THEN 1 WHEN 'N' THEN 0 END AS flag FROM answers")
def flag_map(spark, d):
    return answers(spark, d).select("answer_id", X.flag_map(F.col("flag")).alias("flag"))


@query("zip_prefix_category", with_sql(PERSONS) + "SELECT person_id, CASE WHEN length(zip) = 8 THEN substr(trim(zip), 1, 3) ELSE 'no_zip_code' END AS category FROM persons")
def zip_prefix_category(spark, d):
    return persons(spark, d).select("person_id", X.zip_prefix(F.col("zip")).alias("category"))


@query("sex_code", with_sql(PERSONS) + "SELECT person_id, CASE upper(coalesce(sex, 'F')) WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS code FROM persons")
def sex_code(spark, d):
    return persons(spark, d).select("person_id", X.sex_code(F.col("sex")).alias("code"))


@query("word_chunks", f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, md5(array_to_string(w[i * 40 + 1 : least(i * 40 + 50, len(w))], ' ')) AS chunk FROM
  (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 50) / 40.0), 0) AS BIGINT))) AS i FROM
  (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""")
def word_chunks(spark, d):
    chunks = X.word_chunks(F.col("text"), 50, 10)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk_no", "c")).select(
        "doc_id", "chunk_no", F.md5("c").alias("chunk")
    )

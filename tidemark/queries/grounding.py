"""How the concepts of the library map to the given tables, in Spark and in SQL.

entity = customer; exam = order (severity code from the order priority); confirmation =
line item, dated by shipping; questionnaire = event, shifted 27 years back so that its
dates fall among the exams; report = document followed by a clinical line that depends
on its id; user = order of a person; risk score = a formula over document columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COHORT_END = "2001-12-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("exam_id"),
        F.col("o_orderdate").cast("date").alias("ts"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("code"),
    )


EXAMS = """
exams AS (SELECT o_custkey AS entity_id, o_orderkey AS exam_id, CAST(o_orderdate AS DATE) AS ts,
  6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code FROM orders)"""


def confirmations(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity"
    )
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("entity_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("conf_key"),
        F.col("l_shipdate").cast("date").alias("ts"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).cast("int").alias("result"),
    )


CONF = """
conf AS (SELECT o_custkey AS entity_id, l_orderkey || '-' || l_linenumber AS conf_key,
  CAST(l_shipdate AS DATE) AS ts,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 1 ELSE 0 END AS result
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"),
        F.col("event_id").alias("answer_id"),
        (F.col("ts") - F.expr("INTERVAL '27' YEAR")).alias("ts"),
        F.when(kind == "signup", "S").when(kind == "view", F.lit(None)).when(kind == "error", "X")
        .otherwise("N").alias("flag"),
        F.when(kind != "click", k % 9).alias("children"),
        F.concat(F.lit("idade "), (k % 30 + 8).cast("string"), F.lit(" anos, ou "), (k % 7 + 10).cast("string")).alias("age_text"),
        F.when(k % 5 == 0, F.concat(F.lit("Filhos-"), (k % 4).cast("string")))
        .when(k % 5 == 1, F.lit("filhos NAO")).when(k % 5 == 2, F.lit("nodulo palpavel")).alias("complaint"),
        F.col("value"),
    )


ANSWERS = """
answers AS (SELECT user_id AS entity_id, event_id AS answer_id, ts - INTERVAL 27 YEAR AS ts,
  CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN NULL WHEN 'error' THEN 'X' ELSE 'N' END AS flag,
  CASE WHEN event_type <> 'click' THEN k % 9 END AS children,
  'idade ' || (k % 30 + 8) || ' anos, ou ' || (k % 7 + 10) AS age_text,
  CASE k % 5 WHEN 0 THEN 'Filhos-' || (k % 4) WHEN 1 THEN 'filhos NAO' WHEN 2 THEN 'nodulo palpavel' END AS complaint,
  value FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    n = (F.floor(F.col("doc_id") / 12) % 7).cast("string")
    kind = F.col("doc_id") % 12
    line = (
        F.when(kind == 0, F.concat(F.lit("Mamografia digital bilateral. Conclusao: BI-RADS: "), n, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("BI-RADS\nMamas densas.\nCategoria: "), n))
        .when(kind == 2, F.concat(F.lit("Laudo conforme BI-RADS® 5ª edição.\nClassificação "), n))
        .when(kind == 3, F.concat(F.lit("Categoria: Mama direita BI RADS 2. Mama esquerda BI-RADS 4"), F.substring(F.lit("ABC"), F.col("doc_id").cast("int") % 5 % 3 + 1, F.lit(1))))
        .when(kind == 4, F.concat(F.lit("I.D.: b1-rahdz "), n))
        .when(kind == 5, F.lit("Ultrassonografia de abdome total. Figado e pancreas normais. Doppler venoso."))
        .when(kind == 6, F.lit("Mamografia: BI-RADS 0 exame 02 comparar."))
        .when(kind == 7, F.lit("Mama esquerda com nodulo. BIRADS IV"))
        .when(kind == 8, F.concat(F.lit("Biopsia core de mama direita: carcinoma ductal invasivo. Material recebido em frasco. Nottingham grau "), n))
        .when(kind == 9, F.lit("Mastectomia radical a direita. Prótese mamária.\nDr. Fulano de Tal\nCRM-CE\n38340\nCassete A1\nFim"))
        .when(kind == 10, F.lit("Biopsia sugerida; agendar puncao por agulha fina. Sem malignidade, adenoma."))
        .otherwise(F.lit(""))
    )
    body = F.when((kind == 11) & (n == "0"), F.lit(None)).when((kind == 11) & (n == "1"), F.lit("  \n ")).otherwise(
        F.concat(F.col("text"), F.lit("\n"), line)
    )
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("report_id"),
        F.floor(F.col("doc_id") / 3).cast("bigint").alias("visit_id"),
        (F.col("doc_id") % 150).alias("entity_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2400).cast("int")).alias("ts"),
        F.col("source"),
        body.alias("text"),
    )


REPORTS = """
reports AS (SELECT doc_id AS report_id, doc_id // 3 AS visit_id, doc_id % 150 AS entity_id,
  DATE '1995-01-01' + CAST(doc_id % 2400 AS INTEGER) AS ts, source,
  CASE WHEN doc_id % 12 = 11 AND n = '0' THEN NULL WHEN doc_id % 12 = 11 AND n = '1' THEN '  ' || chr(10) || ' '
  ELSE text || chr(10) || CASE doc_id % 12
    WHEN 0 THEN 'Mamografia digital bilateral. Conclusao: BI-RADS: ' || n || '.'
    WHEN 1 THEN 'BI-RADS' || chr(10) || 'Mamas densas.' || chr(10) || 'Categoria: ' || n
    WHEN 2 THEN 'Laudo conforme BI-RADS® 5ª edição.' || chr(10) || 'Classificação ' || n
    WHEN 3 THEN 'Categoria: Mama direita BI RADS 2. Mama esquerda BI-RADS 4' || substr('ABC', CAST(doc_id % 5 % 3 + 1 AS INTEGER), 1)
    WHEN 4 THEN 'I.D.: b1-rahdz ' || n
    WHEN 5 THEN 'Ultrassonografia de abdome total. Figado e pancreas normais. Doppler venoso.'
    WHEN 6 THEN 'Mamografia: BI-RADS 0 exame 02 comparar.'
    WHEN 7 THEN 'Mama esquerda com nodulo. BIRADS IV'
    WHEN 8 THEN 'Biopsia core de mama direita: carcinoma ductal invasivo. Material recebido em frasco. Nottingham grau ' || n
    WHEN 9 THEN 'Mastectomia radical a direita. Prótese mamária.' || chr(10) || 'Dr. Fulano de Tal' || chr(10) || 'CRM-CE' || chr(10) || '38340' || chr(10) || 'Cassete A1' || chr(10) || 'Fim'
    WHEN 10 THEN 'Biopsia sugerida; agendar puncao por agulha fina. Sem malignidade, adenoma.'
    ELSE '' END END AS text
  FROM (SELECT *, CAST((doc_id // 12) % 7 AS VARCHAR) AS n FROM documents))"""

DIGITS, LETTERS = "0123456789", "aeiounlrst"


def persons(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        key.alias("person_id"),
        F.concat(
            F.lit("Maria "), F.initcap(F.translate(F.lpad(key.cast("string"), 6, "0"), DIGITS, LETTERS)),
            F.lit(" da "), F.initcap(F.lower("c_mktsegment")),
        ).alias("person_name"),
        F.date_add(F.lit("1925-01-01").cast("date"), (key * 37 % 18000).cast("int")).alias("person_birth"),
        F.when(nation % 4 == 0, "f").when(nation % 4 == 1, "M").when(nation % 4 == 2, "F").alias("sex"),
        F.when(nation % 5 != 0, F.lpad((key * 7919 % 100000000).cast("string"), 8, "0"))
        .otherwise(F.lpad(nation.cast("string"), 7, "0")).alias("zip"),
        F.col("c_acctbal").alias("payment"),
    )


PERSONS = f"""
persons AS (SELECT c_custkey AS person_id,
  'Maria ' || upper(substr(nm, 1, 1)) || substr(nm, 2) || ' da ' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS person_name,
  DATE '1925-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS person_birth,
  CASE c_nationkey % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'M' WHEN 2 THEN 'F' END AS sex,
  CASE WHEN c_nationkey % 5 <> 0 THEN lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0')
    ELSE lpad(CAST(c_nationkey AS VARCHAR), 7, '0') END AS zip,
  c_acctbal AS payment
  FROM (SELECT *, translate(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '{DIGITS}', '{LETTERS}') AS nm FROM customer))"""


def patients(spark: SparkSession, d: str) -> DataFrame:
    """One or two patient records per person; names and dates deviate by the key."""
    key = F.col("person_id")
    first, mid, last = (F.split("person_name", " ")[i] for i in (0, 1, 3))
    base = persons(spark, d)
    return base.withColumn("copy", F.explode(F.when(key % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        (key * 10 + F.col("copy")).alias("patient_id"),
        key.alias("person_id"),
        F.when(F.col("copy") == 1, F.concat_ws(" ", F.lit("Joana"), F.reverse(mid)))
        .when(key % 5 == 0, F.concat_ws(" ", last, first, mid))
        .when(key % 5 == 1, F.concat_ws(" ", first, F.concat(mid, F.lit("s")), last))
        .when(key % 5 == 2, F.lit(None).cast("string"))
        .otherwise(F.col("person_name")).alias("patient_name"),
        F.when(F.col("copy") == 1, F.date_add("person_birth", -9000))
        .when(key % 7 == 0, F.date_add("person_birth", 1))
        .when(key % 7 == 1, F.add_months("person_birth", 12))
        .when(key % 7 == 2, F.date_add("person_birth", 40))
        .when(key % 7 == 3, F.lit(None).cast("date"))
        .otherwise(F.col("person_birth")).alias("patient_birth"),
    )


PATIENTS = """
patients AS (SELECT person_id * 10 + copy AS patient_id, person_id,
  CASE WHEN copy = 1 THEN 'Joana ' || reverse(split_part(person_name, ' ', 2))
    WHEN person_id % 5 = 0 THEN split_part(person_name, ' ', 4) || ' ' || split_part(person_name, ' ', 1) || ' ' || split_part(person_name, ' ', 2)
    WHEN person_id % 5 = 1 THEN split_part(person_name, ' ', 1) || ' ' || split_part(person_name, ' ', 2) || 's ' || split_part(person_name, ' ', 4)
    WHEN person_id % 5 = 2 THEN NULL ELSE person_name END AS patient_name,
  CASE WHEN copy = 1 THEN person_birth - 9000 WHEN person_id % 7 = 0 THEN person_birth + 1
    WHEN person_id % 7 = 1 THEN CAST(person_birth + INTERVAL 12 MONTH AS DATE)
    WHEN person_id % 7 = 2 THEN person_birth + 40 WHEN person_id % 7 = 3 THEN NULL ELSE person_birth END AS patient_birth
  FROM (SELECT *, unnest(CASE WHEN person_id % 6 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM persons))"""


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("user_code"),
        F.col("o_orderdate").cast("date").alias("reference_date"),
        F.col("o_totalprice").alias("payment"),
    )


USERS = """
users AS (SELECT o_custkey AS person_id, 'U' || o_orderkey AS user_code, CAST(o_orderdate AS DATE) AS reference_date,
  o_totalprice AS payment FROM orders)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled risk scores: one per labelled document, with fold and split."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    joined = labels.join(docs, "doc_id")
    return joined.select(
        F.col("doc_id").alias("exam_id"),
        (F.col("doc_id") % 3).cast("int").alias("fold"),
        F.when(F.col("doc_id") % 7 < 4, "validation").otherwise("test").alias("split"),
        (1 - F.col("quality")).alias("label"),
        (((F.col("n_chars") * 31 + F.col("quality") * 17) % 90 + (1 - F.col("quality")) * 12 + 1) / F.lit(104.0)).alias("score"),
    )


SCORES = """
scores AS (SELECT doc_id AS exam_id, CAST(doc_id % 3 AS INTEGER) AS fold,
  CASE WHEN doc_id % 7 < 4 THEN 'validation' ELSE 'test' END AS split,
  1 - quality AS label, ((n_chars * 31 + quality * 17) % 90 + (1 - quality) * 12 + 1) / 104.0::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id))"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def day(c: str) -> Column:
    """A date column as text, so that both engines print it the same way."""
    return F.date_format(c, "yyyy-MM-dd")

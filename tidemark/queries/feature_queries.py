"""Structured features: arrays, encodings, imputation, standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import integers_in, sex_code, zip_prefix
from ..models.regression import apply_linear, fit_linear
from ..operators import features as X
from ..operators.relational import inside_open
from .grounding import ANSWERS, PERSONS, answers, persons, table, with_sql
from .registry import query


def _people(spark, d):
    """Person rows shaped like the structured features of an index exam."""
    key = F.col("person_id")
    return persons(spark, d).select(
        key.alias("exam_id"),
        F.when(key % 4 != 0, (9 + key % 8).cast("double")).alias("menarche_age"),
        F.when(key % 3 == 0, (36 + key % 25).cast("double")).alias("menopause_age"),
        F.when(key % 10 != 0, F.col("payment") + 1000).alias("payment_min"),
        (F.col("payment") * 2 + 3000).alias("payment_max"),
        (18 + key % 170 / 10).alias("bmi"),
        (30 + key % 40).cast("double").alias("age_at_first"), (32 + key % 45).cast("double").alias("age_at_exam"),
        F.when(key % 7 < 2, (key % 2).cast("int")).alias("history"), "zip", "sex",
    )


PEOPLE = """
people AS (SELECT person_id AS exam_id, CASE WHEN person_id % 4 <> 0 THEN (9 + person_id % 8)::DOUBLE END AS menarche_age,
  CASE WHEN person_id % 3 = 0 THEN (36 + person_id % 25)::DOUBLE END AS menopause_age,
  CASE WHEN person_id % 10 <> 0 THEN payment + 1000 END AS payment_min, payment * 2 + 3000 AS payment_max,
  18 + (person_id % 170) / 10.0::DOUBLE AS bmi, (30 + person_id % 40)::DOUBLE AS age_at_first, (32 + person_id % 45)::DOUBLE AS age_at_exam,
  CASE WHEN person_id % 7 < 2 THEN CAST(person_id % 2 AS INTEGER) END AS history, zip, sex FROM persons)"""

U = "((CAST('0x' || substr(md5('{0}-u:' || {1}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
V = "((CAST('0x' || substr(md5('{0}-v:' || {1}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


def _normal(seed: str, col: str) -> str:
    return f"(sqrt(-2.0 * ln({U.format(seed, col)})) * cos(6.283185307179586 * {V.format(seed, col)}))"


STD = ("menarche_age", "menopause_age", "payment_min", "payment_max", "bmi", "age_at_first", "age_at_exam")


@query("standardise_stats", with_sql(PERSONS, PEOPLE) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM people" for c in STD))
def standardise_stats(spark, d):
    return X.summary(_people(spark, d), STD).select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "min", "max")])


STATS = "stats AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STD) + ", median(menopause_age) AS med FROM people)"


@query("standardise_features", with_sql(PERSONS, PEOPLE, STATS) + f""", g AS (SELECT *, coalesce(menarche_age, floor(m_menarche_age + s_menarche_age * {_normal('impute-a', 'exam_id')})) AS menarche,
  floor(med + s_menopause_age * {_normal('impute-b', 'exam_id')}) AS guess FROM people, stats),
  b AS (SELECT *, coalesce(menopause_age, CASE WHEN guess <= age_at_exam THEN guess END) AS k FROM g),
  c AS (SELECT *, CASE WHEN k > -1 AND k <= 39 THEN 0 WHEN k > 39 AND k <= 44 THEN 1 WHEN k > 44 AND k <= 49 THEN 2 WHEN k > 49 AND k <= 54 THEN 3 WHEN k > 54 AND k <= 100 THEN 4 ELSE -1 END AS bin FROM b)
  SELECT exam_id, round((menarche - m_menarche_age) / s_menarche_age, 6) AS menarche_age,
  round((bin - min(bin) OVER ()) / (max(bin) OVER () - min(bin) OVER ())::DOUBLE, 6) AS menopause_age,
  round(ln(coalesce(payment_min, m_payment_min) + 1), 6) AS payment_min, round(ln(payment_max + 1), 6) AS payment_max,
  round((bmi - m_bmi) / s_bmi, 6) AS bmi, round((age_at_first - m_age_at_first) / s_age_at_first, 6) AS age_at_first,
  round((age_at_exam - m_age_at_exam) / s_age_at_exam, 6) AS age_at_exam FROM c""")
def standardise_features(spark, d):
    out = X.standardise_features(_people(spark, d), "exam_id")
    return out.select("exam_id", *[F.round(c, 6).alias(c) for c in STD])


@query("zscore", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z FROM lineitem""")
def zscore(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    stats = X.moments(items, ["l_quantity"])
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.zscore(F.col("l_quantity"), stats, "l_quantity"), 6).alias("z"))


@query("mean_impute_log1p", with_sql(PERSONS, PEOPLE) + "SELECT exam_id, round(ln(coalesce(payment_min, avg(payment_min) OVER ()) + 1), 6) AS payment_min FROM people")
def mean_impute_log1p(spark, d):
    df = _people(spark, d)
    return df.select("exam_id", F.round(X.mean_impute_log1p(F.col("payment_min"), X.moments(df, ["payment_min"]), "payment_min"), 6).alias("payment_min"))


@query("gaussian_impute_floor", with_sql(PERSONS, PEOPLE) + f"""SELECT exam_id, coalesce(menarche_age, floor(m + s * {_normal('g', 'exam_id')})) AS menarche_age
  FROM people, (SELECT avg(menarche_age) AS m, stddev_samp(menarche_age) AS s FROM people)""")
def gaussian_impute_floor(spark, d):
    df = _people(spark, d)
    stats = X.moments(df, ["menarche_age"])
    filled = X.gaussian_impute_floor(F.col("menarche_age"), stats["mean_menarche_age"], stats["std_menarche_age"], "g", F.col("exam_id"))
    return df.select("exam_id", filled.alias("menarche_age"))


@query("bin_ordered_minmax", with_sql(PERSONS, PEOPLE) + """, c AS (SELECT exam_id, CASE WHEN k > -1 AND k <= 39 THEN 0 WHEN k > 39 AND k <= 44 THEN 1 WHEN k > 44 AND k <= 49 THEN 2
  WHEN k > 49 AND k <= 54 THEN 3 WHEN k > 54 AND k <= 100 THEN 4 ELSE -1 END AS bin FROM (SELECT exam_id, menopause_age AS k FROM people))
  SELECT exam_id, round((bin - min(bin) OVER ()) / (max(bin) OVER () - min(bin) OVER ())::DOUBLE, 6) AS bin FROM c""")
def bin_ordered_minmax(spark, d):
    binned = _people(spark, d).select("exam_id", X.ordered_bin(F.col("menopause_age")).alias("bin"))
    return X.min_max(binned, "bin").select("exam_id", F.round("bin", 6).alias("bin"))


@query("list_fill_zero", """SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE '0' END, ',' ORDER BY turn) AS filled FROM conversations GROUP BY 1""")
def list_fill_zero(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("v")))).alias("a")
    )
    filled = F.transform(F.transform("a", lambda e: e["v"]), lambda v: F.coalesce(v, F.lit(0)).cast("string"))
    return lists.select("conv_id", F.array_join(filled, ",").alias("filled"))


@query("flatten_lists", with_sql(ANSWERS) + """SELECT answer_id, array_to_string(list_concat(CASE WHEN flag IS NULL THEN [] ELSE regexp_extract_all(age_text, '\\d+') END,
  CASE WHEN children IS NULL THEN [] ELSE [CAST(children AS VARCHAR)] END), ',') AS flat FROM answers""")
def flatten_lists(spark, d):
    empty = F.array().cast("array<int>")
    ages = F.when(F.col("flag").isNotNull(), integers_in(F.col("age_text")))
    kids = F.when(F.col("children").isNotNull(), F.array("children"))
    flat = F.flatten(F.array(F.coalesce(ages, empty), F.coalesce(kids, empty)))
    return answers(spark, d).select("answer_id", F.array_join(flat.cast("array<string>"), ",").alias("flat"))


@query("menarche_min_menopause_mean", with_sql(ANSWERS) + """SELECT entity_id, CASE WHEN mn > 8 AND mn < 40 THEN mn END AS menarche_age, CASE WHEN me > 5 AND me < 65 THEN me END AS menopause_age FROM
  (SELECT entity_id, CAST(min(x) AS INTEGER) AS mn, CAST(floor(avg(x)) AS INTEGER) AS me FROM (SELECT entity_id, unnest(CAST(regexp_extract_all(age_text, '\\d+') AS INTEGER[])) AS x FROM answers) GROUP BY 1)""")
def menarche_min_menopause_mean(spark, d):
    rows = answers(spark, d).withColumn("x", integers_in(F.col("age_text")))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v)
    agg = rows.groupBy("entity_id").agg(
        F.min(F.array_min("x")).alias("mn"), F.floor(F.sum(total) / F.sum(F.size("x"))).cast("int").alias("me")
    )
    return agg.select("entity_id", inside_open(F.col("mn"), 8, 40).alias("menarche_age"), inside_open(F.col("me"), 5, 65).alias("menopause_age"))


@query("one_hot", with_sql(PERSONS, PEOPLE) + """SELECT exam_id, CASE WHEN coalesce(history, -1) = -1 THEN 1 ELSE 0 END AS history_m1, CASE WHEN history = 0 THEN 1 ELSE 0 END AS history_0,
  CASE WHEN history = 1 THEN 1 ELSE 0 END AS history_1 FROM people""")
def one_hot(spark, d):
    return X.one_hot(_people(spark, d).select("exam_id", "history"), "history", [-1, 0, 1]).drop("history")


@query("missing_indicator", with_sql(PERSONS, PEOPLE) + "SELECT exam_id, CASE WHEN history IS NULL THEN 1 ELSE 0 END AS is_missing_history, coalesce(history, -1) AS history FROM people")
def missing_indicator(spark, d):
    return X.missing_indicator(_people(spark, d).select("exam_id", "history"), "history")


ZIPS = "zips AS (SELECT *, CASE WHEN length(zip) = 8 THEN substr(trim(zip), 1, 3) ELSE 'no_zip_code' END AS category FROM people)"


@query("category_index", with_sql(PERSONS, PEOPLE, ZIPS) + """SELECT exam_id, coalesce(i, -1) AS category_index FROM zips LEFT JOIN
  (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT category FROM zips WHERE age_at_exam < 60)) USING (category)""")
def category_index(spark, d):
    df = _people(spark, d).withColumn("category", zip_prefix(F.col("zip")))
    codes = X.category_table(df.where(F.col("age_at_exam") < 60), "category")
    return X.category_index(df.select("exam_id", "category"), "category", codes).select("exam_id", "category_index")


@query("category_embedding", with_sql(PERSONS, PEOPLE, ZIPS) + "SELECT category, " + ", ".join(f"round({_normal(f'category-{i}', 'category')}, 6) AS e{i}" for i in range(8)) + " FROM (SELECT DISTINCT category FROM zips)")
def category_embedding(spark, d):
    cats = _people(spark, d).select(zip_prefix(F.col("zip")).alias("category")).distinct()
    vec = cats.withColumn("v", X.category_embedding(F.col("category")))
    return vec.select("category", *[F.round(F.col("v")[i], 6).alias(f"e{i}") for i in range(8)])


@query("vector_concat", """SELECT vec_id, len(embedding) + 2 AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + c_acctbal + c_nationkey, 4) AS total
  FROM embeddings JOIN customer ON c_custkey = vec_id""")
def vector_concat(spark, d):
    extra = table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("extra"))
    both = F.concat(F.col("embedding").cast("array<double>"), F.col("extra"))
    return table(spark, d, "embeddings").join(extra, "vec_id").select(
        "vec_id", F.size(both).cast("bigint").alias("dim"), F.round(F.aggregate(both, F.lit(0.0), lambda a, v: a + v), 4).alias("total")
    )


@query("apply_score_model", with_sql(PERSONS, PEOPLE) + """, x AS (SELECT exam_id, CASE upper(coalesce(sex, 'F')) WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS a, age_at_first AS b, bmi AS y FROM people),
  m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bby FROM x),
  c AS (SELECT *, (ay * vb - bby * ab) / (va * vb - ab * ab) AS ca, (bby * va - ay * ab) / (va * vb - ab * ab) AS cb FROM m)
  SELECT exam_id, round(my + ca * (a - ma) + cb * (b - mb), 6) AS bmi_predicted FROM x, c""")
def apply_score_model(spark, d):
    df = _people(spark, d).withColumn("sex_code", F.coalesce(sex_code(F.col("sex")), F.lit(0)).cast("double"))
    fitted = fit_linear(df, ["sex_code", "age_at_first"], "bmi")
    return apply_linear(df, fitted, ["sex_code", "age_at_first"], "bmi_predicted").select("exam_id", F.round("bmi_predicted", 6).alias("bmi_predicted"))

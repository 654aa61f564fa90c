"""Text vectors, history vectors, text and risk models, splits and samples."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions.text import content_id, flag_map, word_chunks
from ..models import perceptron, risk
from ..models.search import Parameter, propose, search
from ..operators import evaluation as E
from ..operators import splits as P
from ..operators import vectors as V
from ..operators.ordering import top_n
from ..plans import risk_features as RF
from ..session import stage_path
from ..sources.writers import write_stage
from .cohort_queries import BASE, EVENTS, INDEX, KEPT, PIT, _labelled
from .grounding import ANSWERS, CONF, EXAMS, REPORTS, SCORES, answers, confirmations, day, exams, reports, scores, table, with_sql
from .registry import ORACLES, query
from .relational_queries import TUNING, _tuning_log

# A short stop list; users pass their own (Spark ships lists per language).
STOP_WORDS = ["the", "of", "and", "in", "on", "is", "it", "to", "de", "la", "le", "les", "des", "el", "der", "die", "und"]
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

PROPOSAL_SQL = """, t AS (SELECT dataset_name, target_year, split_config_name, trial_number AS trial, result, [(k / 100.0)::DOUBLE, (depth - 1)::DOUBLE / 3, units::DOUBLE / 800] AS x
    FROM (SELECT *, units / 8 AS k FROM tun) WHERE trial_number IS NOT NULL),
  c AS (SELECT dataset_name, target_year, split_config_name, count(*) AS n, CAST(least(ceil(count(*) * 0.1::DOUBLE), 25) AS BIGINT) AS m FROM t GROUP BY 1, 2, 3),
  r AS (SELECT t.*, n, m, row_number() OVER (PARTITION BY dataset_name, target_year, split_config_name ORDER BY result DESC, trial) AS place FROM t JOIN c USING (dataset_name, target_year, split_config_name)),
  b AS (SELECT dataset_name, target_year, split_config_name, n, m, list(x ORDER BY place) AS best FROM r WHERE place <= m GROUP BY ALL),
  d AS (SELECT *, 42 || ':' || dataset_name || '/' || target_year || '/' || split_config_name || '/' || ':' || n || ':' || name || ':' || draw || ':' AS word,
      greatest(0.02, 0.2 / pow(greatest(m, 1), 0.2)) AS w, greatest(0.02, 0.2 / pow(greatest(n - m, 1), 0.2)) AS wo
    FROM b, (SELECT unnest(range(3)) AS p, unnest(['dropout', 'depth', 'layer_0_units']) AS name), (SELECT unnest(range(24)) AS draw)),
  e AS (SELECT *, (CAST('0x' || substr(md5(word || 'kernel'), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296 AS u, (CAST('0x' || substr(md5(word || 'place'), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296 AS v FROM d),
  f AS (SELECT *, CASE WHEN floor(u * (m + 1)) = m THEN v ELSE least(greatest(best[CAST(floor(u * (m + 1)) AS BIGINT) + 1][p + 1] + w * ln(v / (1 - v)), 0), 1) END AS pos FROM e),
  g AS (SELECT f.dataset_name, f.target_year, f.split_config_name, f.n, f.m, p, draw, pos,
      sum(CASE WHEN place <= r.m THEN exp(-abs(pos - x[p + 1]) / w) / (w * pow(1 + exp(-abs(pos - x[p + 1]) / w), 2)) ELSE 0 END) AS good,
      sum(CASE WHEN place > r.m THEN exp(-abs(pos - x[p + 1]) / wo) / (wo * pow(1 + exp(-abs(pos - x[p + 1]) / wo), 2)) ELSE 0 END) AS other
    FROM f JOIN r USING (dataset_name, target_year, split_config_name) GROUP BY ALL),
  h AS (SELECT dataset_name, target_year, split_config_name, n, p, arg_max(pos, (round(ln((good + 1) / (m + 1)) - ln((other + 1) / (n - m + 1)), 9), -draw)) AS pos FROM g GROUP BY ALL)
SELECT dataset_name, target_year, split_config_name, n AS n_trials, round(max(pos) FILTER (p = 0), 6) AS dropout, CAST(round(1 + 3 * max(pos) FILTER (p = 1)) AS INTEGER) AS depth,
  CAST(round(800 * max(pos) FILTER (p = 2)) AS INTEGER) AS layer_0_units FROM h GROUP BY ALL"""

TOKENS = f"""
tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOPS}))) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
voc AS (SELECT term, df, ln((n + 1) / (df + 1)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM cnt GROUP BY 1), (SELECT count(*) AS n FROM documents)
  WHERE df >= 5 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 2000),
raw AS (SELECT doc_id, term, (ln(tf) + 1) * idf AS w FROM cnt JOIN voc USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


#: Most frequent terms that the three capped TF-IDF queries keep, to show ``max_features``.
TOP_TERMS = 2000


def _whole(name):
    """The check SQL of a capped TF-IDF query without its cap."""
    return ORACLES[name].replace(f" ORDER BY total DESC, term LIMIT {TOP_TERMS}", "")


def _tfidf(spark, d, max_features=None):
    docs = table(spark, d, "documents").select("doc_id", "text")
    counts = V.term_counts(docs, "doc_id", "text", STOP_WORDS)
    n = docs.agg(F.count(F.lit(1))).scalar()
    return counts, V.fit_tfidf(counts, n, min_df=5, max_df=0.9, max_features=max_features)


@query("tfidf_fit_transform", with_sql(TOKENS) + "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_fit_transform(spark, d, max_features=TOP_TERMS):
    counts, vocabulary = _tfidf(spark, d, max_features)
    return V.apply_tfidf(counts, vocabulary, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_fit_transform_whole", _whole("tfidf_fit_transform"))
def tfidf_fit_transform_whole(spark, d):
    """Weights of all terms within the document-frequency limits."""
    return tfidf_fit_transform(spark, d, max_features=None)


@query("tfidf_apply", with_sql(TOKENS) + f""", nt AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOPS}))) AS term FROM conversations) GROUP BY 1, 2, 3),
  nr AS (SELECT conv_id, turn, term, (ln(tf) + 1) * idf AS w FROM nt JOIN voc USING (term))
  SELECT conv_id || '-' || turn AS turn_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM nr""")
def tfidf_apply(spark, d, max_features=TOP_TERMS):
    _, vocabulary = _tfidf(spark, d, max_features)
    fitted = write_stage(vocabulary, stage_path(spark, "vocabulary"))
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    counts = V.term_counts(turns, "turn_id", "text", STOP_WORDS)
    return V.apply_tfidf(counts, fitted, "turn_id").select("turn_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_apply_whole", _whole("tfidf_apply"))
def tfidf_apply_whole(spark, d):
    """Weights of new texts by the vocabulary without a cap."""
    return tfidf_apply(spark, d, max_features=None)


@query("svd_reduce")
def svd_reduce(spark, d):
    emb = table(spark, d, "embeddings")
    svd = risk.truncated_svd(emb, "embedding", 8)
    components = svd.V.toArray().T.tolist()
    reduced = risk.project(emb, "embedding", components)
    dims = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col("reduced")[i].alias("x")) for i in range(8)]))
    # Signs of singular vectors are arbitrary; the spread per dimension is not.
    return reduced.select(dims.alias("c")).groupBy("c.dim").agg(
        F.round(F.var_pop("c.x"), 6).alias("explained_variance"), F.round(F.sqrt(F.sum(F.col("c.x") * F.col("c.x"))), 5).alias("singular_value")
    )


CODES = """codes AS (SELECT exam_id, code, CASE WHEN code IN (4, 5, 6) THEN 'severe' WHEN code IN (1, 2, 3) THEN 'benign' WHEN code = 0 THEN 'inconclusive' END AS stratum
  FROM (SELECT exam_id, CASE WHEN exam_id % 11 = 0 THEN 0 ELSE code END AS code FROM exams WHERE ts >= DATE '1999-01-01'))"""


def _codes(spark, d):
    recent = exams(spark, d).where(F.col("ts") >= F.lit("1999-01-01").cast("date"))
    return recent.select("exam_id", F.when(F.col("exam_id") % 11 == 0, 0).otherwise(F.col("code")).alias("code"))


@query("fit_corpus_selection", with_sql(EXAMS, CODES) + """SELECT exam_id, code, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || exam_id)) AS r,
  (SELECT count(*) FROM codes WHERE stratum = 'severe') AS n FROM codes) WHERE r <= CASE stratum WHEN 'benign' THEN n * 1 ELSE n END""")
def fit_corpus_selection(spark, d):
    return P.fit_corpus(_codes(spark, d), "exam_id", "code", ratio=1)


@query("capped_sample_per_class", with_sql(EXAMS) + """SELECT exam_id, code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5('42:' || exam_id)) AS r FROM exams) WHERE r <= 500""")
def capped_sample_per_class(spark, d):
    return P.capped_per_class(exams(spark, d).select("exam_id", "code"), "exam_id", "code", 500)


# ------------------------------------------------------------------ text classifier
def _coded_texts(spark, d):
    """Reports with the code found by the rules; null where the rules find none."""
    base = reports(spark, d).where(F.col("text").isNotNull()).withColumn("f", S.extract_value(F.col("text")))
    code = S.normalize_code(S.refine_zero(F.col("f.value"), F.col("f.clause")))
    return write_stage(base.select("report_id", "text", code.cast("double").alias("code")), stage_path(spark, "coded"))


def _fitted(spark, coded, max_features=None):
    """Classifier on all reports with a code but those held out, a fifth of each class; ``max_features`` caps its vocabulary, None does not."""
    from ..operators.ordering import hash_rank

    ranked = hash_rank(coded.where(F.col("code").isNotNull()), "report_id", strata=["code"], name="_r", total="_n")
    split = ranked.withColumn("holdout", F.col("_r") <= F.ceil(F.col("_n") * 0.2)).drop("_r", "_n")
    split = write_stage(split, stage_path(spark, "text-split"))  # every fitted stage reads the texts
    train = risk.balance_weights(split.where(~F.col("holdout")), "code")
    return risk.fit_text_pipeline(risk.text_pipeline("text", "code", STOP_WORDS, max_features=max_features), train), split


@query("text_classifier_fit")
def text_classifier_fit(spark, d):
    coded = _coded_texts(spark, d)
    model, split = _fitted(spark, coded)
    scored = model.transform(split.where("holdout"))
    return E.classification_report(scored, "code", "prediction").select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("infer_unlabeled")
def infer_unlabeled(spark, d):
    coded = _coded_texts(spark, d)
    model, split = _fitted(spark, coded)
    path = stage_path(spark, "text-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    classes = range(7)
    held = loaded.transform(split.where("holdout")).withColumn("p", vector_to_array("probability"))
    long = held.select(F.col("code").cast("int").alias("y"), F.posexplode("p").alias("class", "p")).where(F.col("class") >= 4)
    cuts = E.class_thresholds(long, "y", "class", "p")
    t = {c: F.coalesce(cuts.where(F.col("class") == c).select("threshold").scalar(), F.lit(1.0)) for c in (4, 5, 6)}
    out = loaded.transform(coded.where(F.col("code").isNull())).withColumn("p", vector_to_array("probability"))
    answer = E.predict_with_abstain({c: F.coalesce(F.get("p", F.lit(c)), F.lit(0.0)) for c in classes}, t)
    return out.select("report_id", answer["code"].alias("predicted"), answer["reason"].alias("reason"), *[F.round(F.get("p", F.lit(c)), 4).alias(f"p{c}") for c in (4, 5, 6)])


# Class probabilities over the orders, for the decision rules.
def _proba(spark, d):
    key = F.col("exam_id")
    p = {c: ((key * (7 + 2 * c) + c * 13) % 97 + F.when(F.col("code") == c, 60).otherwise(0)) / F.lit(157.0) for c in range(7)}
    return exams(spark, d).select("exam_id", "code", *[v.alias(f"p{c}") for c, v in p.items()])


PROBA = "proba AS (SELECT exam_id, code, " + ", ".join(
    f"((exam_id * {7 + 2 * c} + {c * 13}) % 97 + CASE WHEN code = {c} THEN 60 ELSE 0 END) / 157.0::DOUBLE AS p{c}" for c in range(7)) + " FROM exams)"


@query("class_threshold_tuning", with_sql(EXAMS, PROBA) + """, long AS (SELECT code AS y, 4 AS class, p4 AS p FROM proba UNION ALL SELECT code, 5, p5 FROM proba UNION ALL SELECT code, 6, p6 FROM proba),
  grid AS (SELECT i, 0.1::DOUBLE + 0.89::DOUBLE * i / 39 AS t FROM (SELECT unnest(range(0, 40)) AS i)),
  att AS (SELECT class, i, t, count(*) FILTER (p >= t AND y = class) AS tp, count(*) FILTER (p >= t) AS called, count(*) FILTER (y = class) AS support FROM long, grid GROUP BY 1, 2, 3),
  f AS (SELECT *, CASE WHEN called + support > 0 THEN 2.0::DOUBLE * tp / (called + support) ELSE 0 END AS f1 FROM att)
  SELECT class, CASE WHEN f1 > 0 THEN round(t, 6) ELSE 0 END::DOUBLE AS threshold, round(CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END, 6) AS recall, round(f1, 6) AS f1
  FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, i) AS r FROM f) WHERE r = 1""")
def class_threshold_tuning(spark, d):
    long = _proba(spark, d).select(F.col("code").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p{c}").alias("p")) for c in (4, 5, 6)])).alias("e"))
    out = E.class_thresholds(long.select("y", "e.class", "e.p"), "y", "class", "p")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall", "f1")])


@query("predict_with_abstain", with_sql(EXAMS, PROBA) + """SELECT exam_id, CASE WHEN rare IS NOT NULL THEN rare WHEN top >= 4 THEN -1 ELSE common END AS code,
  CASE WHEN rare IS NOT NULL THEN 'rare_above_threshold' WHEN top >= 4 THEN 'rare_below_threshold' ELSE 'common_argmax' END AS reason FROM (SELECT exam_id,
  CASE WHEN p4 >= 0.6 AND p4 >= CASE WHEN p5 >= 0.7 THEN p5 ELSE -1 END AND p4 >= CASE WHEN p6 >= 0.65 THEN p6 ELSE -1 END THEN 4
    WHEN p5 >= 0.7 AND p5 >= CASE WHEN p6 >= 0.65 THEN p6 ELSE -1 END THEN 5 WHEN p6 >= 0.65 THEN 6 END AS rare,
  CAST(list_position([p0, p1, p2, p3, p4, p5, p6], greatest(p0, p1, p2, p3, p4, p5, p6)) - 1 AS INTEGER) AS top,
  CAST(list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 AS INTEGER) AS common FROM proba)""")
def predict_with_abstain(spark, d):
    answer = E.predict_with_abstain({c: F.col(f"p{c}") for c in range(7)}, {4: F.lit(0.6), 5: F.lit(0.7), 6: F.lit(0.65)})
    return _proba(spark, d).select("exam_id", answer["code"].alias("code"), answer["reason"].alias("reason"))


@query("classification_report", with_sql(EXAMS, PROBA) + """, pr AS (SELECT code AS y, CAST(list_position([p0, p1, p2, p3, p4, p5, p6], greatest(p0, p1, p2, p3, p4, p5, p6)) - 1 AS INTEGER) AS p FROM proba)
  SELECT c AS class, round(CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN called + support > 0 THEN 2 * tp / (called + support)::DOUBLE ELSE 0 END, 6) AS f1, support FROM
  (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS called FROM pr, (SELECT unnest(range(0, 7))::INTEGER AS c) GROUP BY 1) WHERE support + called > 0""")
def classification_report(spark, d):
    best = F.array_max(F.array(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(-c).alias("neg")) for c in range(7)]))
    out = E.classification_report(_proba(spark, d).withColumn("pred", -best["neg"]), "code", "pred")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("top_terms_per_class", with_sql(TOKENS) + """, coef AS (SELECT lang, term, round(sum(weight), 6) AS coef FROM tfidf JOIN documents USING (doc_id) GROUP BY 1, 2)
  SELECT lang, term, coef, 'largest' AS side, CAST(row_number() OVER (PARTITION BY lang ORDER BY coef DESC, term) AS INTEGER) AS rank FROM coef QUALIFY rank <= 10
  UNION ALL SELECT lang, term, coef, 'smallest', CAST(row_number() OVER (PARTITION BY lang ORDER BY coef, term) AS INTEGER) AS rank FROM coef QUALIFY rank <= 10""")
def top_terms_per_class(spark, d, max_features=TOP_TERMS):
    counts, vocabulary = _tfidf(spark, d, max_features)
    lang = table(spark, d, "documents").select("doc_id", "lang")
    coef = V.apply_tfidf(counts, vocabulary, "doc_id").join(lang, "doc_id").groupBy("lang", "term").agg(F.round(F.sum("weight"), 6).alias("coef"))
    high = top_n(coef, ["lang"], [F.desc("coef"), F.col("term")], "term", 10).withColumn("side", F.lit("largest"))
    low = top_n(coef, ["lang"], [F.col("coef"), F.col("term")], "term", 10).withColumn("side", F.lit("smallest"))
    return high.unionByName(low)


@query("top_terms_per_class_whole", _whole("top_terms_per_class"))
def top_terms_per_class_whole(spark, d):
    """Largest and smallest coefficients among all terms within the limits."""
    return top_terms_per_class(spark, d, max_features=None)


@query("embed_documents", with_sql(REPORTS) + f""", w AS (SELECT report_id, list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM reports),
  c AS (SELECT report_id, w[i * 180 + 1 : least(i * 180 + 200, len(w))] AS c FROM (SELECT report_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 200) / 180.0), 0) AS BIGINT))) AS i FROM w WHERE len(w) > 0)),
  t AS (SELECT report_id, len(list_filter(regexp_extract_all(lower(array_to_string(c, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOPS}))) AS n FROM c),
  p AS (SELECT report_id, count(*) AS k, avg(n) AS mass FROM t GROUP BY 1)
  SELECT report_id, CASE WHEN k IS NULL THEN 0 ELSE 32 END::BIGINT AS dim, coalesce(k, 0) AS n_chunks, 'hash-32' AS model,
  substr(sha256(regexp_replace(trim(nfc_normalize(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+', ' ', 'g')), 1, 32) AS hash, round(coalesce(mass, 0.0), 4) AS mass
  FROM reports LEFT JOIN p USING (report_id)""")
def embed_documents(spark, d):
    docs = reports(spark, d).select("report_id", "text")
    chunks = docs.select("report_id", F.posexplode(word_chunks(F.coalesce("text", F.lit("")), 200, 20)).alias("chunk_no", "chunk"))
    pooled = V.pool_mean(V.hashed_vectors(chunks, "report_id", "chunk", STOP_WORDS, 32), "report_id", "vector")
    joined = docs.join(pooled, "report_id", "left")
    return joined.select(
        "report_id", F.size(F.coalesce("vector", F.array().cast("array<double>"))).cast("bigint").alias("dim"),
        F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"), F.lit("hash-32").alias("model"), content_id(F.coalesce("text", F.lit(""))).alias("hash"),
        F.round(F.aggregate(F.coalesce("vector", F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + v), 4).alias("mass"),
    )


# ------------------------------------------------------------------ pooled and history vectors
@query("chunk_pool_mean", "SELECT label, count(*) AS n_chunks, round(avg(embedding[1]::DOUBLE), 6) AS v1, round(avg(embedding[64]::DOUBLE), 6) AS v64 FROM embeddings GROUP BY 1")
def chunk_pool_mean(spark, d):
    pooled = V.pool_mean(table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", "n_chunks", F.round(F.col("embedding")[0], 6).alias("v1"), F.round(F.col("embedding")[63], 6).alias("v64"))


@query("chunk_pool_concat", """SELECT vec_id // 4 AS doc, count(*) * 64 AS dim, round(list_sum(list_transform(flatten(list(embedding ORDER BY vec_id)), lambda x, i: x::DOUBLE * i)), 4) AS checksum FROM embeddings GROUP BY 1""")
def chunk_pool_concat(spark, d):
    chunks = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("doc"), "vec_id", "embedding")
    out = V.pool_concat(chunks, "doc", "vec_id", "embedding")
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return out.select("doc", F.size("embedding").cast("bigint").alias("dim"), F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 4).alias("checksum"))


def _exam_vectors(spark, d, some=None):
    """Vectors of all exams, or of some."""
    emb = table(spark, d, "embeddings")
    n = emb.agg(F.count(F.lit(1))).scalar()
    ex = (exams(spark, d) if some is None else some).withColumn("vec_id", F.pmod(F.col("exam_id"), n))
    return ex.join(emb.select("vec_id", "embedding"), "vec_id").select("entity_id", "exam_id", "ts", "embedding")


EXAM_VECTORS = "ev AS (SELECT entity_id, exam_id, ts, embedding FROM exams JOIN embeddings ON vec_id = exam_id % (SELECT count(*) FROM embeddings))"
SUM64 = "list_sum(list_transform(p.embedding, lambda x: x::DOUBLE))"


def _history(how, months=None, lam=0.001):
    def run(spark, d):
        vec = _exam_vectors(spark, d)
        out = V.history_vectors(vec, vec, "entity_id", "ts", "embedding", how=how, months=months, lam=lam)
        core = F.slice("embedding", 1, 64)
        per = out.select(
            "entity_id", "ts", F.round(F.col("embedding")[0], 5).alias("v1"),
            F.round(F.aggregate(core, F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
            F.size("embedding").cast("bigint").alias("dim"),
            *([F.round(F.col("embedding")[64], 5).alias("mean_days")] if how == "mean" else []),
        )
        return vec.select("entity_id", "exam_id", "ts").join(per, ["entity_id", "ts"]).drop("entity_id", "ts")

    return run


def _history_sql(weight, dim, extra="", months=None):
    reach = "" if months is None else (" AND p.ts = e.ts" if months == 0 else f" AND p.ts >= CAST(e.ts - INTERVAL {months} MONTH AS DATE)")
    return with_sql(EXAMS, EXAM_VECTORS) + f""", pairs AS (SELECT e.exam_id, e.ts - p.ts AS gap, max(e.ts - p.ts) OVER (PARTITION BY e.exam_id) AS span, p.embedding[1]::DOUBLE AS x1, {SUM64} AS xs
  FROM ev e JOIN ev p ON p.entity_id = e.entity_id AND p.ts <= e.ts{reach}), w AS (SELECT *, ({weight})::DOUBLE AS w FROM pairs)
  SELECT exam_id, CASE WHEN sum(w) > 0 THEN round(sum(w * x1) / sum(w), 5) ELSE 0 END AS v1, CASE WHEN sum(w) > 0 THEN round(sum(w * xs) / sum(w), 5) ELSE 0 END AS total, {dim}::BIGINT AS dim{extra} FROM w GROUP BY 1"""


query("mean_history_vector", _history_sql("1", 65, ", round(avg(gap), 5) AS mean_days"))(_history("mean"))
query("index_exam_only", _history_sql("1", 65, ", round(avg(gap), 5) AS mean_days", 0))(_history("mean", 0))
query("time_weighted_history_vector", _history_sql("exp(-0.001 * gap)", 64))(_history("exponential"))
query("history_vector_inverse", _history_sql("1.0 / (1.0 + gap)", 64))(_history("inverse"))
query("history_vector_linear", _history_sql("greatest(1.0 - gap / CASE WHEN span > 0 THEN span ELSE 1 END, 0)", 64, "", 36))(_history("linear", 36))


@query("history_vector_registry", " UNION ALL ".join(
    f"SELECT '{n}' AS how, * FROM ({s})" for n, s in (
        ("mean_36", _history_sql("1", 65, months=36)), ("exponential_36", _history_sql("exp(-0.001 * gap)", 64, months=36)))))
def history_vector_registry(spark, d):
    mean = _history("mean", 36)(spark, d).drop("mean_days").withColumn("how", F.lit("mean_36"))
    return mean.unionByName(_history("exponential", 36)(spark, d).withColumn("how", F.lit("exponential_36")))


# ------------------------------------------------------------------ risk models
#: Steps of each model's optimiser (trees when boosted), trials of a search, epochs of a trial.
MODEL_STEPS = {"logistic": 50, "boosted": 20, "perceptron": 30}
TRIALS, TRIAL_EPOCHS, CV_TRIALS, CV_BEST = 20, 15, 10, 3
#: Length of a history vector (64 and the mean days) and of the whole feature vector.
HISTORY_DIMS = 65
INPUTS = HISTORY_DIMS + len(RF.STRUCTURED)
SPACE = [
    Parameter("depth", 1, 3, whole=True), Parameter("units", 8, 64, log=True, whole=True),
    Parameter("learning_rate", 1e-3, 1.0, log=True), Parameter("optimizer", 0, 1, whole=True),
]
FOLDS = (0, 1, 2)
PARAMS = ("trial", *[p.name for p in SPACE])
METRICS = ("auroc", "average_precision")
IN_BOUNDS = "true AS in_bounds"

RISK = with_sql(EXAMS, CONF, KEPT, INDEX, EVENTS, ANSWERS, EXAM_VECTORS.replace("ev AS", "vx AS", 1), PIT)[:-1] + """,
  rows AS (SELECT idx.entity_id, idx.exam_id, idx.ts, idx.code, idx.n_prior,
    CASE WHEN event_date <= idx.ts + INTERVAL 24 MONTH THEN 1 ELSE 0 END AS label FROM idx LEFT JOIN ev USING (entity_id) WHERE event_date IS NULL OR event_date > idx.ts),
  ent AS (SELECT entity_id, max(label) AS label FROM rows GROUP BY 1),
  side AS (SELECT entity_id, label, CASE WHEN row_number() OVER w <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM ent WINDOW w AS (PARTITION BY label ORDER BY md5('42:' || entity_id))),
  part AS (SELECT entity_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('43:' || entity_id)) - 1) % 3 AS INTEGER) AS fold FROM side WHERE split = 'train'),
  feat AS (SELECT rows.*, split, coalesce(fold, -1) AS fold FROM rows JOIN side USING (entity_id) LEFT JOIN part USING (entity_id))"""


def _risk_table(spark, d):
    ans = answers(spark, d).withColumn("flag", flag_map(F.col("flag")))
    vec = lambda some: _exam_vectors(spark, d, some).withColumnRenamed("embedding", "vector")
    return RF.risk_features(exams(spark, d), confirmations(spark, d), vec, ans)


@query("risk_feature_table", RISK + """,
  h AS (SELECT r.exam_id, round(avg(p.embedding[1]::DOUBLE), 5) AS v1, round(avg(list_sum(list_transform(p.embedding, lambda x: x::DOUBLE))), 5) AS total, round(avg(r.ts - p.ts), 5) AS mean_days
    FROM rows r JOIN vx p ON p.entity_id = r.entity_id AND p.ts <= r.ts AND p.ts >= CAST(r.ts - INTERVAL 36 MONTH AS DATE) GROUP BY 1)
  SELECT feat.entity_id, feat.exam_id, label, split, fold, code, n_prior, n_answers, children, flag, v1, total, mean_days
  FROM feat LEFT JOIN h USING (exam_id) LEFT JOIN pit USING (exam_id)""")
def risk_feature_table(spark, d):
    """What is known at each index exam: history mean over 36 months, answers, counts; label, split and fold by entity."""
    total = F.aggregate(F.slice("history", 1, 64), F.lit(0.0), lambda s, x: s + x)
    return _risk_table(spark, d).select(
        "entity_id", "exam_id", "label", "split", "fold", "code", "n_prior", "n_answers", "children", "flag",
        F.round(F.col("history")[0], 5).alias("v1"), F.round(total, 5).alias("total"), F.round(F.col("history")[64], 5).alias("mean_days"),
    )


def _train_rows(spark, d):
    """The training split's model rows, in partitions of their own."""
    return RF.model_rows(_risk_table(spark, d), HISTORY_DIMS).where(F.col("split") == "train").repartition("exam_id")


def _risk_rows(spark, d):
    return write_stage(_train_rows(spark, d), stage_path(spark, "risk"))


def _model_metrics(spark, d):
    """Three models, trained on folds 1 and 2; metrics say whether their entities were trained on."""
    rows, out = _risk_rows(spark, d), None
    for kind, steps in MODEL_STEPS.items():
        model = risk.risk_estimator(kind, inputs=INPUTS, max_iter=steps).fit(rows.where("fold <> 0"))
        part = risk.predict(model, rows, "exam_id", "fold", "label").withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    role = F.when(F.col("fold") == 0, "held out").otherwise("trained on")
    scored = write_stage(out.withColumn("role", role), stage_path(spark, "model-scores"))
    return risk.trial_metrics(scored, ["model"], within=["role"])


@query("risk_model_fit_predict", RISK + f""" SELECT model, CASE WHEN fold = 0 THEN 'held out' ELSE 'trained on' END AS role, count(*) AS n,
  sum(label)::BIGINT AS n_events, {IN_BOUNDS} FROM feat, (SELECT unnest(['logistic', 'boosted', 'perceptron']) AS model) WHERE split = 'train' GROUP BY 1, 2""")
def risk_model_fit_predict(spark, d):
    """The countable columns of ``risk_model_metrics``."""
    return _model_metrics(spark, d).select("model", "role", "n", F.col("n_pos").alias("n_events"), "in_bounds")


@query("risk_model_metrics")
def risk_model_metrics(spark, d):
    """AUROC and average precision of three models, on held-out entities and on those trained on; the best of each role."""
    return _model_metrics(spark, d).select("model", "role", "n", F.col("n_pos").alias("n_events"), *METRICS, "is_best")


def _perceptron(values, held):
    """The perceptron of a trial, which does not learn from one fold."""
    layers = (INPUTS, *[int(values["units"])] * int(values["depth"]), 2)
    return perceptron.Fit(layers, ("l-bfgs", "gd")[int(values["optimizer"])], values["learning_rate"], held)


def _scored_fits(rows, fits, name):
    """Predictions of perceptrons that are trained together, each for its held fold."""
    weights = perceptron.fit_together(rows, fits, steps=TRIAL_EPOCHS)
    return write_stage(perceptron.score_together(rows, fits, weights, "exam_id", "label"), stage_path(rows.sparkSession, name))


def _searched(spark, d, trials):
    """Trials trained on folds 1 and 2, scored on fold 0; every proposal comes from the table of the trials before it.

    The rows stay persisted.
    """
    flat = perceptron.flat_rows(_train_rows(spark, d), "features", "label", "fold", "exam_id")
    rows = write_stage(flat, stage_path(spark, "risk")).persist()

    def together(values):
        quality = risk.trial_metrics(_scored_fits(rows, [_perceptron(v, 0) for v in values], "trial-scores"), ["fit"])
        of = {m["fit"]: m for m in quality.collect()}  # one row for each of the values
        return [{"result": m["auroc"], **{c: m[c] for c in ("average_precision", "n", "n_pos", "in_bounds")}} for m in map(of.get, range(len(values)))]

    table = search(
        spark, SPACE, lambda v: together([v])[0], stage_path(spark, "trials"), trials=trials, together=together,
        schema="average_precision double, n long, n_pos long, in_bounds boolean",
    )
    first = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("result", "average_precision").desc_nulls_last(), "trial")  # one row per trial
    return rows, table.withColumn("is_best", F.row_number().over(first) == 1)


@query("param_search", RISK + f""" SELECT trial, count(*) AS n_validation, sum(label)::BIGINT AS n_events, {IN_BOUNDS}
  FROM feat, (SELECT unnest(range({TRIALS}))::INTEGER AS trial) WHERE fold = 0 GROUP BY 1""")
def param_search(spark, d):
    """The countable columns of ``param_search_trials``."""
    rows, table = _searched(spark, d, TRIALS)
    rows.unpersist()
    return table.select("trial", F.col("n").alias("n_validation"), F.col("n_pos").alias("n_events"), "in_bounds")


@query("param_search_trials")
def param_search_trials(spark, d):
    """Each trial's parameters, validation AUROC and average precision, and which trial is best."""
    rows, table = _searched(spark, d, TRIALS)
    rows.unpersist()
    return table.select(*PARAMS, F.col("n").alias("n_validation"), F.col("n_pos").alias("n_events"), F.col("result").alias("auroc"), "average_precision", "is_best")


def _fold_trials(spark, d):
    """The best values of a search, trained on the other folds of each fold and scored on it."""
    rows, table = _searched(spark, d, CV_TRIALS)
    best = table.orderBy(F.coalesce("result", "average_precision").desc_nulls_last(), "trial").limit(CV_BEST).collect()
    tried = [(k, row) for k in FOLDS for row in best]
    scores = _scored_fits(rows, [_perceptron(row, k) for k, row in tried], "fold-scores")
    names = spark.createDataFrame([(i, k, *[row[c] for c in PARAMS]) for i, (k, row) in enumerate(tried)], ["fit", "fold", *PARAMS])
    scored = scores.join(names.withColumns({c: F.col(c).cast("int") for c in ("fit", "fold", "trial")}), "fit")
    total = rows.agg(F.count("*")).scalar()
    return risk.trial_metrics(scored, PARAMS, within=["fold"]).withColumn("n_trained", total - F.col("n"))


@query("cv_train_eval", RISK + f""" SELECT fold, count(*) AS n_scored, (SELECT count(*) FROM feat WHERE split = 'train') - count(*) AS n_trained,
  sum(label)::BIGINT AS n_pos, count(*) - sum(label)::BIGINT AS n_neg, {IN_BOUNDS} FROM feat WHERE split = 'train' GROUP BY 1""")
def cv_train_eval(spark, d):
    """The countable columns of each fold's best trial."""
    best = _fold_trials(spark, d).where("is_best")
    return best.select("fold", F.col("n").alias("n_scored"), "n_trained", "n_pos", "n_neg", "in_bounds")


@query("cv_fold_trials")
def cv_fold_trials(spark, d):
    """The searched parameters that did best, their AUROC and average precision on every fold, and the best of each fold."""
    return _fold_trials(spark, d).select("fold", *PARAMS, F.col("n").alias("n_scored"), "n_trained", "n_pos", "n_neg", *METRICS, "is_best")


PROPOSED = [Parameter("dropout", 0, 1), Parameter("depth", 1, 4, whole=True), Parameter("layer_0_units", 0, 800, whole=True)]
STUDY = ["dataset_name", "target_year", "split_config_name"]


@query("next_trial_proposal", with_sql(TUNING).rstrip() + PROPOSAL_SQL)
def next_trial_proposal(spark, d):
    """The next parameters of every study of the tuning log, from its trials' densities."""
    log = _tuning_log(spark, d).where(F.col("trial_number").isNotNull()).select(*STUDY, "trial_number", "result", "params.*")
    return propose(log, PROPOSED, study=STUDY, trial="trial_number").select(
        *STUDY, "n_trials", F.round("dropout", 6).alias("dropout"), F.col("depth").cast("int").alias("depth"), F.col("layer_0_units").cast("int").alias("layer_0_units")
    )


# ------------------------------------------------------------------ splits and samples
def _eligible(spark, d):
    """Index exams with an event flag per entity, as the split input."""
    return exams(spark, d).select("exam_id", "entity_id", (F.col("code") == 5).cast("int").alias("event"))


SPLIT = """
elx AS (SELECT exam_id, entity_id, CASE WHEN code = 5 THEN 1 ELSE 0 END AS event FROM exams),
ent AS (SELECT entity_id, max(event) AS event FROM elx GROUP BY 1),
split AS (SELECT entity_id, event, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY md5('42:' || entity_id)) <= ceil(count(*) OVER (PARTITION BY event) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ent),
folds AS (SELECT entity_id, event, CAST((row_number() OVER (PARTITION BY event ORDER BY md5('43:' || entity_id)) - 1) % 5 AS INTEGER) AS fold FROM split WHERE split = 'train'),
roles AS (SELECT exam_id, -1 AS fold, 'test' AS role FROM elx JOIN split USING (entity_id) WHERE split = 'test'
  UNION ALL SELECT exam_id, k, CASE WHEN k = f.fold THEN 'validation' ELSE 'train' END FROM elx JOIN folds f USING (entity_id), (SELECT unnest(range(0, 5))::INTEGER AS k))"""


@query("stratified_entity_split", with_sql(EXAMS, SPLIT) + "SELECT entity_id, event, split FROM split")
def stratified_entity_split(spark, d):
    return P.stratified_entity_split(_eligible(spark, d), "entity_id", "event")


@query("stratified_kfold_by_entity", with_sql(EXAMS, SPLIT) + "SELECT entity_id, event, fold FROM folds")
def stratified_kfold_by_entity(spark, d):
    return P.stratified_kfold(P.stratified_entity_split(_eligible(spark, d), "entity_id", "event"), "entity_id", "event")


def _roles(spark, d):
    rows = _eligible(spark, d)
    split = P.stratified_entity_split(rows, "entity_id", "event")
    return P.exam_roles(rows, split, P.stratified_kfold(split, "entity_id", "event"), "entity_id", "exam_id")


@query("entity_to_exam_split", with_sql(EXAMS, SPLIT) + "SELECT exam_id, fold, role FROM roles")
def entity_to_exam_split(spark, d):
    return _roles(spark, d)


@query("cohort_split_table", with_sql(EXAMS, SPLIT) + "SELECT exam_id, CASE WHEN role = 'test' THEN 'test' ELSE 'train' END AS cohort FROM roles WHERE fold <= 0")
def cohort_split_table(spark, d):
    one = _roles(spark, d).where(F.col("fold") <= 0)
    return one.select("exam_id", F.when(F.col("role") == "test", "test").otherwise("train").alias("cohort"))


LAB = "labx AS (SELECT o_orderkey AS exam_id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS label FROM orders)"


def _labx(spark, d):
    positive = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"), positive.cast("int").alias("label"))


@query("undersample_negative", with_sql(LAB) + """SELECT exam_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || exam_id)) AS r FROM labx)
  WHERE label = 1 OR r <= 4 * (SELECT sum(label) FROM labx)""")
def undersample_negative(spark, d):
    return P.undersample_negative(_labx(spark, d), "exam_id", "label", 4)


@query("oversample_positive", with_sql(LAB) + """, c AS (SELECT sum(label) AS pos, count(*) FILTER (label = 0) // 3 AS goal FROM labx),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || exam_id)) AS r FROM labx)
  SELECT exam_id, label FROM (SELECT exam_id, label, unnest(range(0, CAST(CASE WHEN label = 0 THEN 1 ELSE goal // pos + CASE WHEN r <= goal - (goal // pos) * pos THEN 1 ELSE 0 END END AS BIGINT))) AS k FROM r, c)""")
def oversample_positive(spark, d):
    return P.oversample_positive(_labx(spark, d), "exam_id", "label", 3)


@query("keep_positive_sample_negative", with_sql(LAB) + "SELECT exam_id, label FROM labx WHERE label = 1 OR CAST('0x' || substr(md5('42:' || exam_id), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)")
def keep_positive_sample_negative(spark, d):
    from ..sources.readers import hash_fraction

    rows = _labx(spark, d)
    return rows.where(F.col("label") == 1).unionByName(hash_fraction(rows.where(F.col("label") == 0), "exam_id", 0.25))


@query("imbalance_ratio", with_sql(LAB) + "SELECT round(avg(label), 6) AS ratio, count(*) AS n FROM labx")
def imbalance_ratio(spark, d):
    return _labx(spark, d).agg(F.round(F.avg("label"), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ exploration
@query("eda_positive_dates", with_sql(EXAMS, CONF, EVENTS) + "SELECT exam_id, CAST(first_code5 AS VARCHAR) AS first_code5, CAST(first_confirmation AS VARCHAR) AS first_confirmation FROM exams LEFT JOIN ev USING (entity_id)")
def eda_positive_dates(spark, d):
    from ..operators.cohort import earliest_event_date

    ex = exams(spark, d)
    ev = earliest_event_date(ex, confirmations(spark, d), "entity_id", "ts", "code", "result")
    return ex.join(ev, "entity_id", "left").select("exam_id", day("first_code5").alias("first_code5"), day("first_confirmation").alias("first_confirmation"))


@query("eda_eligible_features", BASE + """, k AS (SELECT exam_id, max(code) AS code, max(n_prior) AS n_prior, max(event) FILTER (y <= 2) AS event_indicator,
  CASE WHEN max(followup) FILTER (y >= 2) = 1 OR max(event) FILTER (y <= 2) = 1 THEN 1 ELSE 0 END AS e FROM lab GROUP BY 1) SELECT exam_id, code, n_prior, event_indicator FROM k WHERE e = 1""")
def eda_eligible_features(spark, d):
    from ..operators import cohort as C

    df = _labelled(spark, d)
    one = C.eligibility_singleyear(df, [f"event_{y}yr" for y in C.YEARS], [f"followup_{y}yr" for y in C.YEARS], 2)
    return one.where(F.col("eligibility") == 1).select("exam_id", "code", "n_prior", "event_indicator")

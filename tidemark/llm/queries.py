"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents
from .exact_dedup import exact_groups
from .language import fit_languages, identify_languages
from .language_model import fit_language_model, score_texts
from .mixing import plan_mix
from .near_dedup import near_duplicates
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .registry import query
from .repeats import repeated_spans
from .runs import periodic_runs
from .sharding import shard_documents
from .spelling import group_variants
from .toxicity import fit_toxicity, in_fold, score_toxicity

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS perm,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 2 AS most,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM d GROUP BY source),
  f AS (SELECT *, CAST(most AS DOUBLE) / weight AS fill FROM s),
  l AS (SELECT *, row_number() OVER w AS pos, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM f WINDOW w AS (ORDER BY fill, source NULLS LAST)),
  t AS (SELECT source, source_size, least(CAST(most AS DOUBLE),
      coalesce((SELECT arg_min(level, pos) FROM l WHERE level <= fill), level) * weight) AS target FROM l),
  p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS passes FROM t),
  r AS (SELECT doc_id, d.source, size, source_size, target, CAST('0x' || substr(perm, 1, 2) AS BIGINT) AS block,
      CAST(passes AS BIGINT) AS passes, target - passes * source_size AS rest,
      CAST(sum(size) OVER (PARTITION BY d.source ORDER BY perm) - sum(size) OVER (PARTITION BY d.source, perm) AS BIGINT) AS base,
      CAST(sum(size) OVER (PARTITION BY d.source, perm) AS BIGINT) AS words, count(*) OVER (PARTITION BY d.source, perm) AS n
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
  b AS (SELECT source, block, any_value(rest) AS rest, sum(sum(size)) OVER (PARTITION BY source ORDER BY block) AS upto FROM r GROUP BY source, block),
  e AS (SELECT source, min(block) FILTER (upto > rest) + 1 AS first_blocks FROM b GROUP BY source),
  q AS (SELECT p.source, CAST(passes * 256 + CASE WHEN target - passes * source_size > 0 THEN coalesce(first_blocks, 256) ELSE 0 END AS BIGINT) AS quota
    FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source),
  u0 AS (SELECT source, unnest(range(quota)) AS ball, 0 AS shard FROM q WHERE quota > 0),
  u1 AS (SELECT source, ball, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', '0', '1', source, ball)), source NULLS LAST, ball)
    > (count(*) OVER (PARTITION BY shard) + 1) // 2 THEN 1 ELSE 0 END AS shard FROM u0),
  u2 AS (SELECT source, ball, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', '0', '2', source, ball)), source NULLS LAST, ball)
    > (count(*) OVER (PARTITION BY shard) + 1) // 2 THEN 1 ELSE 0 END AS shard FROM u1),
  u3 AS (SELECT source, ball, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', '0', '4', source, ball)), source NULLS LAST, ball)
    > (count(*) OVER (PARTITION BY shard) + 1) // 2 THEN 1 ELSE 0 END AS shard FROM u2),
  s8 AS (SELECT source, list({'last': last, 'shard': shard} ORDER BY last) AS spans
    FROM (SELECT source, shard, sum(count(*)) OVER (PARTITION BY source ORDER BY shard) AS last FROM u3 GROUP BY source, shard) GROUP BY source),
  m AS (SELECT r.*, spans, least(passes + CASE WHEN rest > 0 AND (base + words <= rest OR (base <= rest AND n = 1 AND floor(rest - base) > 0)) THEN 1 ELSE 0 END, 2) AS copies
    FROM r LEFT JOIN s8 ON r.source IS NOT DISTINCT FROM s8.source)
SELECT doc_id, size, source_size, target, passes * size + CAST(CASE WHEN rest <= 0 THEN 0 WHEN base + words <= rest THEN size
    WHEN base <= rest AND n = 1 THEN floor(rest - base) ELSE 0 END AS BIGINT) AS taken, copies,
  concat_ws(',', CASE WHEN copies > 0 THEN list_filter(spans, lambda x: x.last > block)[1].shard END,
    CASE WHEN copies > 1 THEN list_filter(spans, lambda x: x.last > 256 + block)[1].shard END) AS shards FROM m"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
  k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k"""


SPELLING_SQL = r"""
WITH RECURSIVE bit AS (SELECT b, 0 AS k, b AS v FROM range(256) r(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
  tab AS (SELECT list(v ORDER BY b) AS crc FROM bit WHERE k = 8),
  run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
  one AS (SELECT id, run, count(*) AS n FROM run GROUP BY ALL),
  h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END))),
    lambda s, b: xor(s >> 8, crc[xor(s & 255, b) + 1])), 4294967295) AS h FROM one, tab),
  word AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
  voc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
  cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM voc, range(0, 1000) r(i) WHERE i < length(word)),
  near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, voc.word, voc.n FROM cut JOIN voc ON rest = voc.word
    UNION SELECT voc.word, cut.word, cut.n FROM cut JOIN voc ON rest = voc.word),
  best AS (SELECT word, count(*) AS n_near, min({'less': -n, 'near': near}) AS best FROM near GROUP BY 1),
  form AS (SELECT word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * voc.n THEN best.near END AS form,
    CASE WHEN -best.less >= 2 * voc.n THEN -best.less END AS form_n FROM voc LEFT JOIN best USING (word)),
  walk AS (SELECT word, word AS root, form AS ahead FROM form
    UNION ALL SELECT walk.word, form.word, form.form FROM walk JOIN form ON form.word = walk.ahead)
SELECT word, form.form, walk.root, n, n_near, form_n FROM form JOIN walk USING (word) WHERE walk.ahead IS NULL"""


@query("op2_source_mix", MIX_SQL)
def op2_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document in a mix of all sources by weight, its copies and the shards that the splitting tree gives them."""
    return plan_mix(documents(spark, d)).select(
        F.col("mix_id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"),
        F.concat_ws(",", F.transform("shards", lambda s: s.cast("string"))).alias("shards"),
    )


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The row that stays for every document, texts compared without white space."""
    return exact_groups(documents(spark, d)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op5_shards")
def op5_shards(spark: SparkSession, d: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together."""
    return shard_documents(documents(spark, d), 8)


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate classes on three-word shingles at a similarity of 0.85."""
    return near_duplicates(documents(spark, d), words=3, percent=85)


@query("op9_packing")
def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(documents(spark, d))


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors by cosine of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document; one third by hash is held out from learning."""
    docs = documents(spark, d).select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").where(~in_fold("doc_id", 3, 1))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op6_repeats")
def op6_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Bytes covered by 400-byte strings that occur elsewhere, for every document."""
    return repeated_spans(documents(spark, d), 400).drop("spans")


@query("op7_language")
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document; one quarter by hash is held out from learning."""
    docs = documents(spark, d)
    held_out = in_fold("doc_id", 4, 2)
    found = identify_languages(docs.select("doc_id", "text"), fit_languages(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


@query("op8_quality")
def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document by co-training; one third by hash is held out from learning."""
    docs = documents(spark, d).select("doc_id", "text", "lang", "source")
    held_out = in_fold("doc_id", 3, 1)
    labels = spark.read.parquet(f"{d}/labels.parquet").where(~held_out)
    scored = score_quality(docs, fit_quality(docs.where(~held_out), labels))
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("_content").alias("content_score"), F.col("_meta").alias("metadata_score"),
        F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_lm_score")
def op11_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """Log10 probability of every document under the language model; one fifth by hash is held out from learning."""
    docs = documents(spark, d).select("doc_id", "text")
    held_out = in_fold("doc_id", 5, 1)
    scored = score_texts(docs, fit_language_model(docs.where(~held_out)))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "attention_score",
    )


def planted_words(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts (by a hash of the id) the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.floor((F.col("n") - F.col("a")) / (g % 8 + 3)) + 1)
    rest = (F.col("n") - F.col("a")).cast("int")
    part = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words of every document, the longest one, and digests of all runs and of the text without repeats."""
    found = periodic_runs(planted_words(documents(spark, d)))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumns({"top": top, "lines": F.array_join(lines, "")})
    length = -F.col("top.less")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"),
        F.col("top.period").alias("period"), F.floor(length * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def misspelt_words(docs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """Letter runs of whole texts and their counts; one of 97 (by a hash of id and run) lacks a letter."""
    upper = "".join(map(chr, range(65, 91)))
    runs = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit("[a-z\u00C0-\u00FF]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Form and root of every word of at least five letters that occurs three times or more."""
    return group_variants(misspelt_words(documents(spark, d))).select("word", "form", "root", "n", "n_near", "form_n")

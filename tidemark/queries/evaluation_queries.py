"""Risk-score evaluation over labelled document scores."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..models import risk
from ..operators import evaluation as E
from ..operators.ordering import score_rank
from ..session import stage_path
from ..sources.writers import write_stage
from .grounding import SCORES, scores, table, with_sql
from .registry import query

BY = ["fold", "split"]


@query("auroc_ap", with_sql(SCORES) + """, c AS (SELECT fold, split, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY 1, 2, 3),
  w AS (SELECT *, coalesce(sum(neg) OVER lo, 0) AS below_neg, sum(pos) OVER hi AS pos_at, sum(neg) OVER hi AS neg_at FROM c
    WINDOW lo AS (PARTITION BY fold, split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (PARTITION BY fold, split ORDER BY score DESC))
  SELECT fold, split, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below_neg + neg / 2.0::DOUBLE)) / sum(pos) / sum(neg), 6) AS auroc,
  round(sum(pos * pos_at / (pos_at + neg_at)::DOUBLE) / sum(pos), 6) AS average_precision FROM w GROUP BY 1, 2""")
def auroc_ap(spark, d):
    out = E.auroc_ap(E.score_counts(scores(spark, d), "score", "label", by=BY), "score", by=BY)
    return out.select(*BY, "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"), F.round("average_precision", 6).alias("average_precision"))


def _roc_sql(by):
    keys = "".join(f"{k}, " for k in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return with_sql(SCORES) + f""", c AS (SELECT {keys}score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY ALL)
  SELECT {keys}score AS threshold, round(sum(neg) OVER hi / sum(neg) OVER ({part})::DOUBLE, 6) AS fpr, round(sum(pos) OVER hi / sum(pos) OVER ({part})::DOUBLE, 6) AS tpr FROM c WINDOW hi AS ({part} ORDER BY score DESC)"""


def _roc(by):
    def run(spark, d):
        out = E.roc_points(E.score_counts(scores(spark, d), "score", "label", by=by), "score", by=by)
        return out.select(*by, "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))

    return run


query("roc_curve", _roc_sql([]))(_roc([]))
query("roc_by_fold", _roc_sql(BY))(_roc(BY))


U = "((CAST('0x' || substr(md5('boot:' || replicate || ':' || exam_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
BOOT = "boot AS (SELECT *, " + " + ".join(f"CASE WHEN {U} > {s}::DOUBLE THEN 1 ELSE 0 END" for s in E.POISSON_STEPS) + " AS weight FROM scores, (SELECT unnest(range(0, 20)) AS replicate)),\n" + """
bc AS (SELECT replicate, score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS pos, sum(weight) AS rows FROM boot WHERE weight > 0 GROUP BY 1, 2)"""


ROC_SQL = with_sql(SCORES, BOOT.replace("range(0, 20)", "range(0, 10)")) + """, above AS (SELECT replicate, pos, rows - pos AS neg, sum(pos) OVER hi AS ap, sum(rows - pos) OVER hi AS an, sum(pos) OVER (PARTITION BY replicate) AS tp,
    sum(rows - pos) OVER (PARTITION BY replicate) AS tn FROM bc WINDOW hi AS (PARTITION BY replicate ORDER BY score DESC)),
  seg AS (SELECT replicate, (an - neg) / tn::DOUBLE AS x0, an / tn::DOUBLE AS x1, (ap - pos) / tp::DOUBLE AS y0, ap / tp::DOUBLE AS y1 FROM above WHERE tp > 0 AND tn > 0),
  grid AS (SELECT CAST(k AS INTEGER) AS k, k / 99.0::DOUBLE AS x FROM (SELECT unnest(range(0, 100)) AS k)),
  curve AS (SELECT replicate, k, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE max(CASE WHEN x1 > x0 THEN y0 + (x - x0) / (x1 - x0) * (y1 - y0) ELSE y1 END) END AS tpr FROM seg JOIN grid ON x BETWEEN x0 AND x1 GROUP BY replicate, k)
  SELECT k, round(k / 99.0::DOUBLE, 6) AS fpr, round(avg(tpr), 6) AS mean_tpr, round(stddev_pop(tpr), 6) AS std_tpr, round(quantile_cont(tpr, 0.025), 6) AS lower_tpr, round(quantile_cont(tpr, 0.975), 6) AS upper_tpr FROM curve GROUP BY 1"""


@query("roc_curve_ci", ROC_SQL)
def roc_curve_ci(spark, d):
    out = E.roc_curve_ci(scores(spark, d), "exam_id", "score", "label", replicates=10)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("fpr", "mean_tpr", "std_tpr", "lower_tpr", "upper_tpr")])


@query("auroc_bootstrap", with_sql(SCORES, BOOT) + """, w AS (SELECT replicate, pos, rows - pos AS neg, coalesce(sum(rows - pos) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bc),
  a AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / sum(pos) / sum(neg) AS v FROM w GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0)
  SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM a""")
def auroc_bootstrap(spark, d):
    """AUROC over bootstrap replicates: mean, deviation and 95 % limits."""
    out = E.auroc_ci(scores(spark, d), "exam_id", "score", "label", replicates=20)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "lower", "upper")])


def _boot_sql(direction):
    return with_sql(SCORES, BOOT) + f""", a AS (SELECT *, coalesce(sum(rows) OVER (PARTITION BY replicate ORDER BY score {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM bc),
  r AS (SELECT replicate, sum(pos * greatest(least(60 - ahead, rows), 0) / rows::DOUBLE) AS tp, sum(greatest(least(60 - ahead, rows), 0)) AS called, sum(pos) AS tpos, sum(rows) AS trows FROM a GROUP BY 1),"""


def _ci_sql(metrics):
    long = " UNION ALL ".join(f"SELECT '{n}' AS metric, {e} AS v FROM r" for n, e in metrics)
    return f""" m AS ({long}) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM m GROUP BY 1"""


def _rounded(df):
    return df.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lower", "upper")])


@query("topk_bootstrap", _boot_sql("DESC") + _ci_sql([("precision", "tp / called"), ("recall", "tp / tpos"), ("specificity", "(trows - tpos - (called - tp)) / (trows - tpos)")]))
def topk_bootstrap(spark, d):
    return _rounded(E.topk_bootstrap(scores(spark, d), "exam_id", "score", "label", 60, replicates=20))


@query("bottomk_bootstrap", _boot_sql("ASC") + _ci_sql([("npv", "(called - tp) / called"), ("false_negatives", "tp")]))
def bottomk_bootstrap(spark, d):
    return _rounded(E.bottomk_bootstrap(scores(spark, d), "exam_id", "score", "label", 60, replicates=20))


@query("curve_ci", """SELECT l_linenumber, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std, round(quantile_cont(l_extendedprice, 0.025), 6) AS lower,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS upper FROM lineitem GROUP BY 1""")
def curve_ci(spark, d):
    out = E.curve_ci(table(spark, d, "lineitem").select("l_linenumber", "l_extendedprice"), "l_extendedprice", by=["l_linenumber"])
    return out.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lower", "upper")])


RANK = "row_number() OVER (PARTITION BY fold, split ORDER BY score {0}, md5('42:' || exam_id)) AS rank"


@query("topk_metrics", with_sql(SCORES) + f""", r AS (SELECT *, {RANK.format('DESC')} FROM scores)
  SELECT fold, split, round(count(*) FILTER (rank <= 20 AND label = 1) / count(*) FILTER (rank <= 20)::DOUBLE, 6) AS precision, round(count(*) FILTER (rank <= 20 AND label = 1) / sum(label)::DOUBLE, 6) AS recall,
  round(count(*) FILTER (rank > 20 AND label = 0) / count(*) FILTER (label = 0)::DOUBLE, 6) AS specificity FROM r GROUP BY 1, 2""")
def topk_metrics(spark, d):
    out = E.topk_metrics(score_rank(scores(spark, d), "score", "exam_id", by=BY), "label", 20, by=BY)
    return out.select(*BY, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity")])


@query("bottomk_metrics", with_sql(SCORES) + f""", r AS (SELECT *, {RANK.format('ASC')} FROM scores)
  SELECT fold, split, round(count(*) FILTER (rank <= 20 AND label = 0) / count(*) FILTER (rank <= 20)::DOUBLE, 6) AS npv, count(*) FILTER (rank <= 20 AND label = 1) AS false_negatives FROM r GROUP BY 1, 2""")
def bottomk_metrics(spark, d):
    out = E.bottomk_metrics(score_rank(scores(spark, d), "score", "exam_id", by=BY, descending=False), "label", 20, by=BY)
    return out.select(*BY, F.round("npv", 6).alias("npv"), "false_negatives")


def _curve_sql(direction, cols):
    return with_sql(SCORES) + f""", r AS (SELECT *, {RANK.format(direction)}, count(*) OVER (PARTITION BY fold, split) AS n, sum(label) OVER (PARTITION BY fold, split) AS p FROM scores),
  g AS (SELECT fold, split, n, p, unnest(range(1, CAST(floor(floor(n * 0.3::DOUBLE) / 5) + 2 AS BIGINT))) * 5 AS k FROM (SELECT DISTINCT fold, split, n, p FROM r)),
  m AS (SELECT g.fold, g.split, g.k, any_value(g.n) AS n, any_value(g.p) AS p, count(*) AS called, sum(label) AS tp FROM g JOIN r ON r.fold = g.fold AND r.split = g.split AND r.rank <= g.k GROUP BY 1, 2, 3),
  curve AS (SELECT fold, split, k, round(k * 100.0::DOUBLE / n, 6) AS k_percent, {cols} FROM m)"""


TOPK_COLS = "round(tp / called::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall, round((n - p - (called - tp)) / (n - p)::DOUBLE, 6) AS specificity"
TOPK_CURVE = _curve_sql("DESC", TOPK_COLS)


def _topk_curve(spark, d):
    out = E.topk_curve(scores(spark, d), "exam_id", "score", "label", k=5, by=BY)
    return out.select(*BY, "k", *[F.round(c, 6).alias(c) for c in ("k_percent", "precision", "recall", "specificity")])


@query("topk_curve", TOPK_CURVE + "SELECT * FROM curve")
def topk_curve(spark, d):
    return _topk_curve(spark, d)


@query("bottomk_curve", _curve_sql("ASC", "round((called - tp) / called::DOUBLE, 6) AS npv, CAST(tp AS BIGINT) AS false_negatives") + "SELECT * FROM curve")
def bottomk_curve(spark, d):
    out = E.bottomk_curve(scores(spark, d), "exam_id", "score", "label", k=5, by=BY)
    return out.select(*BY, "k", *[F.round(c, 6).alias(c) for c in ("k_percent", "npv")], "false_negatives")


SIDES = ", ".join(f"{s[0]}.{c} AS {c}_{s}" for s in ("validation", "test") for c in ("k_percent", "precision", "recall", "specificity"))
JOINED = TOPK_CURVE + f"SELECT v.fold, v.k, {SIDES} FROM curve v LEFT JOIN curve t ON t.fold = v.fold AND t.k = v.k AND t.split = 'test' WHERE v.split = 'validation'"


@query("fold_metric_join", JOINED)
def fold_metric_join(spark, d):
    return E.fold_metric_join(_topk_curve(spark, d))


@query("topk_table_by_fold", JOINED)
def topk_table_by_fold(spark, d):
    return E.fold_metric_join(write_stage(_topk_curve(spark, d), stage_path(spark, "topk")))


# Twelve Newton steps from zero; the 3x3 system of a step is solved by Cramer's rule.
CALIBRATION = """
pts AS (SELECT ln(score) AS x1, ln(1 - score) AS x2, label FROM scores WHERE split = 'validation'),
fit(i, a, b, c) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, a + (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det,
    b + (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
    c + (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det FROM
  (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM
  (SELECT i, a, b, c, sum((label - q) * x1) - a AS g1, sum((label - q) * x2) - b AS g2, sum(label - q) AS g3, sum(q * (1 - q) * x1 * x1) + 1 AS h11, sum(q * (1 - q) * x1 * x2) AS h12,
    sum(q * (1 - q) * x1) AS h13, sum(q * (1 - q) * x2 * x2) + 1 AS h22, sum(q * (1 - q) * x2) AS h23, sum(q * (1 - q)) AS h33
    FROM (SELECT *, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS q FROM fit, pts WHERE i < 12) GROUP BY i, a, b, c)))"""


@query("beta_calibration", with_sql(SCORES, CALIBRATION).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT split, round(avg(pow(score - label, 2)), 6) AS brier_before,
  round(avg(pow(1 / (1 + exp(-(a * ln(score) + b * ln(1 - score) + c))) - label, 2)), 6) AS brier_after, count(*) AS n,
  round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS intercept FROM scores, fit WHERE i = 12 GROUP BY split, a, b, c""")
def beta_calibration(spark, d):
    rows = write_stage(scores(spark, d), stage_path(spark, "scores"))
    model = risk.beta_calibration(rows.where(F.col("split") == "validation"), "score", "label")
    out = risk.calibrate(model, rows, "score")
    return out.groupBy("split").agg(
        F.round(F.avg((F.col("score") - F.col("label")) ** 2), 6).alias("brier_before"),
        F.round(F.avg((F.col("pred_calibrated") - F.col("label")) ** 2), 6).alias("brier_after"), F.count(F.lit(1)).alias("n"),
        *[F.round(F.lit(v), 6).alias(k) for k, v in asdict(model).items()],
    )


@query("brier_score", with_sql(SCORES) + "SELECT fold, split, round(avg(pow(score - label, 2)), 6) AS brier FROM scores GROUP BY 1, 2")
def brier_score(spark, d):
    return scores(spark, d).groupBy(*BY).agg(F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 6).alias("brier"))


@query("model_outputs_table", with_sql(SCORES) + "SELECT exam_id, fold, split, label, round(score, 6) AS pred FROM scores WHERE score >= 0.1")
def model_outputs_table(spark, d):
    rows = scores(spark, d).where(F.col("score") >= 0.1)
    return rows.select("exam_id", "fold", "split", "label", F.round("score", 6).alias("pred"))


# ------------------------------------------------------------------ attributions
# A fixed linear model over the embeddings: coefficient of dimension i is sin(i), baseline 0.01 i.
def _attributed(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    n = F.sequence(F.lit(1), F.lit(64))
    coef, base = F.transform(n, lambda i: F.sin(i.cast("double"))), F.transform(n, lambda i: i * 0.01)
    return emb.withColumn("coef", coef).withColumn("base", base).withColumn("attr", E.linear_attribution(F.col("x"), F.col("base"), F.col("coef")))


ATTR = "att AS (SELECT vec_id, list_transform(embedding, lambda x, i: (x::DOUBLE - 0.01 * i) * sin(i)) AS a, embedding AS e FROM embeddings)"


@query("linear_attribution", with_sql(ATTR) + "SELECT vec_id, round(a[1], 6) AS a1, round(a[64], 6) AS a64, round(list_sum(a), 6) AS total FROM att")
def linear_attribution(spark, d):
    return _attributed(spark, d).select(
        "vec_id", F.round(F.col("attr")[0], 6).alias("a1"), F.round(F.col("attr")[63], 6).alias("a64"),
        F.round(F.aggregate("attr", F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
    )


@query("block_reliance", with_sql(ATTR) + """SELECT vec_id, round(t, 6) AS text_contrib, round(s, 6) AS struct_contrib, round(t / (t + s + 1e-12), 6) AS text_share FROM
  (SELECT vec_id, list_sum(list_transform(a[1:48], lambda x: abs(x))) AS t, list_sum(list_transform(a[49:64], lambda x: abs(x))) AS s FROM att)""")
def block_reliance(spark, d):
    out = E.block_reliance(F.slice("attr", 1, 48), F.slice("attr", 49, 16))
    return _attributed(spark, d).withColumn("r", out).select("vec_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("text_contrib", "struct_contrib", "text_share")])


@query("block_ablation", with_sql(ATTR) + """SELECT vec_id, round(list_sum(a[1:48]) / 48, 6) AS text_attribution, round(list_sum(a[49:64]) / 16, 6) AS struct_attribution FROM att""")
def block_ablation(spark, d):
    df = _attributed(spark, d)
    text, rest = F.slice("base", 1, 48), F.slice("base", 49, 16)
    full = E.dot(F.col("x"), F.col("coef"))
    no_text = E.dot(F.concat(text, F.slice("x", 49, 16)), F.col("coef"))
    no_struct = E.dot(F.concat(F.slice("x", 1, 48), rest), F.col("coef"))
    return df.select("vec_id", F.round((full - no_text) / 48, 6).alias("text_attribution"), F.round((full - no_struct) / 16, 6).alias("struct_attribution"))


@query("text_ablation_eval", with_sql(ATTR) + "SELECT vec_id, round(list_sum(list_transform(e, lambda x, i: CASE WHEN i <= 48 THEN 0 ELSE x::DOUBLE * sin(i) END)), 6) AS logit_without_text FROM att")
def text_ablation_eval(spark, d):
    zeroed = F.concat(F.array_repeat(F.lit(0.0), 48), F.slice("x", 49, 16))
    return _attributed(spark, d).select("vec_id", F.round(E.dot(zeroed, F.col("coef")), 6).alias("logit_without_text"))


@query("top_terms_per_row", with_sql(ATTR) + """, l AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(a) AS v FROM att)
  SELECT vec_id, string_agg('t' || i, ',' ORDER BY abs(v) DESC) AS terms FROM l WHERE abs(v) > 0.2 GROUP BY 1""")
def top_terms_per_row(spark, d):
    names = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    out = E.top_terms(names, F.col("attr"), 0.2)
    terms = F.array_join(F.transform(out, lambda p: p["term"]), ",")
    return _attributed(spark, d).select("vec_id", terms.alias("terms")).where(F.col("terms") != "")

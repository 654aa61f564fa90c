"""TF-IDF queries and the text classifier keep every term within the document-frequency limits."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidemark.models import risk
from tidemark.operators import vectors as V
from tidemark.queries import catalog, model_queries


def wide(spark, folder):
    """2,600 terms, each in five of 26 documents or more."""
    rows = [(i, " ".join(f"term{j}" for j in range(2600) if j % 26 in {(i + k) % 26 for k in range(5)}), "en") for i in range(26)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")


def test_whole_vocabulary(spark, tmp_path):
    wide(spark, tmp_path)
    got = catalog.QUERIES["tfidf_fit_transform_whole"](spark, str(tmp_path))
    assert got.select("term").distinct().count() == 2600
    cut = catalog.QUERIES["tfidf_fit_transform"](spark, str(tmp_path))
    assert cut.select("term").distinct().count() == 2000
    assert "LIMIT" not in catalog.ORACLES["tfidf_fit_transform_whole"] and "LIMIT 2000" in catalog.ORACLES["tfidf_fit_transform"]


def test_classifier_vocabulary(spark, monkeypatch):
    texts = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(1500)), 0.0), (2, " ".join(f"w{j}" for j in range(1500)), 1.0)], "report_id long, text string, code double")
    asked = []
    build = risk.text_pipeline
    # the stages up to the counts, without the regression
    monkeypatch.setattr(risk, "text_pipeline", lambda *a, **k: (asked.append(k), Pipeline(stages=build(*a, **k).getStages()[:3]))[1])
    coded = texts.unionByName(texts.withColumn("report_id", F.col("report_id") + 2))
    model, _ = model_queries._fitted(spark, coded)
    assert len(model.stages[2].vocabulary) == 1500 and asked == [{"max_features": None}]


def test_classifier_steps_over_few_blocks(spark, monkeypatch):
    words = ["nodulo", "mama", "direita", "esquerda", "benigno", "cisto", "calcificacao", "normal"]
    rows = [(i, " ".join(words[(i * k + k * k) % (3 + 5 * (i % 2))] for k in range(1, 6)), float(i % 2)) for i in range(60)]
    coded = spark.createDataFrame(rows, "report_id long, text string, code double").repartition(16)
    seen, fit = [], risk.LogisticRegression.fit
    monkeypatch.setattr(risk.LogisticRegression, "fit", lambda self, df, *a: (seen.append((df.rdd.getNumPartitions(), self.getMaxBlockSizeInMB(), df.columns)), fit(self, df, *a))[1])
    model, split = model_queries._fitted(spark, coded)
    assert seen == [(1, risk.STEP_BLOCK_MB, ["features", "code", "class_weight"])]
    train = risk.balance_weights(split.where("not holdout"), "code")
    plain = risk.text_pipeline("text", "code", model_queries.STOP_WORDS).fit(train)
    assert [type(s) for s in model.stages] == [type(s) for s in plain.stages]
    by_id = [{r.report_id: r.probability[1] for r in m.transform(split).collect()} for m in (model, plain)]
    assert by_id[0].keys() == by_id[1].keys() and all(abs(by_id[0][k] - by_id[1][k]) < 1e-3 for k in by_id[0])


def test_terms_are_not_shuffled_by_document(spark):
    docs = spark.createDataFrame([(i % 9, f"nodulo mama w{i % 4}") for i in range(40)] + [(None, "nodulo mama")], "doc_id long, text string")
    counts = V.term_counts(docs, "doc_id", "text", [])
    vocabulary = V.fit_tfidf(counts, F.lit(41), min_df=1)
    weights = V.apply_tfidf(counts, vocabulary.limit(3), "doc_id")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert exchanges and not any("term" in line for line in exchanges)
    assert all("REPARTITION_BY_COL" in line for line in exchanges)  # texts only
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(norms) == 10 and all(abs(r.s - 1) < 1e-9 for r in norms)

"""The text classifier learns from every report that has a code and is not held out."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidemark.models import risk
from tidemark.queries import model_queries


def test_no_class_is_capped(spark, monkeypatch):
    build = risk.text_pipeline
    # the stages up to the counts, without the regression
    monkeypatch.setattr(risk, "text_pipeline", lambda *a, **k: Pipeline(stages=build(*a, **k).getStages()[:3]))
    seen, weigh = [], risk.balance_weights
    monkeypatch.setattr(risk, "balance_weights", lambda df, label: (seen.append(df), weigh(df, label))[1])
    # more of a class than the 2,000 that were learned from; terms that two reports at its end share
    coded = spark.range(2600).select(
        F.col("id").alias("report_id"), F.concat(F.lit("nodulo mama t"), F.floor(F.col("id") / 10).cast("string")).alias("text"),
        F.when(F.col("id") % 13 == 12, 4.0).when(F.col("id") % 13 == 11, F.lit(None)).otherwise(1.0).alias("code"),
    )
    model, split = model_queries._fitted(spark, coded)
    assert {(r.code, r.holdout): r["count"] for r in split.groupBy("code", "holdout").count().collect()} == {
        (1.0, False): 1760, (1.0, True): 440, (4.0, False): 160, (4.0, True): 40,
    }
    assert seen[0].count() == 1920 and len(model.stages[2].vocabulary) == 262

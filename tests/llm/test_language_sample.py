"""The sample that a language is fitted on is bounded, never empty and free of copies."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import language


def test_sample_of_copies(spark, monkeypatch):
    def fitter(idf):
        return lambda t: pa.table({"lang": t["lang"].slice(0, 1), "centroid": [[float(t.num_rows)] * language.DIMS], "floor": [float(len(set(t["text"].to_pylist())))]},
                                  schema=pa.schema({"lang": pa.string(), "centroid": pa.list_(pa.float32()), "floor": pa.float64()}))

    monkeypatch.setattr(language, "_fitter", fitter)
    # x: 2000 copies of one text; y: 500 copies of each of two texts and 50 others; z: 30 texts
    x = spark.range(2000).select(F.lit("x").alias("lang"), F.lit("the same words").alias("text"))
    y = spark.range(1050).select(F.lit("y"), F.when(F.col("id") < 500, "hot one").when(F.col("id") < 1000, "hot two").otherwise(F.concat(F.lit("text "), "id")))
    z = spark.range(30).select(F.lit("z"), F.concat(F.lit("rare "), "id"))
    model = language.fit_languages(x.union(y).union(z), fit_rows=40)
    assert model.languages == ["x", "y", "z"]
    assert model.centroids[:, 0].tolist() == [1, 40, 30] and (model.floor / language.SLACK).round().tolist() == [1, 40, 30]

"""The typo-tolerant severity search: one pass over the text, same findings."""

from pyspark.sql import functions as F

from tidemark.functions import severity as S


def test_flex_searches_the_text_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(S.extract_flex(F.col("text")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1 and S.FLEX_FIRST in plan


def test_flex_findings(spark):
    cases = [
        ("x. BI-RADS 2.\nBI-RADS 4A, b1 rahds 3", "4A", "BI-RADS 4A, b1 rahds 3", None, 4.1),
        ("Antes. Categoria:\nBI-RADS 2", "2", "BI-RADS 2", None, 2.0),
        ("a. mama direita\n bi-rads: 3. mama esquerda birads 4B 😀. 😀 BIRADS I", "4B", None, "left", 4.2),
        ("😀😀. x BI-RADS 0\nBI-RADS 0", "0", None, None, 0.0),
        ("BI-RADS 5. BI-RADS 2\nBI-RADS 5", "5", None, None, 5.0),
        ("sem valor. BI-RADS", None, None, None, None),
        ("nada", None, None, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", S.extract_flex(F.col("text")).alias("f")).collect()}
    for i, (_, value, clause, side, rank) in enumerate(cases):
        f = got[i]
        if value is None:
            assert f is None
        else:
            assert (f.value, f.side, f.rank) == (value, side, rank)
            assert clause is None or f.clause == clause

"""The risk table moves the vectors alone that an index exam looks back on, and is the same with them as with all."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import risk_features as RF
from tidemark.queries import model_queries as Q


def _input(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    # entity 1: codes below 4 until its fifth exam; entity 2 begins with a high code and has no index exam; 3 has a long gap
    plan = {1: [(0, 1), (100, 2), (100, 3), (300, 2), (400, 5), (900, 2), (1000, 2)], 2: [(0, 6), (10, 1), (20, 1)], 3: [(0, 1), (2000, 2), (2100, 1)]}
    exams = [(e, 10 * e + i, day(n), c) for e, rows in plan.items() for i, (n, c) in enumerate(rows)]
    exams = spark.createDataFrame(exams, "entity_id long, exam_id long, ts date, code int")
    conf = spark.createDataFrame([(1, day(0), 0)], "entity_id long, ts date, result int")
    ans = spark.createDataFrame([(1, day(50), 2, 1), (3, day(5), 1, 0)], "entity_id long, ts date, children int, flag int")
    vec = exams.select("entity_id", "exam_id", "ts", F.array(F.col("exam_id").cast("float"), F.lit(0.5).cast("float")).alias("vector"))
    return exams, conf, vec, ans


def test_only_vectors_in_reach_are_asked_for(spark):
    exams, conf, vec, ans = _input(spark)
    asked = []

    def vectors(some):
        asked.append(sorted(r.exam_id for r in some.select("exam_id").collect()))
        return some.select("exam_id").join(vec, "exam_id").select("entity_id", "ts", "vector")

    got = RF.risk_features(exams, conf, vectors, ans).collect()
    assert asked == [[10, 11, 12, 13, 30, 31, 32]]
    whole = RF.risk_features(exams, conf, vec.select("entity_id", "ts", "vector"), ans).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and any(r.history for r in got)


def test_the_queries_ask_for_few(spark, monkeypatch):
    seen, join = [], Q._exam_vectors
    monkeypatch.setattr(Q, "_exam_vectors", lambda *a: (seen.append(join(*a)), seen[-1])[1])
    sf = "/root/testdata/sf0.001"
    table = Q._risk_table(spark, sf)
    assert seen[0].count() < 0.5 * Q.exams(spark, sf).count()
    assert table.where(F.col("history").isNull()).isEmpty()  # every exam has a vector

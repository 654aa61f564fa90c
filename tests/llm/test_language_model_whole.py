"""The language model's parameters and weights come from every training text, however the rows are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_model as M


@pytest.fixture
def texts(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("ka", "mu", "so", "ve") for b in ("ni", "pol", "ta") for c in ("", "ro", "lin")]
    rows = [(i, " ".join(rng.choice(words, 40)) + (f" once{i}" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(None, "ka muni ka"), (900, None), (901, ""), (902, "  "), (903, "kani"), (903, "kani")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def fitted(monkeypatch, docs, shard_bytes=4096):
    stages, staged = {}, M.staged
    monkeypatch.setattr(M, "SHARD_BYTES", shard_bytes, raising=False)
    monkeypatch.setattr(M, "staged", lambda df, name: stages.setdefault(name, staged(df, name)))
    model = M.fit_language_model(docs, steps=10)
    monkeypatch.setattr(M, "staged", staged)
    return model, stages["lm-learned"]


@pytest.mark.parametrize("frequent", [M.FREQUENT_WORDS, 20])
def test_every_text_is_learned_from_once(spark, monkeypatch, texts, frequent):
    monkeypatch.setattr(M, "FREQUENT_WORDS", frequent)
    model, learned = fitted(monkeypatch, texts)
    sub, rows = M.subwords(None), texts.collect()
    words = [w.encode() for r in rows for w in (r.text or "").split()]
    whole = learned.where("part = 0").agg(F.sum("n"), F.countDistinct("shard")).first()
    assert whole[0] == sum(int(sub.width[i]) for i in sub.find(words)) + len(rows) and whole[1] > 5
    binned = learned.where("bins IS NOT NULL").agg(F.sum(F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0]
    rare = learned.select(F.explode("rare").alias("r")).agg(F.sum(F.size("r.odds"))).first()[0]
    assert (binned or 0) + (rare or 0) == len(words) and bool(rare) == (frequent == 20)
    assert ((model.weight > 0) & (model.weight < 1)).all()


def test_rows_may_be_dealt_out_in_any_way(spark, monkeypatch, texts):
    one, _ = fitted(monkeypatch, texts.coalesce(1))
    other, _ = fitted(monkeypatch, texts.orderBy(F.desc("doc_id")).repartition(7))
    assert all(np.allclose(one.params[k], other.params[k], atol=1e-4) for k in one.params) and np.allclose(one.weight, other.weight, atol=1e-4)


def test_weights_equal_those_over_single_words(spark, monkeypatch, texts):
    """The bins of counted and of joined words give the same weights."""
    one, _ = fitted(monkeypatch, texts)
    monkeypatch.setattr(M, "FREQUENT_WORDS", 20)
    assert np.allclose(one.weight, fitted(monkeypatch, texts)[0].weight, atol=2e-3)

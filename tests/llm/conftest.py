import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"long{i % 977} text{i}" for i in range(12_000))
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " tail", "en", "b", 1),
        (4, None, "de", None, None), (5, "", None, "b", 0), (6, " \t\n", "fr", "c", 3), (7, long, "en", "a", 9),
        (8, "Two words", "en", None, 9), (9, "  two\tWORDS ", "en", "b", 9), (None, "no id here", "en", "a", 4),
        (None, None, None, None, None), (10, "éàü ß 漢字 👍", "xx", "ü", 5), (11, "aaaa " * 300, "en", "c", 7), (12, "12 34 !!", "en", "c", 7),
    ]
    out = spark.createDataFrame(rows, COLUMNS)
    clash = {c: "x" for c in ("size", "shard", "slot", "kept", "digest", "row", "node", "x", "y", "level", "block", "score", "target", "bytes", "_lang", "_score", "_rejected", "_content", "_meta",
                                 "_digest", "_copy", "_keep_id", "_whole", "_id", "_size", "mix_shard", "mix_order")}
    from pyspark.sql import functions as F

    return out.withColumns({c: F.lit(v) for c, v in clash.items()})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)

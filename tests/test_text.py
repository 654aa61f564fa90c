"""Severity extraction, topic rules and text helpers on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import severity as S
from tidemark.functions import text as X
from tidemark.functions import topics as T


def _eval(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}").repartition(2)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


@pytest.mark.parametrize("text, value, clause", [
    ("Conclusao: BI-RADS 4A.", "4A", "BI-RADS 4A"),
    ("BIRADS: II", "2", "BIRADS: II"),
    ("Laudo BI-RADS® 5ª edição.", None, None),
    ("BI-RADS 5 edition 2013. Nota. BI RADS 3", "3", "BI RADS 3"),
    ("mama direita BI-RADS 1 e mama esquerda BI-RADS 4", "4", "mama direita BI-RADS 1 e mama esquerda BI-RADS 4"),
    ("BI-RADS categoria 3", None, None),  # letters between token and value
    ("sem codigo", None, None),
])
def test_direct(spark, text, value, clause):
    got = _eval(spark, [text], S.extract_direct)[0]
    assert (got.value if got else None) == value
    assert (got.clause if got else None) == clause


def test_direct_on_long_lines_is_quick(spark):
    text = "a bi " * 20_000 + "\nBI-RADS 2"
    assert _eval(spark, [text], S.extract_direct)[0].value == "2"


def test_nearby(spark):
    texts = [
        "BI-RADS\nMamas densas.\nCategoria: III", "Classe 2 antes\nBI-RADS" + " x" * 400, "Categoria 1",
        "BI-RADS primeiro" + " y" * 400 + "\nBI-RADS segundo\nclassificação - 5", "BI RADS categoria 3",
    ]
    got = _eval(spark, texts, S.extract_nearby)
    assert [g.value if g else None for g in got] == ["3", "2", None, "5", "3"]
    assert [g.clause if g else None for g in got] == ["Categoria: III", "Classe 2 antes", None, "classificação - 5", "BI RADS categoria 3"]


def test_flex_takes_the_largest(spark):
    texts = [
        "Mama direita BI-RADS 2.\nCategoria: mama esquerda BI-RADS 4B", "b1 - rahdz 3", "BI-RADS 4 ou BI-RADS 4A", "nada",
        "BI-RADS 0\nmama direita: BIRADS 1",
    ]
    got = _eval(spark, texts, S.extract_flex)
    assert [(g.value, g.side) if g else None for g in got] == [("4B", "left"), ("3", None), ("4", None), None, ("1", "right")]
    assert got[0].clause == "Categoria: mama esquerda BI-RADS 4B" and got[0].rank == pytest.approx(4.2)


def test_zero_refine_and_normalise(spark):
    rows = [("0", "BI-RADS 0 exame 02"), ("0", "em 01/02/2003"), ("0", "BI-RADS 0"), ("3", "03")]
    df = spark.createDataFrame(rows, "v string, c string")
    assert [r[0] for r in df.select(S.refine_zero(F.col("v"), F.col("c"))).collect()] == ["02", "0", "0", "3"]
    assert _eval(spark, ["4A", "02", "7", "x", "6", None], S.normalize_code) == [4, 2, None, None, 6, None]
    assert _eval(spark, ["iv", "IVa", " 4c ", "VI"], S.normalize_value) == ["4", "4A", "4C", "6"]


def test_short_line_runs_to_the_full_stop(spark):
    got = _eval(spark, ["ab\nI\nmais texto. fim", "sem ponto\nI"], lambda c: X.line_containing(c, "I"))
    assert got == ["I\nmais texto.", "I"]


def _naive_points(text):
    """Direct reading of the rule: skip hits with a guard term inside the token window."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\w+|\S", text)]
    total = 0
    for terms, weight in ((T.PROCEDURE_STRONG, 2), (T.PROCEDURE_BASE, 1)):
        for term in terms:
            for m in re.finditer(T.term_pattern(term), text):
                at = next(i for i, (s, _) in enumerate(tokens) if s >= m.start())
                low, high = max(0, at - 8), min(len(tokens), at + 9)
                window = text[tokens[low][0] : tokens[high - 1][1]]
                if not any(re.search(T.term_pattern(g), window) for g in T.RECOMMENDATION):
                    total += weight
    return total


def test_guarded_points_match_direct_reading(spark):
    texts = [
        "biopsia core realizada", "biopsia sugerida", "biopsia a b c d e f g agendar", "biopsia a b c d e f g h agendar",
        "agendar a b c d e f g biopsia", "agendar a b c d e f g h biopsia tumor frasco", "a realizar: puncao-por agulha fina", "nada", "",
        "pre-agendada biopsia x x x x x x x x x tru-cut", "retorno para biopsia . . . . . . . . paf",
    ]
    assert _eval(spark, texts, T.procedure_points) == [_naive_points(t) for t in texts]


def test_topics_and_labels(spark):
    texts = ["Mamografia das mamas", "doppler venoso do abdome", "mama e doppler, doppler, doppler, tireoide", "   ", "axila areola mamilo"]
    got = _eval(spark, texts, T.topic_score)
    assert [g.on_topic for g in got] == [True, False, False, False, True]
    assert [g.score for g in got] == [6, -9, -9, 0, 3]
    assert _eval(spark, ["benigno maligno", "maligno", "indeterminado", None], T.outcome_code) == [0, 1, 0, None]
    assert _eval(spark, ["Prótese e EXÉRESE", None, "x"], T.surgical_terms) == [["Prótese", "EXÉRESE"], [], []]


def test_word_chunks(spark):
    text = " ".join(str(i) for i in range(7))
    for size, overlap in ((3, 0), (3, 2), (7, 0), (10, 3), (0, 0), (4, 1)):
        words, want, i = text.split(), [], 0
        while True:
            j = min(i + size, 7) if size > 0 else 7
            want.append(" ".join(words[i:j]))
            if j == 7:
                break
            i = j - overlap
        assert _eval(spark, [text], lambda c: X.word_chunks(c, size, overlap)) == [want]
    assert _eval(spark, ["  ", ""], lambda c: X.word_chunks(c, 3)) == [[], []]
    with pytest.raises(ValueError):
        X.word_chunks(F.lit("a"), 3, 3)


def test_small_text_helpers(spark):
    assert _eval(spark, ["Dr. A\nCRM-CE\n38340\nfim", "x\nCRM\nCE 12\n"], X.strip_signature_blocks) == ["fim", ""]
    assert _eval(spark, ["a\n  Cassete 1\nb"], X.strip_prefixed_lines) == ["a\nb"]
    assert _eval(spark, ["FILHOS-3", "filho NAO", "filhote 3", None, "filhos 2"], X.children_count_from_text) == [3, 0, None, None, 2]
    assert _eval(spark, ["S", "N", None, "X"], X.flag_map) == [1, 0, 0, None]
    assert _eval(spark, ["é́a", "ção"], X.strip_accents) == ["ea", "cao"]
    assert _eval(spark, ["é  x"], X.content_id) == _eval(spark, [" é x\n"], X.content_id)
    with pytest.raises(Exception):
        _eval(spark, ["日本"], X.text_hash)


def test_name_similarity(spark):
    rows = [("", ""), ("", "ana"), ("Ana da Silva", "SILVA, ANA"), ("José", "Jose"), ("ana", "zzz")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(N.name_similarity(N.normalize_name(F.col("a")), N.normalize_name(F.col("b")))).collect()]
    assert got[:4] == [None, 0.0, 1.0, 1.0] and got[4] == 0.0
    assert N._lcs("abcbdab", "bdcaba") == 4
    assert N._jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert N._partial("this is a test", "this is a test!") == 1.0
    assert N._ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert N._token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0


def test_birthdates_and_scores(spark):
    rows = [("2000-01-31", "2000-02-01", 0.95), ("2000-01-01", "2000-01-20", 0.8), ("2000-01-01", "2000-05-20", 0.6),
            ("2000-01-01", "2001-01-01", 0.85), ("2000-01-01", "2001-01-20", 0.5), ("2000-01-01", "2005-01-01", 0.0),
            (None, None, None), (None, "2000-01-01", 0.0), ("2000-01-01", "2000-01-01", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select(N.birthdate_similarity(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r.got == r.want
    pairs = spark.createDataFrame([(0.9, 1.0), (0.9, 0.0), (0.5, 0.6), (1.0, 1.0)], "n double, d double")
    got = [round(r[0], 6) for r in pairs.select(N.pair_score(F.col("n"), F.col("d"))).collect()]
    assert got == [1.0, 0.765, 0.53, 1.0]


def test_composed_texts_stay_in_the_jvm(spark):
    import re
    import unicodedata

    safe = [c for c in map(chr, range(0x3000)) if re.match(f"[{X.COMPOSED}]", c)]
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) for c in safe)
    assert unicodedata.normalize("NFC", "".join(a + b for a in "aeE\u00e9" for b in safe)) == "".join(a + b for a in "aeE\u00e9" for b in safe)
    texts = ["nódulo \u2019 20 €", "no\u0301dulo", "\u1100\u1161", "\u212b", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", X.nfc(F.col("t")).alias("n"))
    assert [r.n for r in out.orderBy("i").collect()] == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()

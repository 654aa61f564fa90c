"""Keyword rules over report text: topic score, two-class score, outcome labels."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefilter import Prefilter, parted
from .text import ascii_fold, bind, line_at, strip, strip_accents

# ---------------------------------------------------------------------------
# Term and pattern lists (accents are removed before matching).
# ---------------------------------------------------------------------------
ANCHORS = [
    r"\bmamas?\b", r"\bmamaria?s?\b", r"\bmamario?s?\b",
    r"\bmamograf(?:ia|ico?s?)\b",
    r"\bultra(?:s)?sonograf(?:ia|ico)?\s+(das?\s+)?mamas?\b",
    r"\bbi\s*[-–—]?\s*ra[h]?d[sz]\b",
    r"\bmama\s+(direita|esquerda)\b",
]
MILD_POSITIVE = [
    r"\bretroareolar\b", r"\bareolas?\b", r"\bmamilos?\b",
    r"\bfibroglandular\b", r"\bretromamari[oa]\b",
    r"\baxila(?:s)?\b",
    r"\bq(?:se|sd|ie|id|sl|il)\b",
    r"\b(supero|infero)(externo|interno)\b",
    r"\bginecomastia\b",
    r"\bCC\b\b|\bMLO\b",
]
STRONG_NEGATIVE = [
    r"\btireoide\b", r"\btiroide\b", r"\bparatireoide\b",
    r"\bparotidas?\b", r"\bsubmandibular(?:es)?\b",
    r"\bcarotidas?\b", r"\bregi[aa]o\s+cervical\b", r"\bcervical\b",
    r"\babdome\b", r"\babdominal\b", r"\bpelve\b", r"\bp[ee]lvic[ao]\b",
    r"\butero\b", r"\bendomet(rio|rial)\b", r"\bov[aa]rios?\b", r"\banexos?\b",
    r"\bprostata\b", r"\bves[ii]cula\s+seminal\b", r"\bbexiga\b",
    r"\brins?\b|\brenal\b|\bureter(?:es)?\b",
    r"\bfigado\b|\bhepatic[oa]\b", r"\bba[cc]o\b|\bespl[ee]n\w+\b", r"\bpancreas\b",
    r"\bves[ii]cula\s+biliar\b|\bcolecisto\b|\bcoledoco\b",
    r"\badrenais?\b|\bsuprarrenais?\b",
    r"\bobst[ee]trico?\b", r"\bfetal\b", r"\bgesta[cc][aa]o\b", r"\bgravidez\b",
    r"\bdoppler\b", r"\bvenos[oa]\b", r"\barterial\b", r"\bmmii\b", r"\bmmss\b",
    r"\bombro\b", r"\bjoelho\b", r"\bquadril\b", r"\bcotovelo\b", r"\bpunho\b",
    r"\bm[aa]o\b", r"\bp[ee]\b", r"\btornozelo\b", r"\barticula[cc][aa]o\b",
    r"\bcoluna\b", r"\blombar\b", r"\btoracica\b",
    r"\btorax\b", r"\bpulm\w+\b", r"\bpleur\w+\b", r"\bmediastin\w+\b",
]
MILD_NEGATIVE = [
    r"\btesticular\b|\bescrot\w+\b|\bpeniana\b",
    r"\bcranio\b|\bencef\w+\b|\bcerebr\w+\b",
    r"\bhombro\b",
]
ANCHOR_WEIGHT, MILD_WEIGHT, STRONG_NEG_WEIGHT, MILD_NEG_WEIGHT = 3, 1, -3, -1

TOPIC_WORDS = r"(?iu)\b(mama(s)?|mam[áa]ria(s)?|mam[áa]rio(s)?)\b"

PROCEDURE_STRONG = [
    "core needle biopsy", "core biopsy", "tru cut", "fine needle aspiration",
    "biopsia core", "biopsia incisional", "biopsia excisional", "puncao por agulha fina",
    "guiada por ultrassonografia", "guiada por usg", "sob anestesia local",
    "cuidados pos procedimento", "procedimento realizado",
    "fixados em formaldeido", "fixados em formalina",
    "clip metalico", "marcador clip", "tumor", "cassete",
    "agulha tru cut", "tru cut", "agulha core", "passagens de agulha",
    "peca cirurgica", "produto de setorectomia", "quadrantectomia", "macroscopia",
    "microscopia optica", "cortes histologicos", "laminas", "blocagem", "bloc o",
    "bloco de parafina", "material recebido", "frasco",
    "diagnostico:", "tipo histologico", "grau histologico", "nottingham",
    "estadiamento patologico", "ptnm", "linfonodo sentinela", "linfonodos regionais",
    "margens cirurgicas", "margens de resseccao",
]
PROCEDURE_BASE = [
    "biopsy", "biopsia", "puncao aspirativa", "paf", "histopatologico", "imuno histoquimica",
    "parafina", "microtomia", "fragmento tecidual", "fragmentos teciduais",
    "foram retirados", "fragmentos fixados", "fragmento tecidual", "fragmentos teciduais",
    "carcinoma ductal invasivo", "carcinoma lobular in situ", "carcinoma ductal in situ",
    "tamanho do tumor", "focalidade do tumor", "invasao vascular", "invasao linfatica",
    "microcalcificacoes", "negativo para malignidade", "nao ha sinais de malignidade",
    "cnb", "puncao aspirativa", "paf", "puncao por agulha fina", "agulha fina",
]
SCREENING_STRONG = [
    "tomosynthesis", "digital breast tomosynthesis", "dbt", "tomossintese", "bi-rads", "birads",
    "screening mammogram", "diagnostic mammogram", "mamografia digital",
    "mediolateral oblique", "mlo", "craniocaudal",
    "mamografia", "mamografia digital", "birads", "bi rads", "categoria birads",
    "tomossintese", "digital breast tomosynthesis", "dbt", "projecao craniocaudal",
    "craniocaudal", "projecao mediolateral obliqua", "mlo", "compressao", "dose glandular",
    "incidencia", "radiografia", "radiografico", "rastreamento", "screening", "diagnostica",
    "diagnostico mamografico", "laudo mamografico",
]
SCREENING_BASE = [
    "mammogram", "mammography", "mamografia", "calcificacoes", "assimetria", "densidade mamaria",
]
RECOMMENDATION = [
    "recommend", "recommended", "suggest", "sugerida", "sugerido", "indicar", "indicado",
    "agendar", "programar", "to be performed", "a realizar",
    "recomend", "suger", "orienta", "encaminh", "solicit", "pedido de", "requisit",
    "indica", "indicada", "indicado", "indicacao",
    "a realizar", "a ser realizada", "realizar se a", "sera realizada", "serao realizados",
    "program", "agendar", "agendada", "agendado", "agendamento", "pre agendada",
    "marcada", "marcado", "marcacao", "agendada para", "marcada para",
    "retornar para biopsia", "retorno para biopsia", "comparecer para", "preparo para",
    "jejum de", "autorizacao pendente", "aguardando autorizacao", "guia de procedimento",
    "laudo inconclusivo", "inconclusivo", "a esclarecer",
]
SURGICAL_TERMS = [
    "mastectomia", "mastectomizada", "mastectomizado", "mastectomia radical",
    "mastectomia parcial", "mastectomia total", "mastectomia simples", "mastectomia modificada",
    "quadrantectomia", "quadrantectomizada", "quadrantectomizado",
    "tumorectomia", "nodulectomia", "exerese", "exérese", "resseccao", "ressecção", "ressecada",
    "cirurgia de mama", "cirurgia mamaria", "cirurgia mamária",
    "cicatriz cirurgica", "cicatriz cirúrgica",
    "pos-operatorio", "pós-operatório", "pos-cirurgico", "pós-cirúrgico",
    "pos operatorio", "pós operatório",
    "protese", "prótese", "implante", "implante mamario", "implante mamário",
    "protese mamaria", "prótese mamária",
    "reconstrucao mamaria", "reconstrução mamária", "reconstrucao de mama", "reconstrução de mama",
    "area de resseccao", "área de ressecção", "leito cirurgico", "leito cirúrgico",
]
MALIGNANT_WORDS = ["carcinoma", "maligno", "in situ", "invasivo"]
BENIGN_WORDS = ["benigno", "sem malignidade", "sem atipia", "papiloma", "papilona", "adenoma"]
GUARD_TOKENS = 8
# ---------------------------------------------------------------------------


def _lower(pattern: str) -> str:
    """Lower-case the letters of a pattern, not its escapes, for use on lower-case text."""
    return re.sub(r"(?<!\\)[A-Z]", lambda m: m.group().lower(), pattern)


def _total(text: Column, patterns: Sequence[str], found: Column, keys: Prefilter, at: int) -> Column:
    """Matches summed over the patterns from place ``at`` of the filter's list; only those whose key was found are searched."""
    counts = [F.when(keys.possible(found, at + i), F.regexp_count(text, F.lit(_lower(p)))).otherwise(0) for i, p in enumerate(patterns)]
    return reduce(lambda a, b: a + b, counts)


def _first_at(text: Column, patterns: Sequence[str], found: Column, keys: Prefilter, at: int) -> Column:
    return F.coalesce(*[
        F.when(keys.possible(found, at + i), F.nullif(F.regexp_instr(text, F.lit(_lower(p))), F.lit(0))) for i, p in enumerate(patterns)
    ])


TOPIC_PARTS = (ANCHORS, MILD_POSITIVE, STRONG_NEGATIVE, MILD_NEGATIVE)
TOPIC_KEYS = Prefilter([_lower(p) for part in TOPIC_PARTS for p in part])
#: Place of each part in the list of all topic patterns.
TOPIC_AT = [sum(len(p) for p in TOPIC_PARTS[:i]) for i in range(4)]


def topic_score(text: Column) -> Column:
    """struct(on_topic, score): weighted pattern counts over accent-free text."""

    def parts(plain: Column) -> Column:
        def weighed(found: Column) -> Column:
            anchor, mild, strong_neg, mild_neg = (_total(plain, p, found, TOPIC_KEYS, at) for p, at in zip(TOPIC_PARTS, TOPIC_AT, strict=True))
            negative = strong_neg * STRONG_NEG_WEIGHT + mild_neg * MILD_NEG_WEIGHT
            return F.struct((anchor * ANCHOR_WEIGHT).alias("anchor"), (mild * MILD_WEIGHT).alias("mild"), negative.alias("neg"))

        return bind(TOPIC_KEYS.found(plain), weighed)

    def decide(p: Column) -> Column:
        score = p["anchor"] + p["mild"] + p["neg"]
        anchored = p["anchor"] > 0
        on_topic = (anchored & ((score >= 1) | (p["neg"] >= -2))) | (~anchored & (score >= 3))
        return F.struct(on_topic.alias("on_topic"), score.alias("score"))

    blank = F.struct(F.lit(False).alias("on_topic"), F.lit(0).alias("score"))
    scored = bind(bind(strip_accents(F.lower(text)), parts), decide)
    return F.when(F.coalesce(strip(text), F.lit("")) == "", blank).otherwise(scored)


def topic_evidence(text: Column, on_topic: Column) -> Column:
    """The line of the best hit: an anchor or mild one if on topic, else a negative one."""
    def first(plain: Column) -> Column:
        return bind(TOPIC_KEYS.found(plain), lambda found: F.when(
            on_topic, _first_at(plain, [*ANCHORS, *MILD_POSITIVE], found, TOPIC_KEYS, 0)
        ).otherwise(_first_at(plain, [*STRONG_NEGATIVE, *MILD_NEGATIVE], found, TOPIC_KEYS, TOPIC_AT[2])))

    at = bind(strip_accents(F.lower(text)), first)
    return line_at(text, at, to_period=False)


def keyword_flag(text: Column, pattern: str = TOPIC_WORDS) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def term_pattern(term: str) -> str:
    """A whole-word pattern; the words of a term may be joined by blanks or hyphens."""
    return r"\b" + r"[\s-]+".join(re.escape(w) for w in term.split()) + r"\b"


def guarded_hits(
    strong: Sequence[str], base: Sequence[str], guard: Sequence[str], window: int = GUARD_TOKENS
):
    """Arrow UDF: weighted term hits (2 / 1), skipping hits near a guard term.

    A hit is skipped when a guard term lies wholly inside the ``window`` tokens on either
    side of the hit's first token.
    """
    weighted = [(term_pattern(t), 2) for t in strong] + [(term_pattern(t), 1) for t in base]
    guards = [term_pattern(t) for t in guard]

    keys = Prefilter([*[p for p, _ in weighted], *guards])

    @F.pandas_udf(T.IntegerType())
    def score(text: pd.Series) -> pd.Series:
        any_key = re.compile(keys.regex)
        hits_re = [(re.compile(p), w, set(k)) for (p, w), k in zip(weighted, keys.keys, strict=False)]
        guard_re = [(re.compile(p), set(k)) for p, k in zip(guards, keys.keys[len(weighted) :], strict=True)]

        def one(doc: str | None) -> int | None:
            if doc is None:
                return None
            found = set(any_key.findall(doc))
            hits = [(m.start(), w) for rx, w, k in hits_re if not found.isdisjoint(k) for m in rx.finditer(doc)]
            if not hits:
                return 0
            starts = [m.start() for m in re.finditer(r"\w+|\S", doc)]
            zones = [
                (bisect_left(starts, m.end()) - 1 - window, bisect_left(starts, m.start()) + window)
                for rx, k in guard_re
                if not found.isdisjoint(k)
                for m in rx.finditer(doc)
            ]
            total = 0
            for at, weight in hits:
                token = bisect_left(starts, at)
                if not any(low <= token <= high for low, high in zones):
                    total += weight
            return total

        return text.map(one).astype("Int32")

    return score


procedure_points = guarded_hits(PROCEDURE_STRONG, PROCEDURE_BASE, RECOMMENDATION)


def screening_points(text: Column) -> Column:
    """Weighted screening-term hits over folded text, inside the JVM."""

    def points(found: Column) -> Column:
        strong = _total(text, SCREENING[0], found, SCREENING_KEYS, 0)
        return strong * 2 + _total(text, SCREENING[1], found, SCREENING_KEYS, len(SCREENING[0]))

    return bind(SCREENING_KEYS.found(text), points)


SCREENING = [[term_pattern(t) for t in terms] for terms in (SCREENING_STRONG, SCREENING_BASE)]
SCREENING_KEYS = Prefilter([*SCREENING[0], *SCREENING[1]])


def two_class_label(first: Column, second: Column, margin: int = 1, minimum: int = 2) -> Column:
    """"procedure" / "screening" by margin and minimum, else "unknown"."""
    return (
        F.when((first >= minimum) & (first >= second + margin), "procedure")
        .when((second >= minimum) & (second >= first + margin), "screening")
        .otherwise("unknown")
    )


def folded(text: Column) -> Column:
    return ascii_fold(text)


SURGICAL_PATTERN = "(?iu)(" + parted(SURGICAL_TERMS) + ")"


def surgical_terms(text: Column) -> Column:
    """All surgical-history terms found, in text order; null text gives none."""
    found = F.regexp_extract_all(text, F.lit(SURGICAL_PATTERN), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def outcome_code(label: Column) -> Column:
    """Free-text outcome label to 1 (malignant) or 0; null stays null."""
    return F.when(
        label.isNotNull(),
        F.when(F.contains(label, F.lit("benigno")), 0).when(F.contains(label, F.lit("maligno")), 1).otherwise(0),
    )


def outcome_rules(text: Column) -> Column:
    """"maligno", "benigno" or "indeterminado" from whole rule words; malignant words win."""
    plain = ascii_fold(text)
    hit = lambda ws: reduce(lambda a, b: a | b, [plain.rlike(term_pattern(w)) for w in ws])
    return (
        F.when(hit(MALIGNANT_WORDS), "maligno").when(hit(BENIGN_WORDS), "benigno").otherwise("indeterminado")
    )

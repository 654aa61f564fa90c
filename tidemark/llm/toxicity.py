"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical step writes one symbol per word: insult, threat, target, negation, reporting or
other. Composed transducers then rewrite insults and threats that are negated, reported or
aimed at someone, and a last one adds a weight for each symbol written, so that a clause is
scored by its pattern and not by single words. A document's log-odds are the weights of the paths
that its clauses take through the composed machine, added up, and a bias. The stems of the
lexicon and the machine's weights are learned from labels, with a fixed small lexicon and fixed
weights as the starting point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused
from .transducers import Transducer, after, compose, weigh

#: Labelled rows that the lexicon and the weights are learned from, at most.
FIT_ROWS = 20_000
#: Letters of a learned stem; shorter words are learned whole.
STEM_LETTERS = range(4, 9)
#: A stem is learned if it occurs in this share of the positive rows (and in 5 of them) ...
STEM_SUPPORT = 0.005
#: ... and this share of the rows that hold it are positive.
STEM_PRECISION = 0.95
#: A positive row counts towards new stems until it holds this many.
STEMS_PER_ROW = 2
#: Words, and clauses, that one task remembers; longer ones are read again each time.
REMEMBERED = 200_000
REMEMBERED_LETTERS, REMEMBERED_SYMBOLS = 40, 64

# Starting lexicon.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool filth vermin imbecile"
THREATS = "kill hurt destroy murder stab shoot strangle"
TARGETS = "you your youre u he she they them him her du dich dein ihr euch tu toi vous ton te ti usted tus ellos"
NEGATIONS = "not never no isnt arent dont nicht kein keine nie pas jamais aucun nunca ningun"
REPORTS = "said says wrote quoted claimed reported alleged sagte schrieb dit disait dijo escribio"

PLAIN, WEAK, THREAT, TARGET, NEGATION, REPORT, OTHER = b"IJTYNRo"
AIMED, AIMED_THREAT, NEGATED, REPORTED, REPEATED = b"XKnrD"
ALPHABET = b"IJTYNRo"
#: Symbols that have a weight once the patterns are known, with the weight before learning.
PATTERNS = {REPEATED: 6.0, AIMED: 5.0, PLAIN: 4.5, WEAK: 3.5, AIMED_THREAT: 4.0, THREAT: 0.5, NEGATED: 0.5, REPORTED: 0.5}
BIAS = -3.0


def grammar(weights: dict[int, float] = PATTERNS) -> Transducer:
    """Negation, reported speech, repetition, target and weights, in this order, as one machine."""
    harm = {PLAIN: NEGATED, WEAK: NEGATED, THREAT: NEGATED}
    told = {PLAIN: REPORTED, WEAK: REPORTED, THREAT: REPORTED}
    aimed = {PLAIN: AIMED, WEAK: AIMED, THREAT: AIMED_THREAT}
    machine = compose(after(bytes([NEGATION]), 2, harm), after(bytes([REPORT]), None, told), ALPHABET)
    insult = bytes([PLAIN, WEAK])
    machine = compose(machine, after(insult, None, {PLAIN: REPEATED, WEAK: REPEATED}), ALPHABET)
    machine = compose(machine, after(bytes([TARGET]), 6, aimed), ALPHABET)
    return compose(machine, weigh(weights), ALPHABET)


@dataclass(frozen=True)
class ToxicityModel:
    stems: frozenset[str]
    weights: tuple[float, ...]
    bias: float


_WORD = re.compile(r"[^\W\d_]+|[.!?;:]")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Symbols(dict):
    """Symbols of what stands between white space; '.' ends a clause."""

    def __init__(self, stems: frozenset[str]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: s for words, s in (
            (INSULTS, WEAK), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)
        ) for w in words.split()}

    def symbol(self, word: str) -> int:
        if word in self.stems or any(word[:n] in self.stems for n in STEM_LETTERS if n <= len(word)):
            return PLAIN
        return self.fixed.get(word, OTHER)

    def __missing__(self, chunk: str) -> bytes:
        made = bytes(b"."[0] if w in ".!?;:" else self.symbol(w) for w in _WORD.findall(chunk))
        if len(chunk) <= REMEMBERED_LETTERS:
            if len(self) > REMEMBERED:
                self.clear()
            self[chunk] = made
        return made


class Scorer:
    """Weights of the paths of texts' clauses through the composed machine."""

    def __init__(self, stems: frozenset[str], weights: dict[int, float] = PATTERNS):
        self.symbols = _Symbols(stems)
        self.machine = grammar(weights)
        self.seen: dict[bytes, tuple[bytes, float]] = {}

    @staticmethod
    def _target_first(clause: bytes) -> bytes:
        """A target up to two words after an insult counts as one before it."""
        return re.sub(rb"([IJT])([^YIJTNR]{0,2})Y", rb"Y\1\2", clause)

    def path(self, clause: bytes) -> tuple[bytes, float]:
        """What the machine writes for a clause and the weight of its path."""
        found = self.seen.get(clause)
        if found is None:
            found = self.machine.run(self._target_first(clause))
            if len(clause) <= REMEMBERED_SYMBOLS:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                self.seen[clause] = found
        return found

    def paths(self, text: str | None) -> Iterator[tuple[bytes, float]]:
        """The paths of all clauses that hold an insult or a threat; the others weigh nothing."""
        lines = (text or "").lower().split("\n")
        stream = b".".join(b"".join(map(self.symbols.__getitem__, line.split())) for line in lines)
        if any(s in stream for s in (PLAIN, WEAK, THREAT)):
            for clause in stream.split(b"."):
                if PLAIN in clause or WEAK in clause or THREAT in clause:
                    yield self.path(clause)

    def weight(self, text: str | None) -> float:
        """Weights of all paths of a text, added up."""
        return sum(w for _, w in self.paths(text))

    def written(self, text: str | None) -> list[int]:
        """How often the machine writes each symbol of ``PATTERNS``."""
        found: Counter[int] = Counter()
        for symbols, _ in self.paths(text):
            found.update(symbols)
        return [found[p] for p in PATTERNS]

    def counts(self, text: str | None) -> list[int]:
        """Clauses by the heaviest symbol of their path, to explain a score."""
        found = Counter(max((s for s in symbols if s in PATTERNS), key=PATTERNS.__getitem__, default=None) for symbols, _ in self.paths(text))
        return [found[p] for p in PATTERNS]


def _stems(text: str | None) -> set[str]:
    words = set(_words(text or ""))
    return {w[:n] for w in words for n in STEM_LETTERS if n <= len(w)} | {w for w in words if len(w) >= 3}


def _stem_counts(wanted: frozenset[str] | None = None):
    """toxic, text -> stem, rows: how many rows of one partition hold the stem."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(_stems(text) if wanted is None else _stems(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "rows"])

    return count


def _stems_held(wanted: frozenset[str]):
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(_stems(t) & wanted) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["stems"])

    return held


def learn_stems(rows: DataFrame) -> frozenset[str]:
    """Stems that mark the positive rows of toxic, text.

    Of the stems that are frequent and precise enough, the one that most rows still need is
    taken, again and again: words that are frequent only as copies of one toxic document are
    not needed once its insults are known. All that is collected is bounded by ``FIT_ROWS``.
    """
    positive = rows.where("toxic = 1")
    least = max(5, int(STEM_SUPPORT * positive.count()))
    often = positive.mapInArrow(_stem_counts(), "stem string, rows long").groupBy("stem").agg(F.sum("rows").alias("rows"))
    often = {r["stem"]: r["rows"] for r in often.where(F.col("rows") >= least).collect()}
    if not often:
        return frozenset()
    total = rows.mapInArrow(_stem_counts(frozenset(often)), "stem string, rows long").groupBy("stem").agg(F.sum("rows").alias("rows"))
    good = frozenset(r["stem"] for r in total.collect() if often[r["stem"]] >= STEM_PRECISION * r["rows"])
    held = [r["stems"] for r in positive.mapInArrow(_stems_held(good), "stems array<string>").collect()]
    need = [STEMS_PER_ROW] * len(held)
    holders: dict[str, list[int]] = {}
    for i, stems in enumerate(held):
        for s in stems:
            holders.setdefault(s, []).append(i)
    learned: set[str] = set()
    while holders:
        gain = {s: sum(need[i] > 0 for i in rows_) for s, rows_ in holders.items()}
        best = max(gain, key=lambda s: (gain[s], len(s), s))
        if gain[best] < least:
            break
        learned.add(best)
        for i in holders.pop(best):
            need[i] -= 1
        holders = {s: r for s, r in holders.items() if gain[s] >= least and not best.startswith(s) and not s.startswith(best)}
    return frozenset(learned)


def _fit(counts: np.ndarray, labels: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, drawn to the starting weights by a quadratic penalty.

    The log-odds are linear in the symbols written, as a path's weight is.
    """
    start = np.array([*PATTERNS.values(), BIAS])
    x = np.hstack([counts.reshape(-1, len(PATTERNS)).astype(np.float64), np.ones((len(labels), 1))])
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - labels) + pull * (w - start)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
    return w[:-1], float(w[-1])


def _counter(stems: frozenset[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in batches:
            counts = [scorer.written(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], ["toxic", "counts"])

    return count


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn the lexicon and the weights from labelled documents.

    ``labels`` has doc_id and toxic (0 or 1; other values are passed over); of more than
    ``fit_rows`` labelled ids a fixed sample by hash is used. Without labels the starting
    lexicon and weights are the model.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    picked = picked.where("toxic IN (0, 1) AND label_id IS NOT NULL").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    # at most fit_rows ids and labels are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(picked), "label_id").select("toxic", "text")
    rows = staged(rows, "toxicity-labelled")  # read three more times
    stems = learn_stems(rows)
    sample = rows.mapInArrow(_counter(stems), "toxic int, counts array<long>").toArrow()
    y = sample["toxic"].to_numpy().astype(float)
    if not len(y):
        return ToxicityModel(stems, tuple(PATTERNS.values()), BIAS)
    weights, bias = _fit(np.array(sample["counts"].to_pylist()), y)
    return ToxicityModel(stems, tuple(float(w) for w in weights), bias)


def _scores(model: ToxicityModel, at: int, name: str):
    weights = dict(zip(PATTERNS, model.weights, strict=True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.stems, weights)
        for batch in batches:
            odds = np.array([scorer.weight(t) for t in batch.column(at).to_pylist()], np.float64) + model.bias
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_score`` (see ``unused``) from 0 to 1, the last column.

    A null text scores like an empty one, a repeated row each time alike, whole texts of any
    length; an empty table gives no rows.
    """
    name = unused(docs, "_score")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(_scores(model, docs.columns.index(text), name), schema)


def in_fold(doc_id: str, parts: int, fold: int) -> Column:
    """Whether the crc32 of an id written as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == fold, F.lit(False))

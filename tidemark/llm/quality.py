"""Quality by co-training of a text-content and a page-metadata classifier.

The content view of a document is its hashed byte trigrams; the metadata view is its length,
language, source and layout. Each view has a logistic classifier. In every round both rate all
unlabelled documents, and those of which one is most confident are learned by the other. At the
end each view is calibrated on labelled documents (Platt scaling). As the views are taken to be
independent given the label, a document's log-odds are the sum of both views' calibrated ones,
less the log-odds of the labels, which both contain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unused
from .language import trigrams

#: Labelled rows that the classifiers are fitted on, at most.
FIT_ROWS = 4000
ROUNDS = 3
#: Different documents of each kind that one view names to the other per round, at most: the
#: ones of all unlabelled documents that it is surest of.
EXCHANGED = 200
CONFIDENT = 0.95
CONTENT, META = 1024, 64


def content_view(text: str | None) -> np.ndarray:
    """Hashed trigrams, folded to ``CONTENT`` places, as logarithms of normalised length."""
    v = np.log1p(trigrams(text).reshape(-1, CONTENT).sum(axis=0))
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def metadata_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Layout shares, then hashed language and source."""
    text = text or ""
    lines, words = text.split("\n"), text.split()
    n, m = max(len(text), 1), max(len(words), 1)
    layout = [
        np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 8, len(set(lines)) / len(lines),
        len(set(words)) / m, sum(map(str.isupper, words)) / m, sum(not w[-1].isalnum() for w in words) / m,
        sum(not any(map(str.isalnum, w)) for w in words) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        sum(map(len, words)) / m / 10, sum(map(str.isdigit, text)) / n,
    ]
    v = np.zeros(META, np.float32)
    v[: len(layout)] = layout
    free = META - len(layout)
    for name in (f"l{lang}", f"s{source}"):
        v[len(layout) + xxhash.xxh3_64_intdigest(name) % free] = 1
    return v


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, steps: int = 150) -> View:
    """Logistic regression by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, y = np.zeros(x1.shape[1], x.dtype), y.astype(x.dtype)  # one type: no copies of x in the products
    ahead, rate = w.copy(), x.dtype.type(4 / max(float((x1 * x1).sum(axis=1).max()), 1e-9))
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -40, 40)))
        new = ahead - rate * (x1.T @ (p - y) / x.dtype.type(len(y)) + x.dtype.type(decay) * ahead)
        ahead = new + x.dtype.type(i / (i + 3)) * (new - w)
        w = new
    return View(w[:-1].astype(float), float(w[-1]))


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    scale = max(float(np.abs(view.raw(x)).max()), 1e-9)
    fit = _logistic(view.raw(x)[:, None] / scale, y, decay=1e-3, steps=400)
    share = (y.sum() + 1) / (len(y) + 2)
    return View(view.weights, view.bias, max(float(fit.weights[0]) / scale, 0.0), fit.bias, float(np.log(share / (1 - share))))


#: What one view names to the other: views (content, meta) and the label of each row.
Named = tuple[list[np.ndarray], np.ndarray]


def co_train(views: list[np.ndarray], y: np.ndarray, confident: Callable[[list[View]], list[Named]], rounds: int = ROUNDS) -> list[View]:
    """Two classifiers over two views; the last fifth of the labelled rows calibrates them.

    ``confident`` gives the documents that the content view names, then those of the metadata view.
    """
    n = max(1, len(y) * 4 // 5)
    known = [(v[:n], y[:n]) for v in views]
    for _ in range(rounds):
        named = confident([_logistic(*k) for k in known])
        for other, (rows, label) in zip((1, 0), named, strict=True):
            known[other] = (np.vstack([known[other][0], rows[other]]), np.append(known[other][1], label))
    rest = slice(n, None) if len(y) > n else slice(None)
    return [_calibrated(_logistic(*k), v[rest], y[rest]) for k, v in zip(known, views, strict=True)]


def _viewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, h, text, lang, source -> id, h and both views in half precision."""
    for batch in batches:
        texts, langs, sources = (batch.column(i).to_pylist() for i in (2, 3, 4))
        a = [content_view(t).astype(np.float16).tobytes() for t in texts]
        b = [metadata_view(*r).astype(np.float16).tobytes() for r in zip(texts, langs, sources, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["id", "h", "content", "meta"])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)


def _rater(models: list[View]):
    """id, h, content, meta -> id, h and the log-odds that each view gives."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [pa.array(m.raw(_matrix(batch.column(i + 2), w)), pa.float64()) for i, (m, w) in enumerate(zip(models, (CONTENT, META), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *odds], ["id", "h", "z0", "z1"])

    return rate


class Pool:
    """All unlabelled documents, by their views; equal ones (h) count once.

    A call rates every one of them with both models. For each model and label, those among the
    documents not named before that it is surest of are collected: at most ``exchanged``.
    """

    def __init__(self, seen: DataFrame, labelled: DataFrame, exchanged: int, rounds: int):
        self.seen, self.labelled, self.exchanged, self.rounds = seen, labelled, exchanged, rounds
        self.taken: set[int] = set()

    def surest(self, models: list[View]) -> list[list[tuple[int, float]]]:
        """Per model, (h, label) of the documents it names."""
        rated = self.seen.mapInArrow(_rater(models), "id long, h long, z0 double, z1 double")
        rated = rated.join(self.labelled, "id", "left_anti").groupBy("h").agg(F.max("z0").alias("z0"), F.max("z1").alias("z1"))
        rated = staged(rated, "quality-odds")
        least = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        # so many that enough are left whatever was named before: a fixed number
        most = self.exchanged * 4 * self.rounds
        kinds = [(one, label) for one in (0, 1) for label in (1.0, 0.0)]
        sure = {k: F.col(f"z{k[0]}") * (1 if k[1] else -1) for k in kinds}
        tops = [
            rated.where(sure[k] >= least).orderBy(sure[k].desc(), "h").limit(most)
            .select(F.lit(i).alias("kind"), "h", sure[k].alias("sure"))
            for i, k in enumerate(kinds)
        ]
        found = tops[0].union(tops[1]).union(tops[2]).union(tops[3]).collect()
        named: list[list[tuple[int, float]]] = [[], []]
        for i, (one, label) in enumerate(kinds):
            best = sorted((-r["sure"], r["h"]) for r in found if r["kind"] == i and r["h"] not in self.taken)[: self.exchanged]
            self.taken.update(h for _, h in best)
            named[one] += [(h, label) for _, h in best]
        return named

    def __call__(self, models: list[View]) -> list[Named]:
        named = self.surest(models)
        wanted = [h for part in named for h, _ in part]  # at most 4 * exchanged
        rows = self.seen.where(F.col("h").isin(wanted)).groupBy("h").agg(F.min("content").alias("content"), F.min("meta").alias("meta")).toArrow()
        at = {h: i for i, h in enumerate(rows["h"].to_pylist())}
        views = [_matrix(rows["content"], CONTENT), _matrix(rows["meta"], META)]
        return [([v[[at[h] for h, _ in part]] for v in views], np.array([label for _, label in part])) for part in named]


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exchanged: int = EXCHANGED) -> list[View]:
    """Learn from labelled documents (labels: doc_id, quality 0 or 1) and all unlabelled ones.

    Of more than ``fit_rows`` labelled ids a fixed sample by hash is used; unlabelled documents
    (ids without a label, or null) are rated whole and all, in every round. Without labels of both
    kinds the score is one half for all.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL")
    picked = marked.where("quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = rows.select("id", F.xxhash64("text", "lang", "source").alias("h"), "text", "lang", "source")
    # the texts are read once; rounds read some 2 KB a document
    seen = staged(rows.mapInArrow(_viewer, "id long, h long, content binary, meta binary"), "quality-views")
    # at most fit_rows ids are broadcast
    table = seen.join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", "h").select("quality", "content", "meta").toArrow()
    quality = table["quality"].to_numpy() if len(table) else np.empty(0)
    if len(np.unique(quality)) < 2:
        return [View(np.zeros(CONTENT), 0.0), View(np.zeros(META), 0.0)]
    views = [_matrix(table["content"], CONTENT), _matrix(table["meta"], META)]
    return co_train(views, quality.astype(float), Pool(seen, marked.select("id").distinct(), exchanged, ROUNDS))


def _scorer(models: list[View], at: tuple[int, int, int], names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = (batch.column(i).to_pylist() for i in at)
            a = models[0].odds(np.array([content_view(t) for t in texts]).reshape(-1, CONTENT))
            b = models[1].odds(np.array([metadata_view(*r) for r in zip(texts, langs, sources, strict=True)]).reshape(-1, META))
            p = [1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (a, b, a + b - models[0].prior)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in p)], [*batch.schema.names, *names])

    return score


def score_quality(docs: DataFrame, models: list[View], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs``, then the views' scores _content and _meta and the joint _score (see ``unused``).

    Scores are probabilities of good quality; null text, language or source count as empty.
    Repeated rows are each scored alike, texts are read whole; an empty table gives no rows.
    """
    rows = docs.withColumns({lang: F.col(lang).cast("string"), source: F.col(source).cast("string")})
    names = [unused(docs, c) for c in ("_content", "_meta", "_score")]
    schema = rows.withColumns({c: F.lit(0.0) for c in names}).schema
    at = tuple(rows.columns.index(c) for c in (text, lang, source))
    return rows.mapInArrow(_scorer(models, at, names), schema)

"""Language identification by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed byte trigrams. The documents of each
language are clustered by spherical k-means; a text goes to the language of the centroid with
the largest cosine. A text that is further from it than almost all documents of that language
were is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from .common import unused

#: Hashed trigrams.
DIMS = 4096
#: Documents that the centroids of one language are fitted on, at most.
FIT_ROWS = 400
CENTROIDS = 3
#: A text is rejected below this share of the smallest cosine of the language's own documents.
SLACK = 0.8
UNKNOWN = "und"

# Everything in ASCII that is not a letter separates words.
_FOLD = np.array([i if i > 127 or chr(i).isalpha() else 32 for i in range(256)], np.uint64)


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of the lower-cased text, runs of separators as one."""
    data = _FOLD[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])]
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(DIMS)
    return np.bincount(slot.astype(np.int64), minlength=DIMS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # its language
    floor: np.ndarray  # smallest accepted cosine per language


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[:DIMS] += trigrams(text.as_py()) > 0
            total[DIMS] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], ["slot", "n"])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from far-apart starting vectors."""
    centres = [vectors.mean(axis=0)]
    for _ in range(min(k, len(vectors))):
        centres.append(vectors[np.argmin(np.max(vectors @ np.array(centres).T, axis=1))])
    centroids = np.array(centres[1:])
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.array([vectors[nearest == i].mean(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        norms = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids = centroids / np.where(norms > 0, norms, 1)
    return centroids


def _fitter(idf: np.ndarray):
    def fit(table: pa.Table) -> pa.Table:
        vectors = np.array([_vector(trigrams(t), idf) for t in table["text"].to_pylist()])
        centroids = _clusters(vectors, CENTROIDS)
        floor = float((vectors @ centroids.T).max(axis=1).min())
        n = len(centroids)
        return pa.table({
            "lang": [table["lang"][0].as_py()] * n, "centroid": pa.array(centroids.astype(np.float32).tolist(), pa.list_(pa.float32())), "floor": [floor] * n,
        })

    return fit


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from text and lang; rows without a language are passed over.

    Document frequencies cover all rows; each language's centroids are fitted on a fixed
    sample of ``fit_rows`` different texts, those with the smallest hashes. The model holds ``CENTROIDS`` vectors per language.
    """
    rows = docs.where("lang IS NOT NULL").select("lang", "text")
    found = rows.select("text").mapInArrow(_document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(DIMS + 1)
    for r in found:
        frequency[r["slot"]] = r["n"]
    idf = np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1
    # one row per text: copies neither crowd a sample nor thin it out
    hashed = rows.select("lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    drawn = hashed.select("lang", "at").distinct().withColumn("n", lowest).where(F.col("n") <= fit_rows).select("lang", "at")
    sample = hashed.join(drawn, ["lang", "at"]).groupBy("lang", "at").agg(F.min("text").alias("text")).select("lang", "text")
    model = sample.groupBy("lang").applyInArrow(_fitter(idf), "lang string, centroid array<float>, floor double").collect()
    languages = sorted({r["lang"] for r in model})
    place = {name: i for i, name in enumerate(languages)}
    rows_ = sorted(model, key=lambda r: (r["lang"], r["centroid"]))
    floor = np.zeros(len(languages))
    for r in rows_:
        floor[place[r["lang"]]] = r["floor"] * SLACK
    centroids = np.array([r["centroid"] for r in rows_], np.float64).reshape(-1, DIMS)
    return LanguageModel(idf, languages, centroids, np.array([place[r["lang"]] for r in rows_], np.int64), floor)


def _identifier(model: LanguageModel, at: int, names: list[str]):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                if not text or not len(model.languages) or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosines = model.centroids @ _vector(trigrams(text), model.idf)
                best = int(np.argmax(cosines))
                langs.append(model.languages[model.owner[best]])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
                rejected.append(bool(cosines[best] < model.floor[model.owner[best]]))
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return identify


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then _lang, _score (cosine, 0 to 1) and _rejected (see ``unused``).

    A text that is null or has no letter is ``und`` with score 0; so is every text when no
    language was learned. Other texts always get the nearest language, also when rejected.
    Repeated rows are each predicted alike, texts are read whole; an empty table gives no rows.
    """
    names = [unused(docs, c) for c in ("_lang", "_score", "_rejected")]
    schema = docs.withColumns(dict(zip(names, (F.lit(""), F.lit(0.0), F.lit(True)), strict=True))).schema
    for field in schema.fields:
        field.nullable = True
    return docs.mapInArrow(_identifier(model, docs.columns.index(text), names), schema)

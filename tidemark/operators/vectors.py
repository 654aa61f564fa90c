"""Text vectors (TF-IDF) and history vectors (plain or time-weighted means)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


BLOCK_DAYS = 4096
INDEX_ROWS = 512


# ------------------------------------------------------------------ TF-IDF
def terms(text: Column, stop_words: Sequence[str], ngrams: tuple[int, int] = (1, 1)) -> Column:
    """Lower-case word n-grams; words have at least two characters and are no stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop_words))

    def grams(toks: Column) -> Column:
        parts = [toks] if ngrams[0] == 1 else []
        for n in range(max(2, ngrams[0]), ngrams[1] + 1):
            at = F.filter(F.transform(toks, lambda _, i: i), lambda i: i + n <= F.size(toks))
            parts.append(F.transform(at, lambda i: F.array_join(F.slice(toks, i + 1, F.lit(n)), " ")))
        return F.concat(*parts)

    return F.get(F.transform(F.array(tokens), grams), F.lit(0))


def term_counts(docs: DataFrame, doc_id: str, text: str, stop_words: Sequence[str], ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(doc, term, tf).

    The texts are shuffled by document before they become terms, so that neither these counts nor
    sums per document shuffle terms, and two uses of the counts share that shuffle.
    """
    placed = docs.select(doc_id, text).repartition(doc_id)
    exploded = placed.select(doc_id, F.explode(terms(F.col(text), stop_words, ngrams)).alias("term"))
    return exploded.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(
    counts: DataFrame, n_docs: Column, *, min_df: int = 5, max_df: float = 1.0, max_features: int | None = None
) -> DataFrame:
    """Vocabulary (term, df, idf): document-frequency limits, then, if asked for, the most frequent terms."""
    per = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = per.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))
    top = kept if max_features is None else kept.orderBy(F.desc("total"), "term").limit(max_features)
    return top.select("term", "df", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def apply_tfidf(counts: DataFrame, vocabulary: DataFrame, doc_id: str, *, sublinear: bool = True) -> DataFrame:
    """(doc, term, weight): scaled and normalised to length 1.

    A vocabulary within the session's broadcast limit moves no documents; beyond it Spark
    shuffles both sides.
    """
    tf = (F.log(F.col("tf")) + 1) if sublinear else F.col("tf").cast("double")
    raw = counts.join(vocabulary.select("term", "idf"), "term").select(doc_id, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return raw.select(doc_id, "term", (F.col("w") / norm).alias("weight"))


def hashed_vectors(docs: DataFrame, doc_id: str, text: str, stop_words: Sequence[str], dim: int = 64) -> DataFrame:
    """Dense vectors of hashed term frequencies, computed per row without a vocabulary."""
    slot = F.transform(terms(F.col(text), stop_words), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    tally = F.aggregate(
        slot, F.array_repeat(F.lit(0.0), dim),
        lambda acc, s: F.transform(acc, lambda v, i: F.when(i == s, v + 1.0).otherwise(v)),
    )
    return docs.select(doc_id, tally.alias("vector"))


def embed_documents(docs: DataFrame, doc_id: str, vectorise, schema: str) -> DataFrame:
    """Any encoder of the user's own: ``vectorise`` maps batches of (id, text) frames to ``schema``."""
    return docs.mapInPandas(vectorise, schema)


def pool_mean(chunks: DataFrame, doc_id: str, vector: str) -> DataFrame:
    """Mean vector of the chunks of a document."""
    pooled = chunks.groupBy(doc_id).agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("v"), F.count(F.lit(1)).alias("n_chunks"))
    return pooled.select(doc_id, "n_chunks", vector_to_array("v").alias(vector))


def pool_concat(chunks: DataFrame, doc_id: str, chunk_no: str, vector: str) -> DataFrame:
    """Chunk vectors of a document, one after the other."""
    ordered = F.array_sort(F.collect_list(F.struct(chunk_no, vector)))
    return chunks.groupBy(doc_id).agg(F.flatten(F.transform(ordered, lambda c: c[vector])).alias(vector))


# ------------------------------------------------------------------ history vectors
def _weights(how: str, gap: np.ndarray, span: np.ndarray, lam: float) -> np.ndarray:
    if how == "mean":
        return np.ones_like(gap)
    if how == "exponential":
        return np.exp(-lam * gap)
    if how == "inverse":
        return 1.0 / (1.0 + gap)
    if how == "linear":
        return np.clip(1.0 - gap / np.where(span > 0, span, 1.0)[:, None], 0.0, 1.0)
    raise ValueError(f"unknown weighting {how!r}")


def _sum_runs(keys: Sequence[str], extras: Sequence[str], vector: str):
    """mapInArrow function: element-wise sums over runs of equal keys in sorted input.

    One summed row is kept between batches, so a run may be of any length.
    """

    def reduce_runs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        starts = np.concatenate([[0], _changes(table, keys) + 1])
        values = table[vector].combine_chunks()
        matrix = values.flatten().to_numpy().reshape(table.num_rows, -1)
        total = np.add.reduceat(matrix, starts, axis=0)
        offsets = np.arange(len(starts) + 1, dtype=np.int32) * total.shape[1]
        columns = {k: table[k].take(pa.array(starts)) for k in keys}
        columns |= {e: pa.array(np.add.reduceat(table[e].to_numpy(), starts)) for e in extras}
        columns[vector] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
        return pa.Table.from_arrays([columns[n] for n in table.column_names], names=table.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            # vectors are moved as they are stored, and added up as doubles
            at = table.schema.get_field_index(vector)
            table = table.set_column(at, vector, table[vector].cast(pa.list_(pa.float64())))
            if carry is not None:
                table = pa.concat_tables([carry.cast(table.schema), table])
            summed = reduce_runs(table)
            yield from summed.slice(0, summed.num_rows - 1).combine_chunks().to_batches()
            carry = summed.slice(summed.num_rows - 1)
        if carry is not None:
            yield from carry.combine_chunks().to_batches()

    return run


def sum_vectors(rows: DataFrame, keys: Sequence[str], extras: Sequence[str], vector: str) -> DataFrame:
    """Element-wise sum (of doubles) of equally long arrays, and of ``extras``, per key."""
    return _sum_placed(rows.select(*keys, *extras, vector).repartition(*keys), keys, extras, vector)


def _sum_placed(rows: DataFrame, keys: Sequence[str], extras: Sequence[str], vector: str) -> DataFrame:
    """``sum_vectors`` of rows whose equal keys are in one partition already."""
    wide = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(f.name, wide if f.name == vector else f.dataType) for f in rows.schema])
    return rows.sortWithinPartitions(*keys).mapInArrow(_sum_runs(keys, extras, vector), schema)


def _tile_sums(keys: Sequence[str], entity: str, how: str, lam: float):
    """mapInArrow function: weighted sums per index day for tiles that arrive sorted.

    A tile is a run of equal keys: its past days first, then its index days, at most one
    row per calendar day of the block.  Only an unfinished tile is kept between batches.
    """

    def sums(table: pa.Table) -> pa.RecordBatch:
        col = {n: table[n].combine_chunks() for n in table.column_names}
        kind, d = col["kind"].to_numpy(), col["d"].to_numpy().astype(float)
        lo = col["lo"].fill_null(-(10**7)).to_numpy().astype(float)
        span, n = col["span"].fill_null(0).to_numpy().astype(float), col["n"].to_numpy().astype(float)
        dim = int(pc.max(pc.list_value_length(col["v"])).as_py() or 0)
        flat = col["v"].flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((0, 0))
        vector_row = np.cumsum(kind == 0) - 1
        edges = [0, *(_changes(table, keys) + 1).tolist(), table.num_rows]
        at, w, days, out = [], [], [], []
        for start, stop in zip(edges[:-1], edges[1:]):
            split = start + int(np.searchsorted(kind[start:stop], 1))
            if split in (start, stop):
                continue
            past = flat[vector_row[start] : vector_row[start] + split - start]
            for ask in range(split, stop, INDEX_ROWS):
                end = min(ask + INDEX_ROWS, stop)
                gap = d[ask:end, None] - d[None, start:split]
                mask = (gap >= 0) & (d[None, start:split] >= lo[ask:end, None])
                weight = np.where(mask, _weights(how, np.maximum(gap, 0.0), span[ask:end], lam), 0.0)
                count = weight * n[None, start:split]
                hit = np.flatnonzero(mask.any(axis=1))
                at.append(ask + hit)
                w.append(count.sum(axis=1)[hit])
                days.append((count * gap).sum(axis=1)[hit])
                out.append((weight @ past)[hit])
        rows = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        values = np.concatenate(out).ravel() if out else np.zeros(0)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * dim
        return pa.RecordBatch.from_arrays(
            [
                col[entity].take(pa.array(rows)), pa.array(d[rows].astype(np.int32)),
                pa.array(np.concatenate(w) if w else np.zeros(0)), pa.array(np.concatenate(days) if days else np.zeros(0)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ],
            names=[entity, "d", "w", "days", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            ends = _changes(table, keys)
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield sums(table.slice(0, cut))
            carry = table.slice(cut)
        if carry is not None and carry.num_rows:
            yield sums(carry)

    return run


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers whose next row has another key."""
    differs = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        values = table[k].to_numpy()
        differs |= values[1:] != values[:-1]
    return np.flatnonzero(differs)


def history_vectors(
    index: DataFrame, vectors: DataFrame, entity: str, ts: str, vector: str, *,
    how: str = "mean", lam: float = 0.001, months: int | None = None,
) -> DataFrame:
    """One vector per (entity, index date): the weighted mean of vectors dated <= that date.

    ``vectors``: (entity, date, array).  ``how`` is mean, exponential, inverse or linear; a
    plain mean gets the mean days before the index appended.  ``months`` limits the look-back
    (0 = the index date only).  Vectors are first summed per (entity, day), which spreads a
    busy entity over its days.  Index days then meet past days in calendar blocks of about
    eleven years, inside matrix products: a block holds at most one row per day, so a task holds
    a bounded block at a time, and no (index, past) pair becomes a row.  An entity's blocks, at most
    one row per calendar day in all, lie in one partition, so that their sums need no shuffle.
    """
    day = F.col(ts).cast("date")
    kept = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    raw = vectors.where(F.col(vector).isNotNull()).select(
        entity, day.alias("day"), F.lit(1).cast("bigint").alias("n"), kept.alias("v")
    )
    daily = sum_vectors(raw, [entity, "day"], ["n"], "v")
    block = F.floor(F.unix_date("day") / BLOCK_DAYS).cast("int")
    low = F.lit(None).cast("date") if months is None else (F.col("day") if months == 0 else F.add_months("day", -months))
    points = index.select(entity, day.alias("day")).distinct().withColumn("low", low)
    spans = raw.groupBy(entity, block.alias("block")).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    if how == "linear":
        points = _with_span(points, raw, entity)
    else:
        points = points.withColumn("span", F.lit(None).cast("int"))
    asks = points.join(spans, entity).where(
        (F.col("first") <= F.col("day")) & (F.col("low").isNull() | (F.col("last") >= F.col("low")))
    )
    keys = [entity, "block"]
    nothing, no_int = F.array().cast("array<double>"), F.lit(None).cast("int")
    rows = daily.select(
        entity, block.alias("block"), F.lit(0).alias("kind"), F.unix_date("day").alias("d"), no_int.alias("lo"), no_int.alias("span"), "n", "v"
    ).unionByName(
        asks.select(
            *keys, F.lit(1).alias("kind"), F.unix_date("day").alias("d"), F.unix_date("low").alias("lo"), "span",
            F.lit(0).cast("bigint").alias("n"), nothing.alias("v"),
        )
    )
    schema = T.StructType([
        T.StructField(entity, index.schema[entity].dataType), T.StructField("d", T.IntegerType()),
        T.StructField("w", T.DoubleType()), T.StructField("days", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType())),
    ])
    parts = rows.repartition(entity).sortWithinPartitions(*keys, "kind", "d").mapInArrow(_tile_sums(keys, entity, how, lam), schema)
    summed = _sum_placed(parts, [entity, "d"], ["w", "days"], "v")
    mean = F.transform("v", lambda x: F.when(F.col("w") > 0, x / F.col("w")).otherwise(0.0))
    if how == "mean":
        mean = F.concat(mean, F.array(F.col("days") / F.col("w")))
    return summed.select(entity, F.date_from_unix_date("d").alias(ts), mean.alias(vector))


def _with_span(points: DataFrame, past: DataFrame, entity: str) -> DataFrame:
    """Days from each index day back to the first past day in reach (for linear decay)."""
    marks = past.select(entity, "day").distinct().withColumn("past", F.col("day")).unionByName(
        points.select(entity, F.coalesce("low", F.lit("0001-01-01").cast("date")).alias("day")).withColumn("past", F.lit(None).cast("date"))
    )
    ahead = Window.partitionBy(entity).orderBy("day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    first = marks.withColumn("first", F.min("past").over(ahead)).select(entity, F.col("day").alias("_low"), "first").distinct()
    joined = points.withColumn("_low", F.coalesce("low", F.lit("0001-01-01").cast("date"))).join(first, [entity, "_low"], "left")
    return joined.withColumn("span", F.datediff("day", "first")).drop("_low", "first")

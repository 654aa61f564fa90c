"""Removal of byte strings of a minimum length that occur more than once in the corpus.

Windows of the minimum length are cut into runs with a common anchor (see ``superkmers``); equal
windows are in runs of equal anchors. Runs with equal bytes are settled by their hash. The other
runs of anchors that occur more than once are sent, one example of each content, to the block
of their anchor, where the Burrows-Wheeler transform of the block is searched for windows that
occur more than once by threshold-bounded interval expansion (see ``bwt``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_windows
from .common import staged, text_or_empty
from .superkmers import runs

LENGTH = 400
#: Bytes of run contents in one block, on average.
BLOCK_BYTES = 2_000_000
#: Contents of one anchor that one task takes; the windows of larger groups are grouped by hash.
GROUP_CONTENTS = 16_384


def _run_cutter(length: int):
    """doc_id, text_key, text -> doc_id, text_key, anchor, content, first, last."""
    names = ["doc_id", "text_key", "anchor", "content", "first", "last"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                anchor, first, last = runs(np.frombuffer(data, np.uint8), length)
                content = [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                rows.append(np.full(len(first), i))
                parts.append((anchor, np.array(content, np.uint64).view(np.int64), first, last))
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in columns)], names)

    return cut


def _block_search(length: int):
    def search(table: pa.Table) -> pa.Table:
        contents = table["bytes"].to_pylist()
        found = repeated_windows(contents, length)
        at = pa.array([f[0] for f in found], pa.int64())
        return pa.table({
            "anchor": table["anchor"].take(at), "content": table["content"].take(at),
            "from": pa.array([f[1] for f in found], pa.int64()), "to": pa.array([f[2] for f in found], pa.int64()),
        })

    return search


def _window_hashes(length: int):
    """anchor, content, bytes -> a row per window: content's keys, start and 128-bit hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(2).to_pylist()):
                n = len(data) - length + 1
                at = pa.array(np.full(n, i))
                hashes = [xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.arange(n)), pa.array(hashes, pa.binary())],
                    ["anchor", "content", "from", "window"],
                )

    return explode


def _remover(length: int):
    """doc_id, text_key, text, starts -> counts, the hash of what is left, and the spans."""
    names = ["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "spans"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, hashes, all_spans = [], [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, b in sorted((s["first"], s["last"] + length) for s in starts):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, end = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[end:a])
                    end = b
                kept.update(data[end:])
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                hashes.append(kept.hexdigest())
                all_spans.append(spans)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                pa.array(hashes, pa.string()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))),
            ], names)

    return remove


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["d"]) & (a["text_key"] == b["t"])


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, *, doc_id: str = "doc_id", text: str = "text", group_contents: int = GROUP_CONTENTS,
) -> DataFrame:
    """Repeated bytes of every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte of a text (UTF-8; null counts as empty) is removed if a ``length``-byte string that
    covers it starts anywhere else, in any row or in the same one; overlaps count. ``spans``
    are the maximal removed byte ranges. Repeated rows repeat their text and are removed like
    other copies. Texts shorter than ``length`` keep all bytes. Other columns are not read.
    """
    key = F.xxhash64(text_or_empty(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("text_key"), text_or_empty(text).alias("text"))
    cut = staged(
        rows.mapInArrow(_run_cutter(length), "doc_id long, text_key long, anchor long, content long, first long, last long"), "runs",
    )
    anchors = cut.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike"))
    shared = staged(cut.join(anchors, "anchor"), "shared-runs")
    example = F.min(F.struct("doc_id", "text_key", "first", "last")).alias("e")
    classes = staged(shared.groupBy("anchor", "content", "alike").agg(F.count("*").alias("n"), example), "run-contents")

    # texts that have a shared run: the rest of the work is on these
    touched = shared.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    texts = staged(rows.join(touched, _same(rows, touched), "left_semi").dropDuplicates(["doc_id", "text_key"]), "shared-texts")

    examples = classes.where("NOT alike").select("anchor", "content", F.col("e.doc_id").alias("d"), F.col("e.text_key").alias("t"), "e.first", "e.last")
    size = F.col("last") - F.col("first") + length
    sizes = examples.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, int(sizes / BLOCK_BYTES))
    crowded = examples.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > group_contents).select("anchor")
    content = F.substring(F.encode("text", "UTF-8"), (F.col("first") + 1).cast("int"), size.cast("int"))
    part = examples.join(texts, _same(texts, examples)).select("anchor", "content", content.alias("bytes"))
    part = staged(part, "run-examples")
    found = (
        part.join(crowded, "anchor", "left_anti").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
        .groupBy("block").applyInArrow(_block_search(length), "anchor long, content long, from long, to long")
    )
    windows = part.join(crowded, "anchor").mapInArrow(_window_hashes(length), "anchor long, content long, from long, window binary")
    often = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    found = staged(found.union(windows.join(often, "window").select("anchor", "content", "from", F.col("from").alias("to"))), "repeated-windows")

    # contents that occur more than once are removed whole; of the others, what was found
    several = classes.where("n > 1").select("anchor", "content")
    whole = shared.join(several, ["anchor", "content"]).select("doc_id", "text_key", "first", "last")
    single = classes.where("n = 1").select("anchor", "content", "e")
    partly = found.join(single, ["anchor", "content"]).select(
        "e.doc_id", "e.text_key", (F.col("e.first") + F.col("from")).alias("first"), (F.col("e.first") + F.col("to")).alias("last")
    )
    starts = whole.union(partly).groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    removed = texts.join(starts, _same(texts, starts)).select("doc_id", "text_key", "text", "starts").mapInArrow(
        _remover(length), "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
    removed = removed.withColumnsRenamed({"doc_id": "d", "text_key": "t", "kept_sha256": "left_sha256"})
    slim = rows.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    none = F.array().cast("array<array<long>>")
    return slim.join(removed, _same(slim, removed), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )

"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are put into reciprocal-capacity classes: class k holds pieces of at most
``capacity // k`` tokens, and k of them fill a sequence. A document gives full sequences and a
tail; a tail that would leave more than ``TOLERANCE`` of its place empty is cut to a smaller
class's full place, and so on. Every scan partition fills the sequences of its classes alone.
The few pieces that fill no sequence there are filled among groups of partitions, then of
groups; what is left at the end, fewer than k pieces per class, is packed by decreasing length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 4096
#: Classes 1, 2, ... 64 pieces to a sequence, then powers of two.
FINE = 64
TOLERANCE = 1 / 64
END_ID = 2
#: Partitions that share their left-over pieces at each level.
FAN_IN = 32
#: Words of a generation of a worker's memory. It holds two: words that are met again pass into the new one, the old one goes.
REMEMBERED = 500_000

#: Marks that the tokeniser's pattern splits off a word's end.
MARKS = b".,;:!?|*$%&)"
_MARK = re.compile(rb"[.,;:!?|*$%&)](?<=[a-z].)")
#: Bytes of the texts that are tokenised in one go; a longer text is tokenised alone.
PART_BYTES = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, worker int, row long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_class(length: int, capacity: int = CAPACITY) -> int:
    """Largest class whose places hold a piece of this length."""
    k = capacity // length
    return k if k <= FINE else 1 << (k.bit_length() - 1)


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Pieces of a document: (start, length, class)."""
    pieces, start = [], 0
    while tokens - start >= capacity:
        pieces.append((start, capacity, 1))
        start += capacity
    while start < tokens:
        rest = tokens - start
        k = piece_class(rest, capacity)
        place = capacity // k
        if place - rest > TOLERANCE * place:
            k = k + 1 if k < FINE else 2 * k
            rest = capacity // k
        pieces.append((start, rest, k))
        start += rest
    return pieces


class _Ids(dict):
    """Packed little-endian ids of a word; words between white space are tokenised alone."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges for a-z, which the file's normaliser and pattern leave as they are.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        #: Tokens that are found in the text as it is written, before its letters become small.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_parts(self, parts: list[str], tokenizer=None) -> list[bytes]:
        """Ids of letter runs and marks, many in one call: each of them ends with an end-of-word token."""
        out: list[bytes] = []
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = np.array((tokenizer or self.tokenizer).encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(to) == len(some):
                packed = ids.tobytes()
                out += [packed[i:j] for i, j in zip([0, *to[:-1]], to, strict=True)]
            else:
                out += self.encode(some)
        return out

    def learn(self, words: list[bytes]) -> None:
        """Add the ids of new words; a word of plain letters and its end mark are learned apart, letters that are known as a word are not."""
        small = [w for w in words if w.isalpha() and w.islower()]  # a-z alone
        self.update(zip(small, self.encode_parts([w.decode() for w in small], self.letters), strict=True))
        cores: dict[bytes, tuple[bytes, bytes]] = {}
        whole = []
        for w in set(words).difference(small):
            core = w.rstrip(MARKS)
            text = core.decode("utf-8", "replace")
            # letters of the Latin blocks that lower-case alike everywhere; the pattern splits the mark off
            if not core or text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                cores[w] = (text.lower().encode(), w[len(core) :])
            else:
                whole.append(w)
        needed = set().union(*cores.values())
        ids = {p: self[p] for p in needed if p in self}
        ids[b""] = b""
        new = sorted(needed.difference(ids))
        ids.update(zip(new, self.encode_parts([p.decode() for p in new]), strict=True))
        self.update(zip(whole, self.encode([w.decode("utf-8", "replace") for w in whole]), strict=True))
        self.update({w: ids[a] + ids[b] for w, (a, b) in cores.items()})


_REMEMBER: dict[str, _Ids] = {}


def _marked(text: str | None, added: list[bytes]) -> bytes:
    """The text with A-Z in lower case and the marks after a letter apart, so that words that have the same ids are one."""
    raw = (text or "").encode("utf-8", "replace")
    # a combining mark may compose with a small letter only; added tokens are found as they are written
    if b"\xcc" in raw or b"\xcd" in raw or any(a in raw for a in added):
        return raw
    return _MARK.sub(rb" \g<0>", raw.lower())


def _names(words: pa.LargeStringArray) -> list[bytes]:
    if not len(words):
        return []
    _, place, data = words.buffers()
    at = np.frombuffer(place, "i8", len(words) + 1, 8 * words.offset).tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def token_bytes(texts: list[str | None], tokenizer: str) -> list[bytes]:
    """Ids of every text as packed unsigned 32-bit numbers; null counts as empty."""
    if tokenizer not in _REMEMBER:
        _REMEMBER[tokenizer] = _Ids(tokenizer)
    known = _REMEMBER[tokenizer]
    marked = pa.array([_marked(text, known.added) for text in texts], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(marked)
    coded = lists.flatten().dictionary_encode()
    # each word of the texts is looked up once
    names = _names(coded.dictionary)
    found = list(map(known.get, names))
    missing = [i for i, ids in enumerate(found) if ids is None and names[i]]
    new = []
    for i in missing:
        ids = known.older.get(names[i])
        if ids is None:
            new.append(names[i])
        else:
            known[names[i]] = ids
    known.learn(new)
    for i in missing:
        found[i] = known[names[i]]
    # the empty word before or after a text's white space has no ids
    ids = pa.array([b or b"" for b in found], pa.large_binary()).take(coded.indices)
    if len(known) > REMEMBERED:
        known.older = dict(known)
        known.clear()
    if not len(ids):
        return [b""] * len(texts)
    _, place, data = ids.buffers()
    place = np.frombuffer(place, "i8", len(ids) + 1, 8 * ids.offset)
    at = place[np.cumsum([0, *pc.list_value_length(lists).to_pylist()])].tolist()
    data = memoryview(data) if data else b""
    return [bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _piecer(tokenizer: str | None, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, worker, row = tokenizer or default_tokenizer(), TaskContext.get().partitionId(), 0
        pa.default_memory_pool().release_unused()  # what earlier tasks left in this worker
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at, rows = 0, []
            while at < batch.num_rows:
                # the words of a part are objects, so a part is bounded by its bytes
                to = max(at + 1, min(at + 256, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES))))
                part = batch.slice(at, to - at)
                for doc, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1).to_pylist(), path), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start, length, k in cut(n, capacity):
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, worker, row))
                        row += 1
                at = to
                if len(rows) > 10_000 or at == batch.num_rows:
                    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])
                    rows = []

    return pieces


def _by_length(capacity: int):
    """Grouped map over the last pieces: first fit by decreasing length."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "worker", "row"], ascending=[False, True, True], ignore_index=True)
        free: list[int] = []
        at, offset = [], []
        for n in rows["length"]:
            b = next((i for i, f in enumerate(free) if f >= n), len(free))
            if b == len(free):
                free.append(capacity)
            at.append(b)
            offset.append(capacity - free[b])
            free[b] -= n
        rows["sequence_id"], rows["offset"] = np.array(at, "int64") + (15 << 59), np.array(offset, "int64")
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their place among those of the class in the same group of partitions."""
    group = Window.partitionBy("worker", "cls")
    return pieces.withColumn("n", F.count("*").over(group)).withColumn("rank", F.row_number().over(group.orderBy("sub", "row")) - 1)


def pack_documents(
    docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of all documents and their place in sequences of at most ``capacity`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset, a row per
    piece. Ids are those of the tokenizer file without special tokens, then id 2; a null or
    empty text is the end id alone. Repeated rows are packed each on its own; an empty table
    gives no rows; other columns are not read. The scan's splits fix the layout, so a rerun
    over the same files gives the same sequences.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(_piecer(tokenizer, capacity), PIECES).withColumn("sub", F.lit(0))
    left, level, filled = staged(_ranked(pieces), "pieces-0"), 0, []
    full = F.col("rank") < F.col("n") - F.col("n") % F.col("cls")
    while True:
        filled.append(left.where(full).withColumn("level", F.lit(level)))
        rest = left.where(~full)
        if (rest.agg(F.max("worker")).first()[0] or 0) == 0:
            break
        up = rest.drop("n", "rank").withColumn("sub", F.col("worker")).withColumn("worker", F.floor(F.col("worker") / FAN_IN).cast("int"))
        left, level = staged(_ranked(up), f"pieces-{level + 1}"), level + 1
    placed = filled[0]
    for more in filled[1:]:
        placed = placed.unionByName(more)
    # level, partition group, class and number make the id: 4 + 24 + 13 + 22 bits
    number = F.floor(F.col("rank") / F.col("cls"))
    sequence = F.shiftleft(F.col("level").cast("long"), 59).bitwiseOR(F.shiftleft(F.col("worker").cast("long"), 35)).bitwiseOR(
        F.shiftleft(F.col("cls").cast("long"), 22)
    ).bitwiseOR(number.cast("long"))
    inside = Window.partitionBy("worker", "cls", "level", "number").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    done = placed.withColumn("number", number).select(
        *columns, sequence.alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")
    )
    # at most (k - 1) pieces of each class, however many documents there are
    last = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _by_length(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return done.union(last)

"""Log-probability of texts under a causal self-attention model on subword ids.

A text is its words (between white space, A-Z lower-cased) and one end. Each word is tokenised
by itself with a leading blank, so a subword that holds the blank begins a word and all others
go on with it. The attention model (``attention``) gives every next subword's class, counts of
the whole training corpus its share inside the class. The probability of a word is that of its
subwords and of the word ending there. It is interpolated with the share that the corpus's
word counts give a known word; the weight of the two is fitted by leaving a word's own
occurrence out of its count.

Everything comes from all training texts: word counts, subword counts, the successions of
subwords inside words (the prior), the attention's parameters and the weights. The texts are
dealt out to shards by hash. After the first steps, taken on one shard, each shard is learned
from once, from its first to its last text, and the shards' parameters are averaged. How the
words of a step were foreseen before it gives the weights.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import staged

#: Steps on one shard before all shards are learned from, bytes of words of a shard, blocks of a step and the rate at a shard's start.
STEPS = 400
SHARD_BYTES = 1 << 24
STEP_BLOCKS, RATE = 256, 0.005
#: Bytes of texts whose blocks are mixed for their steps; a longer text is learned from alone.
LEARNED_BYTES = 1 << 20
#: Parameters that are averaged together.
SLICE = 4096
#: Bins of the log odds of a word being drawn from the counts, on both sides of 0, and their width; the first bin is for no odds.
ODDS_BINS, ODDS_WIDTH = 400, 0.1
#: Most frequent words whose counts are broadcast, at most; all others are joined.
FREQUENT_WORDS = 1 << 18
#: Classes of subwords: that begin a word, and that go on with one.
FIRST_CLASSES, NEXT_CLASSES = 64, 64
#: Subwords with an own symbol in the context; the others share that of their class.
OWN_SYMBOLS = 1024
#: Words whose subwords a worker remembers; its memory is emptied when full.
REMEMBERED = 1 << 18
#: Bytes of texts that are scored in one go; a longer text is scored alone.
CHUNK_BYTES = 1 << 21

#: White space that is not ASCII, and the ASCII separators.
_OTHER_BLANK = re.compile(r"[^\S\t\n\x0b\x0c\r ]|[\x1c-\x1f]")

_OUT = (
    "doc_id long, n_tokens long, n_known long, base_score double, score double, attention_score double, "
    "row long, rare array<struct<word: string, spelt: array<float>, counted: array<float>>>"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Subword ids of words under a rank file; the id after the last is the text's end.

    ``find`` numbers words; the tables ``offset``, ``width``, ``pool`` give the ids of a number.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.begins[self.end] = True
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        #: Counts of the numbered words as far as a scorer has looked them up.
        self.seen, self.scored = np.zeros(0, np.int64), None
        self.offset, self.width, self.pool = (np.zeros(0, np.int32) for _ in range(3))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; new words are tokenised, and all are forgotten when there are too many."""
        found = list(map(self.number.get, words))
        new = [w for w, i in zip(words, found, strict=True) if i is None]
        if not new:
            return np.array(found, np.int64)
        if self.number and len(self.number) + len(new) > REMEMBERED:
            self._empty()
            return self.find(words)
        parts = [self._coded(new[at : at + 1024]) for at in range(0, len(new), 1024)]
        width = np.concatenate([w for _, w in parts])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.offset = np.concatenate([self.offset, len(self.pool) + np.cumsum(width) - width])
        self.width = np.concatenate([self.width, width])
        self.pool = np.concatenate([self.pool, *[ids for ids, _ in parts]])
        return np.array(list(map(self.number.get, words)), np.int64)

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        line = b" ".join(words).decode("utf-8", "replace")
        if not _OTHER_BLANK.search(line):
            # in one call, cut where a subword begins a word; words with white space of other alphabets are done alone
            ids = np.array(self.encoding.encode_ordinary(" " + line), np.int32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(words):
                return ids, np.diff(np.r_[at, len(ids)])
        each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for ids in each for i in ids], np.int32), np.array([len(ids) for ids in each])

    def laid_out(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of words one after another."""
        width = self.width[numbers]
        start = np.cumsum(width) - width
        return self.pool[np.repeat(self.offset[numbers] - start, width) + np.arange(int(width.sum()))].astype(np.int64)


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str | None) -> Subwords:
    path = path or default_tokenizer()
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between white space, A-Z lower-cased, and the text number of each; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, text = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), text[some.to_numpy(zero_copy_only=False)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts, null for the end of a text; counts of a part of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            texts = batch.column(0).slice(at, 8192)
            counted = split_words(texts)[0].value_counts()
            word, n = counted.field("values"), counted.field("counts")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([word, pa.nulls(1, pa.string())]), pa.concat_arrays([n, pa.array([len(texts)], pa.int64())])], ["word", "n"]
            )


def _successions(tokenizer: str | None):
    """(id before or -1, id or -1, n): subwords inside words, weighted by the words' counts; partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(tokenizer)
        for batch in batches:
            numbers = sub.find(batch.column(0).cast(pa.binary()).to_pylist())
            n, size = batch.column(1).to_numpy(), sub.width[numbers]
            last = np.cumsum(size + 1)
            flat = np.full(int(last[-1]) if len(last) else 0, -1, np.int64)
            inside = np.ones(len(flat), bool)
            inside[last - 1] = False
            flat[inside] = sub.laid_out(numbers)
            before = np.concatenate([[-1], flat[:-1]])
            key, at = np.unique((before + 1) * (sub.size + 1) + flat + 1, return_inverse=True)
            total = np.bincount(at, np.repeat(n, size + 1).astype("f8")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key // (sub.size + 1) - 1), pa.array(key % (sub.size + 1) - 1), pa.array(total)], ["before", "id", "n"])

    return run


@dataclass
class LanguageModel:
    """A fitted model: parts that are broadcast (bounded by the vocabulary's size) and the table of word counts."""

    tokenizer: str | None
    params: A.Params
    prior: np.ndarray
    #: Context symbol, class and log share inside the class of every subword.
    symbol: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    #: Occurrences of the words that begin with each class, and the weight of their spelling for them.
    begun: np.ndarray
    weight: np.ndarray
    counts: DataFrame
    frequent: dict[bytes, int]
    tokens: int
    distinct: int
    ends: int

    def scorer(self) -> A.Scorer:
        if "_scorer" not in self.__dict__:
            self._scorer = A.Scorer(self.params, self.prior, FIRST_CLASSES)
        return self._scorer

    def base(self, n: np.ndarray | Column):
        """Smoothed share of a token that occurs n times."""
        return (n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


def _classes(sub: Subwords, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, class and log share inside the class of every subword, from its count."""
    cls, symbol = np.zeros(sub.size, np.int64), np.zeros(sub.size, np.int64)
    for kind, size, offset in ((True, FIRST_CLASSES, 0), (False, NEXT_CLASSES, FIRST_CLASSES)):
        ids = np.flatnonzero(sub.begins == kind)
        ids = ids[np.lexsort((ids, -counts[ids]))]
        alone = size // 2
        cls[ids[:alone]] = offset + np.arange(len(ids[:alone]))
        rest = ids[alone:]
        mass = np.cumsum(counts[rest] + 0.5)
        cls[rest] = offset + alone + np.minimum((mass - 1e-9) / mass[-1] * (size - alone), size - alone - 1).astype(np.int64)
    weight = counts + 0.5
    share = np.log(weight / np.bincount(cls, weight, FIRST_CLASSES + NEXT_CLASSES)[cls]).astype("f4")
    top = np.lexsort((np.arange(sub.size), -counts))
    symbol = 2 + OWN_SYMBOLS + cls
    symbol[top[:OWN_SYMBOLS]] = 2 + np.arange(len(top[:OWN_SYMBOLS]))
    symbol[sub.end] = A.PAD
    return symbol, cls, share


def _mapped(symbol: np.ndarray, cls: np.ndarray):
    """Successions of subwords to (symbol before or -1, class or -1, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, to, n = (batch.column(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(before < 0, -1, symbol[before])), pa.array(np.where(to < 0, -1, cls[to])), pa.array(n)], ["before", "cls", "n"]
            )

    return run


def _prior(pairs: pd.DataFrame, ends: int, end_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Log share of each class after each symbol: inside a word by succession, at its end by the classes that begin words.

    Also the number of words that begin with each class.
    """
    size = 2 + OWN_SYMBOLS + FIRST_CLASSES + NEXT_CLASSES
    first, after = np.full(FIRST_CLASSES, 0.5), np.zeros((size, NEXT_CLASSES + 1))
    for before, to, n in pairs.itertuples(index=False):
        if before < 0 and to >= 0:
            first[to] += n
        elif before >= 0:
            after[before, to - FIRST_CLASSES if to >= 0 else NEXT_CLASSES] += n
    begun = first - 0.5
    first[end_class] += ends
    overall = after.sum(axis=0) + 0.5
    after = after + 5 * overall / overall.sum()
    after /= after.sum(axis=1, keepdims=True)
    after[A.BEGIN] = 1e-9
    after[A.BEGIN, NEXT_CLASSES] = 1
    return np.log(np.concatenate([after[:, NEXT_CLASSES:] * (first / first.sum()), after[:, :NEXT_CLASSES]], axis=1)).astype("f4"), begun


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """Words at least as frequent as a cut that leaves at most ``FREQUENT_WORDS``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r[0])  # at most 512 rows
    total, cut = 0, None
    for s, n in sizes:
        if total + n > FREQUENT_WORDS:
            break
        total, cut = total + n, s
    if cut is None:
        return {}
    return {r.word.encode(): r.n for r in counts.where(step >= cut).select("word", "n").collect()}


def fit_language_model(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, steps: int = STEPS) -> LanguageModel:
    """Learn from all rows of ``docs``; an empty table gives a model without words."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = staged(rows.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    counts = every.where(F.col("word").isNotNull())
    bytes_ = F.sum(F.col("n") * (F.octet_length("word") + 1))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(bytes_, F.lit(0))).first()
    ends = every.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = size[0] + ends, size[1] + (ends > 0)
    sub = subwords(tokenizer)
    pairs = staged(
        counts.mapInArrow(_successions(tokenizer), "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n")), "lm-successions"
    )
    seen = pairs.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the tokenizer's vocabulary
    number = np.zeros(sub.size)
    number[seen["id"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy(dtype="f8")
    number[sub.end] = ends
    symbol, cls, share = _classes(sub, number)
    # at most symbols x classes rows
    mapped = pairs.mapInArrow(_mapped(symbol, cls), "before long, cls long, n long").groupBy("before", "cls").agg(F.sum("n").alias("n")).toPandas()
    prior, begun = _prior(mapped, ends, int(cls[sub.end]))
    model = LanguageModel(
        tokenizer, A.start_params(len(prior), FIRST_CLASSES + NEXT_CLASSES), prior, symbol, cls, share, begun, np.full(FIRST_CLASSES, 1.0),
        counts, _frequent(counts), tokens, distinct, ends,
    )
    return _learned(rows, model, size[2], steps)


def _flat(p: A.Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: A.Params) -> A.Params:
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: v.reshape(like[k].shape).astype("f4") for k, v in zip(sorted(like), np.split(flat, cuts), strict=True)}


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array]]:
    """(shard, texts) of sorted rows: texts of one shard up to ``size`` bytes, whatever batches they come in."""
    kept: list[pa.Array] = []
    now, total = None, 0
    for batch in batches:
        shard, texts = batch.column(0).to_numpy(), batch.column(1).fill_null("")
        bytes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        start = 0
        for i in range(len(texts)):
            if kept or i > start:
                if shard[i] != now or total + bytes_[i] > size:
                    yield now, pa.concat_arrays([*kept, texts.slice(start, i - start)])
                    kept, start, total = [], i, 0
            now, total = shard[i], total + bytes_[i]
        kept.append(texts.slice(start))
    if kept:
        yield now, pa.concat_arrays(kept)


def _starter(shared, steps: int):
    """mapInArrow function: the parameters after the first steps, on as many of the texts as these steps see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        before, goal, lengths, blocks = [], [], [], 0
        for _, texts in _chunks(batches, LEARNED_BYTES):
            w = _laid_out(model, *split_words(texts), len(texts))
            before.append(w.x[w.place])
            goal.append(w.goal[w.place])
            lengths.append(w.lengths)
            blocks += int((-(-w.lengths // A.BLOCK)).sum())
            if blocks >= steps * STEP_BLOCKS:
                break
        if blocks:
            p, _ = A.train(model.prior, FIRST_CLASSES + NEXT_CLASSES, *map(np.concatenate, (before, goal, lengths)), steps=steps, batch=STEP_BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array([_flat(p)], pa.list_(pa.float32()))], ["p"])

    return run


def _odds_bin(odds: np.ndarray) -> np.ndarray:
    return 1 + np.clip(np.floor(odds / ODDS_WIDTH) + ODDS_BINS, 0, 2 * ODDS_BINS - 1).astype(np.int64)


#: Rows of a shard's slices of parameters, of a class's bins, and of a chunk's words that are not among the frequent ones.
_LEARNED = "shard int, part int, n long, p array<float>, cls int, bins array<long>, rare array<struct<word: string, cls: int, odds: array<float>>>"


def _shard_learner(shared, mean_bytes: float):
    """mapInArrow function: one pass over each shard, from the model's parameters on."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.list_(pa.int64())]
    entry = pa.list_(pa.struct([("word", pa.string()), ("cls", pa.int32()), ("odds", pa.list_(pa.float32()))]))
    names = [f.split()[0] for f in _LEARNED.split(", ")][:6] + ["rare"]

    def rows(m, shard, *columns, rare=None):
        values = [[shard] * m, *[c if c is not None else [None] * m for c in columns]]
        return pa.RecordBatch.from_arrays([*map(pa.array, values, types), pa.nulls(m, entry) if rare is None else rare], names)

    def done(shard, learner, learned, bins):
        flat = _flat(learner.p)
        parts = [flat[at : at + SLICE] for at in range(0, len(flat), SLICE)]
        yield rows(len(parts), shard, range(len(parts)), [learned] * len(parts), parts, None, None)
        some = np.flatnonzero(bins.any(axis=1))
        yield rows(len(some), shard, None, None, None, some, list(bins[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        log_begun, now = np.log(np.maximum(model.begun - 1, 1)), None
        for shard, texts in _chunks(batches, LEARNED_BYTES):
            if shard != now:
                if now is not None:
                    yield from done(now, learner, learned, bins)
                learner, rng = A.Learner({k: v.copy() for k, v in model.params.items()}), np.random.default_rng(int(shard))
                now, learned, seen, bins = shard, 0, 0, np.zeros((FIRST_CLASSES, 1 + 2 * ODDS_BINS), np.int64)
            w = _laid_out(model, *split_words(texts), len(texts))
            goal = w.goal.reshape(-1, A.BLOCK)
            usable = np.flatnonzero((goal >= 0).any(axis=1))
            log_class, log_first = np.zeros(len(w.x), "f4"), np.zeros(len(w.x), "f4")
            rate = RATE * max(0.02, 1 - seen / mean_bytes)
            for blocks in np.array_split(rng.permutation(usable), max(1, -(-len(usable) // STEP_BLOCKS))):
                target = goal[blocks].reshape(-1)
                at = (blocks[:, None] * A.BLOCK + np.arange(A.BLOCK)).reshape(-1)[target >= 0]
                log_class[at], log_first[at] = learner.step(model.prior, w.x, blocks, target, rate, FIRST_CLASSES)
            A.bound(learner.p)
            learned, seen = learned + len(w.place), seen + texts.nbytes
            logs = _joined(model, w, log_class[w.place], log_first[w.place])
            n = _occurrences(model)[logs.number]
            odds = (logs.first - logs.words - log_begun[logs.cls]).astype("f4")
            hot = n > 1
            np.add.at(bins, (logs.cls[hot], _odds_bin(odds[hot] + np.log(n[hot] - 1.0))), 1)
            np.add.at(bins, (logs.cls[n == 1], 0), 1)
            rare = np.flatnonzero(n == 0)
            rare = rare[np.argsort(logs.use[rare], kind="stable")]
            new = np.flatnonzero(np.r_[True, logs.use[rare][1:] != logs.use[rare][:-1]]) if len(rare) else rare
            word = pa.array(logs.names, pa.binary()).take(pa.array(logs.use[rare[new]])).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(rare)].astype("i4")), pa.array(odds[rare]))
            entries = pa.StructArray.from_arrays([word, pa.array(logs.cls[rare[new]].astype("i4")), lists], ["word", "cls", "odds"])
            yield rows(1, shard, None, None, None, None, None, rare=pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), entries).cast(entry))
        if now is not None:
            yield from done(now, learner, learned, bins)

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One slice of the parameters over all shards, by what they learned from, always in the same order."""
    table = table.sort_by("shard")
    total, n = 0.0, table["n"].to_numpy().astype("f8")
    for p, weight in zip(table["p"], n, strict=True):
        total = total + weight * p.values.to_numpy()
    return pa.table([table["part"][:1], pa.array([total / n.sum()], pa.list_(pa.float64()))], names=["part", "p"])


def _learned(rows: DataFrame, model: LanguageModel, size: int, steps: int) -> LanguageModel:
    """The model with parameters and weights that are learned from all rows, of ``size`` bytes of words."""
    context = rows.sparkSession.sparkContext
    shards = max(1, -(-size // SHARD_BYTES))
    mark = F.xxhash64("doc_id", "text")
    placed = rows.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), mark.alias("hash"), "text")

    def over(some: DataFrame, parts: int, function, schema: str) -> DataFrame:
        ordered = some.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "hash", "text")
        return ordered.select("shard", "text").mapInArrow(function, schema)

    shared = context.broadcast(replace(model, counts=None))
    started = over(placed.where("shard = 0"), 1, _starter(shared, steps), "p array<float>").collect()  # the parameters' size
    if started:
        model.params = _shaped(np.array(started[0].p, "f4"), model.params)
    shared = context.broadcast(replace(model, counts=None))
    learned = staged(over(placed, shards, _shard_learner(shared, max(1.0, size / shards)), _LEARNED), "lm-learned")
    slices = learned.where("part IS NOT NULL").select("shard", "part", "n", "p").groupBy("part").applyInArrow(_averaged, "part int, p array<double>")
    got = sorted(slices.collect(), key=lambda r: r.part)  # the parameters' size
    if got:
        model.params = _shaped(np.concatenate([r.p for r in got]), model.params)
        A.bound(model.params)
    model.weight = _interpolation(model, learned)
    return model


def _interpolation(model: LanguageModel, learned: DataFrame) -> np.ndarray:
    """Weight of the spelling against the word counts for each first class.

    By expectation maximisation on all words, each left out of its own count; classes with few
    words lean on the weight of all.
    """
    frequent = learned.where("bins IS NOT NULL").select("cls", F.posexplode("bins").alias("bin", "n")).where("n > 0")
    rare = learned.select(F.explode("rare").alias("r")).select("r.*").join(model.counts.select("word", "n"), "word")
    each = rare.select("cls", F.log(F.col("n") - 1.0).alias("left"), F.explode("odds").alias("odds"))
    at = F.least(F.greatest(F.floor((F.col("odds").cast("double") + F.col("left")) / ODDS_WIDTH) + ODDS_BINS, F.lit(0)), F.lit(2 * ODDS_BINS - 1))
    others = each.select("cls", F.when(F.col("left").isNull(), 0).otherwise(1 + at).cast("int").alias("bin"), F.lit(1).cast("long").alias("n"))
    table = np.zeros((FIRST_CLASSES, 1 + 2 * ODDS_BINS))
    for r in frequent.unionByName(others).groupBy("cls", "bin").agg(F.sum("n").alias("n")).collect():  # at most classes x bins
        table[r.cls, r.bin] = r.n
    if not table.any():
        return np.full(FIRST_CLASSES, 1.0)
    odds = np.r_[0.0, np.exp((np.arange(2 * ODDS_BINS) + 0.5 - ODDS_BINS) * ODDS_WIDTH)]

    def fitted(number: np.ndarray, lean: np.ndarray) -> np.ndarray:
        weight = lean.copy()
        for _ in range(30):
            gain = (number / (1 + ((1 - weight) / weight)[:, None] * odds)).sum(axis=1)
            weight = np.clip((gain + 50 * lean) / (number.sum(axis=1) + 50), 1e-3, 1 - 1e-3)
        return weight

    overall = fitted(table.sum(axis=0, keepdims=True), np.array([0.5]))
    return fitted(table, np.full(FIRST_CLASSES, overall[0]))


@dataclass
class WordLogs:
    """Natural logs for the words of some texts one after another, and for the texts' ends."""

    #: Text of each word, its number in the tokeniser's memory and among the distinct words ``names``.
    text: np.ndarray
    number: np.ndarray
    use: np.ndarray
    names: list[bytes]
    #: Probability of the word by its spelling; of its first subword's class, given that a word begins.
    words: np.ndarray
    first: np.ndarray
    cls: np.ndarray
    ends: np.ndarray


@dataclass
class Laid:
    """Words of some texts and the texts' ends as subwords, laid out in blocks."""

    text: np.ndarray
    number: np.ndarray
    use: np.ndarray
    names: list[bytes]
    is_end: np.ndarray
    ids: np.ndarray
    #: First subword of each word or end; subwords of each text.
    begin: np.ndarray
    lengths: np.ndarray
    #: The stream of symbols before each subword, the place of each there, and the classes.
    x: np.ndarray
    place: np.ndarray
    goal: np.ndarray


def _laid_out(model: LanguageModel, words: pa.Array, text: np.ndarray, texts: int) -> Laid:
    sub = subwords(model.tokenizer)
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    use = coded.indices.to_numpy().astype(np.int64)
    number = sub.find(names)[use]
    # the words of each text, and its end as a word of one subword
    count = np.bincount(text, minlength=texts)
    last = np.cumsum(count + 1) - 1
    is_end = np.zeros(len(words) + texts, bool)
    is_end[last] = True
    size = np.ones(len(is_end), np.int64)
    size[~is_end] = sub.width[number]
    begin = np.cumsum(size) - size
    ids = np.full(int(size.sum()), sub.end, np.int64)
    inside = np.ones(len(ids), bool)
    inside[begin[last]] = False
    ids[inside] = sub.laid_out(number)
    ahead = begin[last] + 1
    lengths = np.diff(np.r_[0, ahead])
    before = np.empty_like(ids)
    before[1:] = model.symbol[ids[:-1]]
    before[ahead - lengths] = A.BEGIN
    x, place = A.stream(before, lengths)
    goal = np.full(len(x), -1, np.int64)
    goal[place] = model.cls[ids]
    return Laid(text, number, use, names, is_end, ids, begin, lengths, x, place, goal)


def _joined(model: LanguageModel, w: Laid, chosen: np.ndarray, first: np.ndarray) -> WordLogs:
    """Logs of words from those of their subwords' classes and of the first classes."""
    # a word: its subwords given that a word begins, and that the next subword begins a word again
    logs = np.add.reduceat(chosen + model.share[w.ids], w.begin, dtype="f8") - first[w.begin] if len(w.ids) else np.zeros(0)
    opens, words = (chosen - first)[w.begin], ~w.is_end
    logs[words] += first[np.r_[w.begin[1:], 0]][words]
    return WordLogs(w.text, w.number, w.use, w.names, logs[words], opens[words].astype("f8"), model.cls[w.ids[w.begin[words]]], logs[w.is_end])


def word_logs(model: LanguageModel, words: pa.Array, text: np.ndarray, texts: int) -> WordLogs:
    """Log-probability of each word after the words before it, and of the end after all; ``text`` is the number of each word's text."""
    w = _laid_out(model, words, text, texts)
    goal = np.maximum(w.goal, 0)
    run, log_class, log_first = model.scorer(), np.empty(len(w.x), "f4"), np.empty(len(w.x), "f4")
    step = 256 * A.BLOCK
    for at in range(0, len(w.x) - A.BLOCK, step):
        # the block before a part is its past
        to = min(len(w.x), at + step + A.BLOCK)
        log_class[at + A.BLOCK : to], log_first[at + A.BLOCK : to] = (v[A.BLOCK :] for v in run(w.x[at:to], goal[at:to]))
    return _joined(model, w, log_class[w.place], log_first[w.place])


def _occurrences(model: LanguageModel) -> np.ndarray:
    """Count of each numbered word; 0 for words that are not among the frequent ones."""
    sub = subwords(model.tokenizer)
    if sub.scored is not model:
        sub.scored, sub.seen = model, np.zeros(0, np.int64)
    new = islice(sub.number, len(sub.seen), None)
    sub.seen = np.concatenate([sub.seen, np.array([model.frequent.get(w, 0) for w in new], np.int64)])
    return sub.seen


def _scorer(shared, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        row, ten = TaskContext.get().partitionId() << 33, np.log(10)
        spelling, counting = np.log(model.weight), np.log(1 - model.weight + 1e-300) - np.log(np.maximum(model.begun, 1))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES)))
                ids, (words, text) = batch.column(0).slice(at, to - at), split_words(batch.column(1).slice(at, to - at))
                m = len(ids)
                w = word_logs(model, words, text, m)
                n = _occurrences(model)[w.number]
                hot = n > 0
                sums = lambda values, some=slice(None): np.bincount(w.text[some], values, m)
                spelt, counted = w.words + spelling[w.cls], w.first + counting[w.cls]
                score = sums(np.logaddexp(spelt[hot], counted[hot] + np.log(n[hot])), hot) + w.ends
                base = sums(np.log10(model.base(n[hot])), hot) + np.log10(model.base(model.ends))
                known = sums(None, hot) + (model.ends > 0)
                # one entry for each other word of a text, with the logs of all its occurrences
                rare = np.flatnonzero(~hot)
                rare = rare[np.argsort(w.text[rare] * (len(w.names) + 1) + w.use[rare], kind="stable")]
                pair = w.text[rare] * (len(w.names) + 1) + w.use[rare]
                new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else pair
                lists = pa.array(np.r_[new, len(pair)].astype("int32"))
                logs = [pa.ListArray.from_arrays(lists, pa.array((v[rare] / ten).astype("f4"))) for v in (spelt, counted)]
                word = pa.array(w.names, pa.binary()).take(pa.array(w.use[rare[new]])).cast(pa.string())
                offsets = np.searchsorted(w.text[rare[new]], np.arange(m + 1)).astype("int32")
                entries = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([word, *logs], ["word", "spelt", "counted"]))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.bincount(text, minlength=m) + 1), pa.array(known.astype(np.int64)), pa.array(base),
                    pa.array(score / ten), pa.array((sums(w.words) + w.ends) / ten), pa.array(row + np.arange(m, dtype=np.int64)), entries,
                ], names)
                row, at = row + m, at + m

    return run


def score_texts(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of each text: doc_id, n_tokens, n_known, train_tokens, base_score, score, attention_score.

    ``base_score`` sums the tokens' smoothed training shares, ``attention_score`` is the
    attention model's spelling alone; in ``score`` a word is spelt or, its first class as
    foreseen by the attention, drawn from the counts of the words that begin with that class. A row per row
    of ``docs``: repeated rows and null ids are rows of their own, a null or empty text is its
    end alone, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(replace(model, counts=None))
    fields = ["doc_id", "n_tokens", "n_known", "base_score", "score", "attention_score", "row", "rare"]
    scored = staged(rows.mapInArrow(_scorer(shared, fields), _OUT), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    joined = rare.join(model.counts, "word", "left")
    known, many = F.col("n").isNotNull(), F.size("spelt")

    def both(pair: Column) -> Column:
        a, b = pair["spelt"].cast("double"), pair["counted"] + F.log10("n")
        return F.when(~known, a).otherwise(F.greatest(a, b) + F.log10(F.pow(F.lit(10.0), -F.abs(a - b)) + 1))

    each = joined.select(
        "row", F.when(known, many).otherwise(0).alias("known"), (many * F.log10(model.base(F.coalesce("n", F.lit(0))))).alias("base"),
        F.aggregate(F.arrays_zip("spelt", "counted"), F.lit(0.0), lambda s, pair: s + both(pair)).alias("score"),
    )
    sums = each.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"), "attention_score",
    )

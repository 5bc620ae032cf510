"""Toxicity by class-conditional Kneser-Ney models.

The models are over the bytes of lower-cased words, each context up to ORDER - 1
bytes back to the word's start. At the longest context each class has counts of
its own; below it both share continuation counts, so an expression too rare for
a class backs off to what is equally likely in both. There a byte speaks by its
context alone: a class that has seen other bytes follow it leaves less for this one,
so what remains of log P(byte | context) is the difference of the backoff weights.

A word says log P(word | toxic) - log P(word | ordinary). A text is scored by the
length-normalised difference: over all its words, over the best run of SPAN
words in it, and over its TOP most toxic words. A logistic calibration, fitted on
rows that the models have not seen, makes a probability of the three.

Every labelled text outside the held-out fold is learnt from, whole: tasks count the
words of two thirds of them, and the rest, on which each class weighs the same, give the
calibration by sums that tasks add up. The ends of the words' beginnings are dealt by the
LOW bytes before the last one, so a shard has all that orders above LOW count; the driver
adds up the orders to LOW, and builds a model of few words itself. It and the tasks get only
grams that a class has seen more than TOP_DISCOUNT times, as the others say no more than
their context does. Every text is scored whole.

Nulls: a null text is empty, and an empty text gets the score of difference 0. A
null doc_id is scored, never learnt from, and not held out. Of labels that
repeat a doc_id the largest counts; null labels don't, nor do labels of documents
that are not in the table. Rows that repeat a doc_id are each scored, and learnt
from once, by the least of their texts. With a class missing, every score is the
smoothed share of label 1. Empty tables give empty results. A very long text is
scored whole, by one task. Columns may have any names; drop_toxic returns them as
they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, cut_by, materialise, merge_blobs, pack, partitions, remove, text_slices, texts_of, trim, unused

ORDER, SPAN, TOP = 12, 16, 3
MAX_PER_CLASS, MAX_CHARS = 1000, 20_000
#: Of continuation counts, and of the classes' own counts: what fewer occurrences say is left to the backoff.
DISCOUNT, TOP_DISCOUNT = 0.75, 2.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE = 1_500_000
#: Words that a task counts before it tells.
COUNTED = 400_000
#: Distinct words of which the driver builds the model; and, of more, those that a task deals at once and the bytes whose ends one shard should hold.
AT_DRIVER, DEALT, SHARD_BYTES = 50_000, 100_000, 2 << 20
#: Grams above this order are counted within a shard.
LOW = 3
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x27 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _grams(buffer: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each byte, a hash of it and the n - 1 before it, as far as they are in its word."""
    out = np.zeros(len(buffer), dtype=np.uint64)
    depth = np.arange(len(buffer)) - starts
    for k in range(n - 1, -1, -1):
        x = np.zeros(len(buffer), dtype=np.uint64)
        x[k:] = buffer[: max(0, len(buffer) - k)]
        out = np.where(depth >= k, (out ^ x) * _BASE, out)
        out ^= out >> np.uint64(29)
    return out


def _lay(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as one array, each between marks; the start of each byte's word; which bytes count (not the first mark)."""
    size = np.array([len(w) + 2 for w in vocabulary], dtype=np.int64)
    buffer = np.frombuffer(b"".join(b"\1" + w + b"\1" for w in vocabulary), dtype=np.uint8)
    starts = np.repeat(np.cumsum(size) - size, size)
    return buffer, starts, np.arange(len(buffer)) != starts


def _distinct(vocabulary: pa.Array, counts: tuple[np.ndarray, ...], some: int = 50_000) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct ends of the words' beginnings, as the last ORDER bytes, the last one first, with the place in
    the word (ORDER at most) and how often each class has them; from some words at a time."""
    parts = []
    for k in range(0, len(vocabulary), some):
        words = vocabulary[k : k + some].to_pylist()
        buffer, starts, real = _lay(words)
        place, sizes = np.flatnonzero(real), [len(w) + 1 for w in words]
        depth = place - starts[place]
        keys, first, inverse = np.unique(_grams(buffer, starts, ORDER)[real], return_index=True, return_inverse=True)
        mine = np.stack([np.where(depth[first] >= j, buffer[place[first] - np.minimum(j, depth[first])], 0).astype(np.uint8) for j in range(ORDER)], axis=1)
        parts.append((keys, mine, np.minimum(depth[first], ORDER).astype(np.int8), *(np.bincount(inverse, np.repeat(c[k : k + some], sizes)) for c in counts)))
    keys, windows, depth, *counted = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    return _merged(keys, windows, depth, counted)


def _merged(keys: np.ndarray, windows: np.ndarray, depth: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Windows of one key as one, with the sums of their counts."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return windows[first], depth[first], [np.bincount(inverse, c) for c in counts]


def _window_grams(windows: np.ndarray, depth: np.ndarray, n: int) -> np.ndarray:
    """_grams() of what _distinct() gives."""
    out = np.zeros(len(depth), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        out = np.where(depth >= k, (out ^ windows[:, k].astype(np.uint64)) * _BASE, out)
        out ^= out >> np.uint64(29)
    return out


def _numbered(grams: np.ndarray) -> np.ndarray:
    return np.unique(grams, return_inverse=True)[1].astype(np.int32)


def _lower(windows: np.ndarray, depth: np.ndarray, p_low: np.ndarray, orders: range, last: np.ndarray | None = None) -> np.ndarray:
    """The shared probability of each window's last byte at the highest of the orders, from that below the lowest.
    last: the continuation counts at the highest order, where windows reach no farther back than it."""
    at = _numbered(_window_grams(windows, depth, orders[0]))
    for n in orders:
        # the context of a byte: the gram of one byte less that ends a byte before
        head = _numbered(_window_grams(windows[:, 1:], depth - 1, n - 1))
        # continuation counts: how many grams one byte longer end in this one
        if last is not None and n == orders[-1]:
            longer, kinds_of = at, np.bincount(at, last)
        else:
            longer = _numbered(_window_grams(windows, depth, n + 1))
            size = int(longer.max()) + 1
            kinds_of = np.bincount(np.unique(at.astype(np.int64) * size + longer) // size).astype(np.float64)
        first = np.unique(at, return_index=True)[1]
        total = np.bincount(head[first], kinds_of)[head]
        kinds = np.bincount(head[first])[head]
        p_low = (kinds_of[at] - DISCOUNT + DISCOUNT * kinds * p_low) / total
        at = longer
    return p_low


def _told(windows: np.ndarray, depth: np.ndarray, counts: list[np.ndarray], p_low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of the longest order with what they say, and contexts with what they leave, by the shared probability of the order below."""
    context = _window_grams(windows[:, 1:], depth - 1, ORDER - 1)
    head = _numbered(context)
    says, rests = 0.0, 0.0
    for n, sign in zip(counts, (-1, 1), strict=True):
        total = np.bincount(head, n)[head]
        rest = np.bincount(head, np.minimum(n, TOP_DISCOUNT))[head]
        safe = np.maximum(total, 1)
        says = says + sign * np.log(np.where(total > 0, (np.maximum(n - TOP_DISCOUNT, 0) + rest * p_low) / safe, p_low))
        # what a class leaves to the backoff: all of it where it has not seen the context
        rests = rests + sign * np.log(np.where(total > 0, rest / safe, 1.0))
    # grams that no class has seen more often say what their context leaves, and contexts without others leave the same in both
    own = np.maximum(*counts) > TOP_DISCOUNT
    return *_table(_window_grams(windows, depth, ORDER)[own], says[own]), *_table(context[rests != 0], rests[rests != 0])


class Model:
    """log P(byte | context, toxic) - log P(byte | context, ordinary), by gram of the longest order, and by context where a gram is not known."""

    def __init__(self, ordinary: dict[bytes, int], toxic: dict[bytes, int]):
        vocabulary = sorted({*ordinary, *toxic})
        self._build(pa.array(vocabulary, pa.binary()), *(np.array([c.get(w, 0) for w in vocabulary], dtype=np.float64) for c in (ordinary, toxic)))

    @classmethod
    def counted(cls, vocabulary: pa.Array, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
        """From distinct words and how often each class has them."""
        model = cls.__new__(cls)
        model._build(vocabulary, ordinary.astype(np.float64), toxic.astype(np.float64))
        return model

    @classmethod
    def tabled(cls, grams: np.ndarray, says: np.ndarray, contexts: np.ndarray, rest: np.ndarray) -> Model:
        """From what shards have told."""
        model = cls.__new__(cls)
        (model.grams, model.says), (model.contexts, model.rest) = _table(grams, says), _table(contexts, rest)
        return model

    def _build(self, vocabulary: pa.Array, *counts: np.ndarray) -> None:
        # bytes that agree as far back as ORDER sees are one, with the sum of their counts
        windows, depth, counts = _distinct(vocabulary, counts)
        p_low = _lower(windows, depth, np.full(len(depth), 1 / 256), range(1, ORDER))
        self.grams, self.says, self.contexts, self.rest = _told(windows, depth, counts, p_low)

    def of(self, vocabulary: list[bytes]) -> np.ndarray:
        """What each word says: its grams as they were seen, an unseen byte after a seen context by the backoff weights."""
        if not vocabulary:
            return np.empty(0)
        buffer, starts, real = _lay(vocabulary)
        says = np.zeros(len(buffer))
        says[1:] = _looked(self.contexts, self.rest, _grams(buffer, starts, ORDER - 1)[:-1])
        at, known = _places(self.grams, _grams(buffer, starts, ORDER))
        says[known] = self.says[at[known]]
        says = np.where(real, says, 0.0)
        return np.add.reduceat(says, np.flatnonzero(~real))


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their value."""
    keys, first = np.unique(keys, return_index=True)
    return keys, values[first]


def _places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _looked(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at, known = _places(keys, asked)
    return np.where(known, values[at], 0.0) if len(values) else np.zeros(len(asked))


class Scorer:
    def __init__(self, model: Model | None, weights: np.ndarray, base: float):
        self.model, self.weights, self.base, self.cache = model, weights, base, {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Length-normalised differences: over the text, its best SPAN words in a row (a shorter text counts as SPAN) and its best TOP words."""
        split = [words(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        cache = self.cache
        new = sorted({w for x in split for w in x if w not in cache})
        cache.update(zip(new, self.model.of(new).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for k, x in enumerate(split):
            if x:
                says = np.array([cache[w] for w in x])
                total = np.r_[0, np.cumsum(says)]
                best = (total[SPAN:] - total[:-SPAN]).max() if len(x) > SPAN else total[-1]
                out[k] = total[-1] / len(x), best / SPAN, np.sort(says)[-TOP:].sum() / TOP
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(_design(self.features(texts)) @ self.weights, -60, 60)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), np.clip(x, -6, 6)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; ridge on all but the first weight."""
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-9, np.full(x.shape[1] - 1, ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; never for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> list:
    """At most per_class (doc_id, label, text) for each of the labels 0 and 1, chosen by hash, at the driver: to look at, or for fit(). No query learns from it."""
    known = _known(labels, label, learn)
    # labels of documents that are not here, or too long to learn from, take no place in the sample
    here = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(here, "doc_id", "left_semi")
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = [(r.doc_id, r.y) for p in picked for r in p.collect()]  # at most 2 * per_class
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") <= max_chars)
    # one row an id, so that repeats of an id don't come to the driver
    rows = texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.y, r.text) for r in rows)


def fit(rows: list[tuple[int, int, str]]) -> Scorer:
    """trained() of rows in hand."""
    y = np.array([r[1] for r in rows], dtype=np.int64)
    base = float((y.sum() + 1) / (len(y) + 2))
    turn = np.zeros(len(y), dtype=np.int64)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum()) % 3
    if min((y == 0).sum(), (y == 1).sum()) < 3:
        return Scorer(None, np.zeros(4), base)
    counts: list[dict[bytes, int]] = [{}, {}]
    for (_, k, text), t in zip(rows, turn, strict=True):
        if t:
            mine = counts[k]
            for w in words(text.encode()):
                mine[w] = mine.get(w, 0) + 1
    if not all(counts):
        return Scorer(None, np.zeros(4), base)
    scorer = Scorer(Model(*counts), np.zeros(4), base)
    rest = np.flatnonzero(turn == 0)
    x = scorer.features([rows[i][2].encode() for i in rest])
    scorer.weights = logistic(_design(x), y[rest])
    scorer.cache = {}
    return scorer


def with_score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic."""
    docs = docs.drop(name)
    table = docs.sparkSession.sparkContext.broadcast(scorer)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = table.value
        for batch in batches:
            for rows in text_slices(batch):
                score = mine.scores(texts_of(rows.column(rows.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score, pa.float64())], names=[*rows.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _known(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y): the largest label of each id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(learn)
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def _turn(seed: int) -> Column:
    """Of three parts that ids fall in, the first is for the calibration."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to (word, ordinary, toxic), words of one task together as far as they fit."""

    def told() -> pa.RecordBatch:
        every = sorted({*counts[0], *counts[1]})
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *(pa.array([c.get(w, 0) for w in every], pa.int64()) for c in counts)], names=["word", "ordinary", "toxic"])

    counts: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for rows in text_slices(batch):
            for y, text in zip(rows.column(0).to_pylist(), texts_of(rows.column(1)), strict=True):
                counts[y].update(words(text))
        if len(counts[0]) + len(counts[1]) > COUNTED:
            yield told()
            counts = [Counter(), Counter()]
    yield told()


_PACKED = [np.uint64, np.uint32, np.int8, np.float64, np.float64]


def _packed(windows: np.ndarray, depth: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.ascontiguousarray(windows[:, :8]).view(np.uint64).ravel(), np.ascontiguousarray(windows[:, 8:]).view(np.uint32).ravel(), depth, *counts]


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    front, back, depth, *counts = merge_blobs(blobs, _PACKED)
    return np.concatenate([front[:, None].view(np.uint8), back[:, None].view(np.uint8)], axis=1), depth, counts


def _dealt(shards: int):
    """(word, ordinary, toxic) to (shard, blob) of their windows, by the LOW bytes before the last."""

    def deal(words: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(words)
        windows, depth, counts = _distinct(t.column(0).combine_chunks(), tuple(t.column(k).to_numpy().astype(np.float64) for k in (1, 2)))
        to = bucket_of(shards, _window_grams(windows[:, 1:], depth - 1, LOW).view(np.int64))
        rows = [(k, pack(*x)) for k, x in cut_by(to, *_packed(windows, depth, counts))]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "blob"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= DEALT:
                yield deal(held)
                held = []
        if held:
            yield deal(held)

    return every


def _joined(shard: pa.Table) -> pa.Table:
    """A shard's windows as one blob, and how many grams one byte longer it has for each of order LOW."""
    windows, depth, counts = _unpacked(shard.column("blob").to_pylist())
    windows, depth, counts = _merged(_window_grams(windows, depth, ORDER), windows, depth, counts)
    _, first = np.unique(_window_grams(windows, depth, LOW + 1), return_index=True)
    low, deep = windows[first, :LOW], np.minimum(depth[first], LOW)
    low, deep, (kinds,) = _merged(_window_grams(low, deep, LOW), low, deep, [np.ones(len(deep))])
    return pa.table({"blob": pa.array([pack(*_packed(windows, depth, counts))], pa.binary()), "low": pa.array([pack(*low.T, deep, kinds)], pa.binary())})


def _below(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order LOW with their shared probability, from what every shard has of them."""
    *low, depth, kinds = merge_blobs(blobs, [np.uint8] * LOW + [np.int8, np.float64])
    windows = np.stack(low, axis=1)
    windows, depth, (kinds,) = _merged(_window_grams(windows, depth, LOW), windows, depth, [kinds])
    return _table(_window_grams(windows, depth, LOW), _lower(windows, depth, np.full(len(depth), 1 / 256), range(1, LOW + 1), kinds))


def _sharded(words: DataFrame, size: int) -> Model:
    """Model.counted() of words(word, ordinary, toxic) of size bytes: the driver gets continuation counts of order LOW and what is told."""
    spark = words.sparkSession
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    dealt = words.mapInArrow(_dealt(shards), "shard int, blob binary")
    held = materialise(dealt.groupBy("shard").applyInArrow(_joined, "blob binary, low binary"), "grams")
    below = spark.sparkContext.broadcast(_below([r.low for r in held.select("low").collect()]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                windows, depth, counts = _unpacked([blob])
                p_low = _looked(*below.value, _window_grams(windows, depth, LOW))
                told = _told(windows, depth, counts, _lower(windows, depth, p_low, range(LOW + 1, ORDER)))
                yield pa.RecordBatch.from_arrays([pa.array([pack(*told)], pa.binary())], names=["told"])

    told = [r.told for r in held.select("blob").mapInArrow(tell, "told binary").collect()]
    below.unpersist()
    remove(held)
    return Model.tabled(*merge_blobs(told, [np.uint64, np.float64] * 2))


def _featured(scorer: Scorer):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = scorer.value
        for batch in batches:
            for rows in text_slices(batch):
                x = np.clip(mine.features(texts_of(rows.column(1))), -6, 6)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x[:, k]) for k in range(3))], names=["y", "x1", "x2", "x3"])

    return features


def _calibrated(rows: DataFrame, ridge: float = 1e-2) -> np.ndarray:
    """logistic() of rows(y, x1, x2, x3), each class of the same weight; an iteration brings one row of sums to the driver."""
    n, toxic = rows.select(F.count(F.lit(1)), F.sum("y")).first()
    x = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x3")]
    weight = F.when(F.col("y") == 1, n / 2 / toxic).otherwise(n / 2 / (n - toxic))
    w, penalty = np.zeros(4), np.r_[1e-9, np.full(3, ridge)]
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(float(a)) * b for a, b in zip(w, x, strict=True)), F.lit(0.0))))))
        stated = rows.select(*(c.alias(f"c{k}") for k, c in enumerate(x)), (weight * (p - F.col("y"))).alias("g"), (weight * (p * (1 - p) + 1e-9)).alias("h"))
        sums = stated.select(*(F.sum(F.col(f"c{k}") * F.col("g")) for k in range(4)), *(F.sum(F.col(f"c{j}") * F.col(f"c{k}") * F.col("h")) for j in range(4) for k in range(4))).first()
        step = np.linalg.solve(np.reshape(sums[4:], (4, 4)) + np.diag(penalty), np.array(sums[:4]) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Models from the words of two thirds of all learnt texts, the calibration from the others."""
    spark, learn = docs.sparkSession, ~held_out("doc_id", 5, 0)
    here = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").where(learn)
    # labels of documents that are not here count nowhere; ids only
    ids = materialise(_known(labels, "toxic", learn).join(here.select("doc_id"), "doc_id", "left_semi"), "labelled")
    parts, seed = {}, 0
    for seed in range(16):  # noqa: B007  few rows may leave a part without a class
        parts = {(r.y, r.first): r.n for r in ids.groupBy("y", _turn(seed).alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
        if len(parts) == 4 or not parts:
            break
    many = [parts.get((k, True), 0) + parts.get((k, False), 0) for k in (0, 1)]
    scorer = Scorer(None, np.zeros(4), (many[1] + 1) / (sum(many) + 2))
    if len(parts) == 4 and min(many) >= 3:

        def texts(part: Column) -> DataFrame:
            rows = here.where(part).join(ids.where(part).hint("merge"), "doc_id")
            # one row an id
            return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")

        counted = texts(~_turn(seed)).mapInArrow(_counted, "word binary, ordinary long, toxic long")
        found = materialise(counted.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "words")
        n, size, *count = found.select(F.count(F.lit(1)), F.sum(F.octet_length("word")), F.sum("ordinary"), F.sum("toxic")).first()
        if n and all(count):
            if n <= AT_DRIVER:
                got = found.toArrow()
                scorer.model = Model.counted(got.column(0).combine_chunks(), *(got.column(k).to_numpy() for k in (1, 2)))
            else:
                scorer.model = _sharded(found, size)
            table = spark.sparkContext.broadcast(scorer)
            features = texts(_turn(seed)).mapInArrow(_featured(table), "y int, x1 double, x2 double, x3 double")
            rows = materialise(features, "features")
            scorer = Scorer(scorer.model, _calibrated(rows), scorer.base)
            table.unpersist()
            remove(rows)
        remove(found)
    remove(ids)
    trim(spark)  # what the fit took of the driver's memory
    return scorer


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    out = with_score(slim, trained(docs, labels)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more."""
    name = unused("toxicity", docs.columns)
    marked = with_score(docs, trained(docs, labels), name)
    return marked.where(F.col(name) < 0.5).select(docs.columns)

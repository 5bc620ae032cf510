"""Benchmark decontamination by hashed windows of normalised words.

A-Z is lower-cased; a word is a run of digits, letters a-z and everything past
U+007F. A window is WINDOW consecutive words of an item; an item of fewer words
is one window. The hashes of all windows of a block of items are broadcast as one
sorted array, with the items' words; a block has at most about MAX_WORDS words, some
30 bytes each, and an item is never divided. A task takes GROUP_BYTES of texts at a
time and looks its windows up in one block after the other, so the corpus is read
once however many blocks there are, and one block is held at a time. Each hit is
verified on the words themselves.

Nulls: a null text has no words, as an empty one. A null item_id counts as the item
''. Items that share an item_id count once. Without items nothing is hit. Rows that
repeat are judged one by one. An empty table gives an empty one. A very long text is
scanned whole, by one task. Columns may have any names; remove_spans keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_column, text_slices, texts_of, unused

WINDOW = 10
MAX_WORDS, GROUP_BYTES = 2_000_000, 32 << 20
#: Stands for a removed span; its one character past U+007F makes it a word.
CUT = "\u2042".encode()
_WORD = re.compile(rb"[^ ]+")
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that a first look-up takes.
_SIEVE = 22


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hashes(every: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, every), dtype=np.uint64, count=len(every))


def _runs(h: np.ndarray, m: int) -> np.ndarray:
    """A hash for each run of m word hashes."""
    n = len(h) - m + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(m if n > 0 else 0):
        out = (out ^ h[k : k + n]) * _BASE
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """All windows of some items, by length: their hashes in order, where they stand in the items' words, and the item."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        texts, base, rows = [], 0, {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            m = min(WINDOW, len(w))
            size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
            start = base + np.cumsum(size + 1) - size - 1
            h = _runs(_hashes(w), m)
            rows.setdefault(m, []).append((h, start[: len(h)], (start + size)[m - 1 :], np.full(len(h), number[item], dtype=np.int32)))
            texts.append(b" ".join(w))
            base += len(texts[-1]) + 1
        self.text = b" ".join(texts)
        self.tables, self.sieves = {}, {}
        for m, parts in rows.items():
            h, lo, hi, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.tables[m] = h[order], lo[order], hi[order], item[order]
            self.sieves[m] = np.zeros(1 << _SIEVE, dtype=bool)
            self.sieves[m][h >> np.uint64(64 - _SIEVE)] = True

    def hits(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, list[str]]]:
        """For each text its number of words, starts and ends of hit windows, and the items."""
        split = [words(t) for t in texts]
        every = [w for x in split for w in x]
        ends = np.cumsum([len(x) for x in split], dtype=np.int64)
        hashes = _hashes(every) if self.tables else np.empty(0, np.uint64)
        found: list[tuple[list[int], list[int], set[int]]] = [([], [], set()) for _ in texts]
        for m, (table, lo, hi, item) in self.tables.items():
            h = _runs(hashes, m)
            some = np.flatnonzero(self.sieves[m][h >> np.uint64(64 - _SIEVE)])
            first, last = np.searchsorted(table, h[some]), np.searchsorted(table, h[some], side="right")
            known = last > first
            some, first, last = some[known], first[known], last[known]
            text = np.searchsorted(ends, some, side="right")
            for i, a, b, k in zip(some.tolist(), first.tolist(), last.tolist(), text.tolist(), strict=True):
                if i + m > ends[k]:  # windows don't cross texts
                    continue
                run = b" ".join(every[i : i + m])
                same = [int(item[j]) for j in range(a, b) if self.text[lo[j] : hi[j]] == run]
                if same:
                    starts, lengths, items = found[k]
                    starts.append(i - int(ends[k]) + len(split[k]))
                    lengths.append(m)
                    items.update(same)
        out = []
        for x, (starts, lengths, items) in zip(split, found, strict=True):
            start = np.array(starts, dtype=np.int64)
            out.append((len(x), start, start + np.array(lengths, dtype=np.int64), [self.items[k] for k in sorted(items)]))
        return out


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def blocks_of(benchmark: DataFrame, max_words: int = MAX_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about max_words words at most, one block at a time at the driver."""
    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    # a text of n characters has at most (n + 1) / 2 words
    most = slim.select(F.sum(F.floor((F.length("text") + 1) / 2))).first()[0] or 0
    count = -(-most // max_words)
    for k in range(count):
        # items of one id are dealt by text too
        rows = slim if count == 1 else slim.where(bucket_column(count, F.col("item"), F.col("text")) == k)
        yield [(r.item, r.text.encode()) for r in rows.collect()]


Finish = Callable[[pa.RecordBatch, list[bytes], list[int], list[tuple], list[list[str]]], pa.RecordBatch]


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        for rows in text_slices(batch, min(limit, 4 << 20)):
            held.append(rows)
            size += rows.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _scan(docs: DataFrame, benchmark: DataFrame, finish: Finish, schema: T.StructType, max_words: int) -> DataFrame:
    """docs with what the blocks find, put into its last form by finish."""
    spark = docs.sparkSession
    tables = [spark.sparkContext.broadcast(Windows(block)) for block in blocks_of(benchmark, max_words)] or [spark.sparkContext.broadcast(Windows([]))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, GROUP_BYTES if len(tables) > 1 else 4 << 20):
            texts = texts_of(rows.column(rows.schema.get_field_index("text")))
            counts, hits, items = [0] * len(texts), [(np.empty(0, np.int64),) * 2] * len(texts), [[]] * len(texts)
            for table in tables:
                for k, (n, lo, hi, mine) in enumerate(table.value.hits(texts)):
                    counts[k] = n
                    if mine:
                        hits[k] = np.r_[hits[k][0], lo], np.r_[hits[k][1], hi]
                        items[k] = sorted({*items[k], *mine})
                if len(tables) > 1:
                    del table._value  # the next block takes its place; it is loaded again when its turn comes
            yield finish(rows, texts, counts, hits, items)

    return docs.mapInArrow(mark, schema)


def report(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) for each row of docs."""

    def finish(rows, texts, counts, hits, items):
        hit = [int(covered(n, *h).sum()) if len(h[0]) else 0 for n, h in zip(counts, hits, strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "item_ids"])

    schema = T._parse_datatype_string("doc_id long, n_words long, n_hit long, item_ids array<string>")
    return _scan(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, finish, schema, max_words)


def _clean(text: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """text without its hit words and what stands between them."""
    spots = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    hit = covered(len(spots), lo, hi)
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    out, at = [], 0
    for a, b in edge.reshape(-1, 2).tolist():
        out += [text[at : spots[a][0]], CUT]
        at = spots[b - 1][1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with hit spans cut from text; rows that lose all their words go, and n_chars follows where it is.

    Each span leaves CUT in its place, a word of no item, so that its ends form no window.
    """
    names = docs.columns
    mark = unused("cut", names)
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BooleanType())])

    def finish(rows, texts, counts, hits, items):
        new, cut, stay = [], [], []
        for t, n, (lo, hi) in zip(texts, counts, hits, strict=True):
            if len(lo):
                t = _clean(t, lo, hi)
                stay.append(any(w not in CUT for w in words(t)))
            else:
                stay.append(True)
            cut.append(bool(len(lo)))
            new.append(t.decode("utf-8", "ignore"))
        k = rows.schema.get_field_index("text")
        text = pa.array([x if c else None for x, c in zip(new, cut, strict=True)], pa.string())
        text = pa.compute.if_else(pa.array(cut), text, rows.column(k))
        rows = rows.set_column(k, "text", text).append_column(mark, pa.array(cut))
        return rows.filter(pa.array(stay))

    out = _scan(docs, benchmark, finish, schema, max_words)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(mark), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(names)


def digest(items: DataFrame) -> DataFrame:
    """report() with the item ids as their number and digest."""
    return items.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

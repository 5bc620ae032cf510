"""Removal of byte strings that repeat, by a distributed merge sort of suffixes.

Every string of LENGTH bytes that also starts earlier (in a smaller doc_id, or
earlier in its own document) goes, judged on the input. All occurrences of such
a string hold the same window minimiser (the smallest hash among its GRAM-byte
strings), so it is enough to sort the suffixes that start at minimisers; no
match is lost by that.

1. anchors: each scan task finds its minimisers; hash ranges are exchanged,
   and those whose gram occurs once in the corpus leave. A task that sees a
   gram more than once sends one of them, so a hot gram costs a row a task.
2. runs: each bucket of documents sorts the suffixes at what remains, drops all
   but the earliest of suffixes with equal context on both sides (these are
   repeats whatever else there is), front-codes the sorted run and cuts it at
   the splitters of the ranges.
3. merge: each range combines its runs with a loser tree that keeps for every
   run the length it shares with the last winner, and compares from there on
   only. The shared lengths that come out, and those of the contexts on the
   left, give for each offset the classes of equal strings, exactly.
4. cut: the bytes covered by all but the earliest of a class are removed.

Nulls: a null text is empty; a null doc_id comes after all others. Rows that
share a doc_id, or have none, are ordered by SALT bits of their text's hash, then
by text, so that they are dealt to many buckets, and of equal rows one stays.
Texts below LENGTH bytes have nothing to remove. An empty table gives an empty
table. A text is held whole by the task of its bucket, however long it is. Columns
of docs may have any names: those of the result's own columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucket_column, bucket_of, buckets_for, cut_by, merge_blobs, mix64, pack, text_slices, texts_of, trim, unpack

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # largest offset of a minimiser in its string
WIDTH = LENGTH + 1 + SPAN + 1  # right context, its length, left context reversed, its length
CHUNK = 1 << 17
#: Documents from which splitters are taken, and grams of one batch; they decide how even the ranges are, nothing else.
SPLITTER_DOCS, SPLITTER_GRAMS = 2000, 2000
NO_ID = np.iinfo(np.int64).max
#: A place is one number: bits of the text's hash, the number of the text among those of one doc_id and hash, the position.
SALT, NUMBER, SPOT = 20, 12, 31
_SPOT_MASK = (1 << SPOT) - 1

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_STEPS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_WORDS = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
_TOP = np.uint32(0xFFFFFFFF)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of width values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in data (texts one after the other, ending at ends) of the minimisers of all their strings of LENGTH bytes."""
    found = []
    for lo in range(0, len(data), CHUNK):
        hi = min(len(data), lo + CHUNK)
        a, b = max(0, lo - SPAN), min(len(data), hi + SPAN)
        part = data[a : min(len(data), b + GRAM - 1)]
        if len(part) < LENGTH:
            continue
        h = _TABLE[part]
        have = 1
        for k in _STEPS:
            h = h[:-have] * k + h[have:]
            have *= 2
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        np.minimum(h, _TOP - np.uint32(1), out=h)
        h |= np.uint32(1)
        inside = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, b + LENGTH, side="right")] - a
        for e in inside.tolist():
            h[max(0, e - GRAM + 1) : e] = _TOP
        if len(h) <= SPAN:
            continue
        least = _slide(h, SPAN + 1, np.minimum)
        for e in inside.tolist():
            least[max(0, e - LENGTH + 1) : e] = 0
        padded = np.zeros(len(least) + 2 * SPAN, dtype=np.uint32)
        padded[SPAN : SPAN + len(least)] = least
        most = _slide(padded, SPAN + 1, np.maximum)[: len(h)]
        at = np.flatnonzero((most == h[: len(most)]) & (h[: len(most)] != _TOP)) + a
        found.append(at[(at >= lo) & (at < hi)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = sliding_window_view(data, GRAM)[at].view("<u8") if len(at) else np.empty((0, 4), "<u8")
    x = np.zeros(len(at), dtype=np.uint64)
    for k, m in enumerate(_WORDS):
        x = mix64((x ^ words[:, k]) * m)
    return x


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _scan(ranges: int, buckets: int):
    """Kind 0 carries single grams to their range; kind 1 carries anchors already known to repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                data, ends = _joined(texts_of(rows.column("text")))
                at = anchors(data, ends)
                if not len(at):
                    continue
                which = np.searchsorted(ends, at, side="right")
                doc, salt = _ids(rows.column("doc_id"))[which], rows.column("salt").to_numpy().astype(np.int32)[which]
                pos = (at - np.r_[0, ends][which]).astype(np.int32)
                key = _keys(data, at)
                order = np.lexsort((pos, salt, doc, key))
                key, doc, salt, pos = key[order], doc[order], salt[order], pos[order]
                first = np.r_[True, key[1:] != key[:-1]]
                size = np.diff(np.r_[np.flatnonzero(first), len(key)])
                many = np.repeat(size > 1, size)
                out = []
                dest = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                for d, x in cut_by(dest[first], key[first].astype(np.uint32), doc[first], salt[first], pos[first], many[first].astype(np.uint8)):
                    out.append((d, 0, pack(*x)))
                for d, x in cut_by(bucket_of(buckets, doc[many], salt[many].astype(np.int64)), doc[many], salt[many], pos[many]):
                    out.append((d % ranges, d + 1, pack(*x)))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["dest", "kind", "blob"])

    return scan


def _matched(buckets: int):
    """Anchors whose gram came from several tasks or was marked; those known already pass."""

    def matched(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        key, doc, salt, pos, many = merge_blobs([b for k, b in zip(kinds, blobs, strict=True) if not k], [np.uint32, np.int64, np.int32, np.int32, np.uint8])
        order = np.argsort(key, kind="stable")
        key, doc, salt, pos, many = key[order], doc[order], salt[order], pos[order], many[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[edges, len(key)])
        stay = np.repeat(size > 1, size) & (many == 0)
        out = [(k - 1, b) for k, b in zip(kinds, blobs, strict=True) if k]
        doc, salt, pos = doc[stay], salt[stay], pos[stay]
        out += [(d, pack(*x)) for d, x in cut_by(bucket_of(buckets, doc, salt.astype(np.int64)), doc, salt, pos)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "blob": pa.array([o[1] for o in out], pa.binary())})

    return matched


class Bucket:
    """The rows of a bucket in the order (doc_id, salt, text), with their bytes in one array; twin rows equal the one before in all three."""

    def __init__(self, t: pa.Table):
        texts, ids = texts_of(t.column("text")), _ids(t.column("doc_id").combine_chunks())
        salt = t.column("salt").to_numpy().astype(np.int64)
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], salt[i], texts[i]))
        self.ids, self.salt = ids[self.order], salt[self.order]
        self.texts = [texts[i] for i in self.order]
        self.starts = np.r_[0, np.cumsum([len(x) for x in self.texts], dtype=np.int64)]
        same = np.r_[False, (self.ids[1:] == self.ids[:-1]) & (self.salt[1:] == self.salt[:-1])][: len(ids)]
        self.twin = same & np.array([k > 0 and self.texts[k] == self.texts[k - 1] if same[k] else False for k in range(len(ids))], dtype=bool)
        number = np.cumsum(~self.twin)
        self.copy = (self.salt << NUMBER) | (number - np.maximum.accumulate(np.where(same, 0, number))) if len(ids) else number
        hashed = self._hash(self.ids, self.salt)
        self.by = np.argsort(hashed, kind="stable")
        self.hashed = hashed[self.by]

    @staticmethod
    def _hash(ids: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix64(ids.astype(np.int64).view(np.uint64) ^ mix64(salt.astype(np.uint64) + np.uint64(1)))

    def _named(self, doc: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows with each doc_id and salt: the place of the asked pair, and the row."""
        h = self._hash(doc, salt)
        lo = np.searchsorted(self.hashed, h)
        n = np.searchsorted(self.hashed, h, side="right") - lo
        ask = np.repeat(np.arange(len(doc)), n)
        row = self.by[np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        ok = (self.ids[row] == doc[ask]) & (self.salt[row] == salt[ask]) & ~self.twin[row]
        return ask[ok], row[ok]

    def rows_at(self, doc: np.ndarray, salt: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and position of each anchor, in all rows with its doc_id and salt; twins have none."""
        ask, row = self._named(doc, salt)
        pos = pos[ask].astype(np.int64)
        ok = pos + GRAM <= np.diff(self.starts)[row]
        both = np.unique((row[ok] << SPOT) | pos[ok])
        return both >> SPOT, both & _SPOT_MASK

    def rows_of(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The row of each place."""
        copy = place >> SPOT
        ask, row = self._named(doc, copy >> NUMBER)
        hit = self.copy[row] == copy[ask]
        out = np.zeros(len(doc), dtype=np.int64)
        out[ask[hit]] = row[hit]
        return out


def contexts(b: Bucket, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A row of WIDTH bytes for each anchor: what sorts, and what decides."""
    data = np.zeros(b.starts[-1] + 2 * LENGTH, dtype=np.uint8)
    data[LENGTH : LENGTH + b.starts[-1]] = np.frombuffer(b"".join(b.texts), dtype=np.uint8)
    right = np.minimum(LENGTH, np.diff(b.starts)[row] - pos)
    left = np.minimum(SPAN, pos)
    at = b.starts[row] + pos + LENGTH
    out = np.empty((len(row), WIDTH), dtype=np.uint8)
    out[:, :LENGTH] = sliding_window_view(data, LENGTH)[at]
    out[:, LENGTH + 1 : WIDTH - 1] = sliding_window_view(data, SPAN)[at - SPAN][:, ::-1]
    out[:, :LENGTH][np.arange(LENGTH) >= right[:, None]] = 0
    out[:, LENGTH + 1 : WIDTH - 1][np.arange(SPAN) >= left[:, None]] = 0
    out[:, LENGTH], out[:, -1] = right, left
    return out


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """What each row shares with the one before it."""
    if len(rows) < 2:
        return np.zeros(len(rows), dtype=np.uint8)
    apart = rows[1:] != rows[:-1]
    n = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return np.r_[0, n].astype(np.uint8)


def encode_run(rows: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """A sorted run, front-coded."""
    n = shared_lengths(rows)
    tail = rows[np.arange(WIDTH) >= n[:, None]]
    return pack(n, tail, doc, place)


def decode_run(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a run, one after the other, with their shared lengths, documents and places."""
    n, tail, doc, place = unpack(blob)
    tail, rows, row, at = tail.tobytes(), [], b"", 0
    for k in n.tolist():
        end = at + WIDTH - k
        row = row[:k] + tail[at:end]
        rows.append(row)
        at = end
    return b"".join(rows), n, doc, place


def loser_tree(runs: list[tuple[bytes, list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Merges sorted runs, each a string of rows of width bytes with their shared lengths.

    Returns the run of each row in merged order and the length it shares with
    the row before it. A run stands at the length that its next row shares with
    the last winner; of two runs the one that shares more is smaller, and only
    equal lengths make a comparison, which starts after them.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    data = [r[0] for r in runs] + [b""] * (k - len(runs))
    lens = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    shared = [0 if x else -1 for x in lens]
    loser = [0] * k

    def beaten(w: int, c: int) -> bool:
        """Whether c, at the same shared length as w, comes before it; sets the loser's length."""
        h = shared[w]
        if h < 0 or h >= width:
            return c < w
        a = int.from_bytes(data[w][at[w] + h : at[w] + width])
        b = int.from_bytes(data[c][at[c] + h : at[c] + width])
        same = width - (((a ^ b).bit_length() + 7) >> 3)
        c_first = b < a or (a == b and c < w)
        shared[w if c_first else c] = same
        return c_first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        y_first = shared[y] > shared[x] or (shared[y] == shared[x] and beaten(x, y))
        loser[node] = x if y_first else y
        return y if y_first else x

    w = build(1) if k > 1 else 0
    done = [0] * k
    out_run, out_len = [], []
    for _ in range(sum(map(len, lens))):
        out_run.append(w)
        out_len.append(shared[w])
        i = done[w] = done[w] + 1
        at[w] += width
        hw = shared[w] = lens[w][i] if i < len(lens[w]) else -1
        node = (w + k) >> 1
        while node:
            c = loser[node]
            hc = shared[c]
            if hc > hw or (hc == hw and beaten(w, c)):
                loser[node] = w
                w, hw = c, shared[c]
            node >>= 1
    return out_run, out_len


def _merged_intervals(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals by document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    base = (np.cumsum(new_doc) - 1) * (hi.max() + 2)  # ends made comparable across documents
    reach = np.maximum.accumulate(hi + base)
    start = np.r_[True, (lo + base)[1:] > reach[:-1]] | new_doc
    at = np.flatnonzero(start)
    return doc[at], lo[at], (reach - base)[np.r_[at[1:] - 1, len(doc) - 1]]


def _local(splitters: np.ndarray):
    def local(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        doc, salt, pos = merge_blobs(replies.column("blob").to_pylist(), [np.int64, np.int32, np.int32])
        b = Bucket(docs)
        row, pos = b.rows_at(doc, salt.astype(np.int64), pos)
        rows = contexts(b, row, pos)
        doc, place = b.ids[row], (b.copy[row] << SPOT) | pos
        order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
        rows, doc, place, row, pos = rows[order], doc[order], place[order], row[order], pos[order]
        again = shared_lengths(rows) == WIDTH
        lo, hi = pos - rows[:, -1], pos - np.maximum(0, LENGTH - rows[:, LENGTH].astype(np.int64)) + LENGTH
        gone = again & (hi - lo >= LENGTH)
        out = [(-1, int(key[0].as_py()), pack(*_pieces(doc, place - pos, lo, hi, gone)))] if gone.any() else []
        rows, doc, place = rows[~again], doc[~again], place[~again]
        # a range ends where a gram does: strings that are equal share one
        head = np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel()
        edges = np.r_[0, np.searchsorted(head, splitters, side="right"), len(head)]
        trim()
        out += [(d, -1, encode_run(rows[x:y], doc[x:y], place[x:y])) for d, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
        return pa.table({"dest": pa.array([o[0] if o[0] >= 0 else o[1] for o in out], pa.int32()), "bucket": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    return local


def _pieces(doc, copy, lo, hi, gone):
    """Intervals (doc_id, copy << SPOT, start, end), united where they touch."""
    both = np.stack([doc[gone], copy[gone]])
    pairs, which = np.unique(both, axis=1, return_inverse=True) if gone.any() else (both, np.empty(0, np.int64))
    which, lo, hi = _merged_intervals(which.ravel(), lo[gone].astype(np.int64), hi[gone].astype(np.int64))
    return pairs[0][which], pairs[1][which], lo, hi


def repeats(rows: np.ndarray, n: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """For sorted rows and their shared lengths: (doc, copy, start, end) of strings that an earlier row has too."""
    fresh = n < WIDTH
    if not fresh.all():
        # rows with one whole context: all but the earliest are repeats, whatever else there is
        group = np.cumsum(fresh) - 1
        order = np.lexsort((place, doc, group))
        first = np.r_[True, group[order][1:] != group[order][:-1]]
        later = order[~first]
        lo = (place[later] & _SPOT_MASK) - rows[later, -1]
        hi = (place[later] & _SPOT_MASK) + rows[later, LENGTH]
        ok = hi - lo >= LENGTH
        yield doc[later][ok], (place[later] & ~_SPOT_MASK)[ok], lo[ok], hi[ok]
        rows, n, doc, place = rows[fresh], n[fresh], doc[order[first]], place[order[first]]
    right, left = rows[:, LENGTH].astype(np.int64), rows[:, -1].astype(np.int64)
    n = np.minimum(np.minimum(n.astype(np.int64), LENGTH), np.minimum(right, np.r_[0, right[:-1]]))
    joined = n >= GRAM
    paired = joined | np.r_[joined[1:], False]
    n, rows, doc, place, right, left = np.where(joined, n, 0)[paired], rows[paired], doc[paired], place[paired], right[paired], left[paired]
    if not len(n):
        return
    order = np.argsort(np.ascontiguousarray(rows[:, LENGTH + 1 :]).view(f"S{SPAN + 1}").ravel(), kind="stable")
    m = shared_lengths(rows[order][:, LENGTH + 1 : WIDTH - 1]).astype(np.int64)
    m = np.minimum(m, np.minimum(left[order], np.r_[0, left[order][:-1]]))
    # offsets at which a row can equal another: as far as its neighbours in either order share with it
    least = LENGTH - np.maximum(n, np.r_[n[1:], 0])
    most = np.empty(len(n), np.int64)
    most[order] = np.maximum(m, np.r_[m[1:], 0])
    some = np.flatnonzero(least <= most)
    some = some[np.lexsort((place[some], doc[some]))]
    least, most = least[some], most[some]
    own = np.empty(len(n), np.int64)
    for off in range(SPAN + 1):
        at = some[(least <= off) & (off <= most)]
        if len(at) < 2:
            continue
        block = np.cumsum(n < LENGTH - off)
        own[order] = np.cumsum(m < off) if off else 0
        at = at[pd.Series(block[at] * (len(n) + 1) + own[at]).duplicated().to_numpy()]
        if len(at):
            pos = place[at] & _SPOT_MASK
            yield doc[at], place[at] - pos, pos - off, pos - off + LENGTH


def _merge(buckets: int):
    def merge(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("bucket").to_pylist(), t.column("blob").to_pylist()
        out = [(k, b) for k, b in zip(kinds, blobs, strict=True) if k >= 0]
        runs, docs, places = [], [], []
        for k, blob in zip(kinds, blobs, strict=True):
            if k < 0:
                rows, n, doc, place = decode_run(blob)
                runs.append((rows, n.tolist()))
                docs.append(doc)
                places.append(place)
        if runs:
            order, n = loser_tree(runs, WIDTH)
            order = np.argsort(np.argsort(np.array(order, dtype=np.int32), kind="stable"), kind="stable")
            rows = np.frombuffer(b"".join(r[0] for r in runs), dtype=np.uint8).reshape(-1, WIDTH)[order]
            doc, place, runs = np.concatenate(docs)[order], np.concatenate(places)[order], None
            found = list(repeats(rows, np.array(n), doc, place))
            if found:
                doc, copy, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                pieces = _pieces(doc, copy, lo, hi, np.ones(len(doc), bool))
                salt = pieces[1] >> (SPOT + NUMBER)
                out += [(d, pack(*x)) for d, x in cut_by(bucket_of(buckets, pieces[0], salt), *pieces)]
            rows = found = None
            trim()
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "blob": pa.array([o[1] for o in out], pa.binary())})

    return merge


def _cut(fields: list[tuple[str, pa.DataType]]):
    """Each row with its removed spans (pairs of byte places) and the bytes that stay."""

    def cut(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        doc, copy, lo, hi = merge_blobs(spans.column("blob").to_pylist(), [np.int64] * 4)
        b = Bucket(docs)
        twins = np.flatnonzero(b.twin & (np.diff(b.starts) >= LENGTH))  # all of them stands in the row before
        row = np.r_[b.rows_of(doc, copy), twins]
        row, lo, hi = _merged_intervals(row, np.r_[lo, np.zeros(len(twins), np.int64)], np.r_[hi, np.diff(b.starts)[twins]])
        edges = np.searchsorted(row, np.arange(len(b.ids) + 1))
        kept, removed, counts = [], [], []
        for i, text in enumerate(b.texts):
            at, pieces, gone = 0, [], 0
            for x, y in zip(lo[edges[i] : edges[i + 1]].tolist(), hi[edges[i] : edges[i + 1]].tolist(), strict=True):
                pieces.append(text[at:x])
                gone += y - x
                at = y
            pieces.append(text[at:])
            kept.append(b"".join(pieces))
            removed.append(gone)
            counts.append(int(edges[i + 1] - edges[i]))
        trim()
        out = docs.take(pa.array(b.order, pa.int64()))
        for name, values in (("n_bytes", [len(x) for x in b.texts]), ("n_removed", removed), ("n_spans", counts)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        out = out.append_column("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
        text = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        out = out.append_column("kept_text", text)
        return out.select([f for f, _ in fields]).cast(pa.schema([pa.field(f, t) for f, t in fields]))

    return cut


def _splitters(docs: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """Quantiles of the grams at minimisers in a bounded sample of documents; as many ranges as the sample allows."""
    share = max(1, rows // SPLITTER_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "salt"), F.lit(share)) == 0).select("text").where(F.octet_length("text") <= 1 << 16)

    def heads(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, ends = _joined(texts_of(part.column("text")))
                at = anchors(data, ends)
                head = np.unique(np.ascontiguousarray(sliding_window_view(data, GRAM)[at]).view(f"S{GRAM}").ravel()) if len(at) else np.empty(0, f"S{GRAM}")
                head = head[:: max(1, len(head) // SPLITTER_GRAMS)]
                yield pa.RecordBatch.from_arrays([pa.array([head.tobytes()], pa.binary())], names=["blob"])

    got = np.unique(np.frombuffer(b"".join(bytes(r[0]) for r in some.mapInArrow(heads, "blob binary").collect()), dtype=f"S{GRAM}"))
    return got[np.unique(np.linspace(0, len(got) - 1, ranges + 1)[1:-1].astype(int))] if len(got) else got


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text.

    kept_text leaves out bytes of characters that a cut has split. Columns of
    docs that have one of these names are replaced.
    """
    extra = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"} | ({"kept_text": "string"} if with_text else {})
    docs = docs.drop("kept_text", *extra).withColumn("doc_id", F.col("doc_id").cast("long"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    salt = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - SALT).alias("salt")
    slim = docs.select("doc_id", "text", salt)
    rows, buckets = buckets_for(slim)
    splitters = _splitters(slim, rows, 3 * buckets)
    bucket = bucket_column(buckets, F.coalesce("doc_id", F.lit(NO_ID)), F.col("salt")).alias("bucket")
    # columns of any names travel in one that has a name of its own; one exchange serves both uses
    dealt = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []), salt).select("*", bucket)
    found = slim.mapInArrow(_scan(buckets, buckets), "dest int, kind int, blob binary").groupBy("dest").applyInArrow(_matched(buckets), "bucket int, blob binary")
    local = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_local(splitters), "dest int, bucket int, blob binary")
    spans = local.groupBy("dest").applyInArrow(_merge(buckets), "bucket int, blob binary")
    schema = T.StructType([*dealt.drop("salt", "bucket").schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in extra.items())])
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    out = dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut(fields), schema)
    back = {c: F.col("others")[c].alias(c) for c in others}
    return out.select(*[back.get(c, F.col(c)) for c in docs.columns], *extra)


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """docs with repeats cut from text, n_chars after it where it is; a row goes if a cut leaves white space only. All columns keep their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else [])))
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    again = F.col("n_removed") > 0
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(again, F.col("kept_text")).otherwise(F.col("text"))}
    made |= {c: F.col("others")[c] for c in others}
    if "n_chars" in others:
        made["n_chars"] = F.when(again, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others")["n_chars"])
    return cut.select(*[made[c].alias(c) for c in docs.columns])

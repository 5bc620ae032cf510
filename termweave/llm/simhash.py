"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two differ in at most DISTANCE bits, some
segment of theirs differs in at most DISTANCE // SEGMENTS bits; so each
fingerprint is filed under its segments' values, looks under all values of the
small Hamming ball round each, and what it meets is verified on all 64 bits.
Of a pair, only the one with the smaller segment value looks.

Copies share a fingerprint and count once from there on. Each task reduces the
links it finds to stars, so a group of near copies gives a row a member and not
one a pair; no link between fingerprints is lost by that.

Under one value, few entries are compared with each other. Many are parted first:
of DISTANCE + 1 pieces of a fingerprint's other bits one is equal in both of a pair,
so entries are compared where they share a piece, and parted again while they are many.

Nulls: a null text has no words, and fingerprint zero, which links like any
other. A null doc_id takes part, but is never the smallest of its component
unless all are null. Repeated rows stay. An empty table gives an empty one. A very
long text is read whole, in memory that follows its number of words. Columns may
have any names; keep_one returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, cut_by, materialise, merge_blobs, pack, partitions, text_slices, texts_of, unused
from .components import components

WORDS, DISTANCE, SEED = 4, 4, 42
SEGMENTS = 3
#: Entries under one value up to which all are compared at once, and up to which one is compared to the others.
SMALL, MANY = 48, 4096
#: Rows of one fingerprint are dealt to so many tasks when they get their component.
SALTS = 32
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The unsigned fingerprint of each UTF-8 text."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = t.lower().split()
        if len(words) <= WORDS:
            mine = [digest(b" ".join(words), SEED)] if words else []
        else:
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
            starts = [0, *(e + 1 for e in ends[: len(words) - WORDS])]
            mine = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)]
        hashes += mine
        sizes.append(len(mine))
    return majority(np.array(hashes, dtype=np.uint64), sizes)


def majority(h: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The fingerprint of each run of so many hashes; of none zero."""
    n = np.array(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    start = (np.cumsum(n) - n)[some]
    n = n[some]
    # runs of at most 255 of one text: their counts fit the byte lanes of one integer
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    bits = np.zeros((len(some), 64), dtype=np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        bits[:, s::8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    out[some] = np.packbits(bits * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    docs = docs.drop(name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                fp = fingerprints(texts_of(rows.column(rows.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fp.view(np.int64))], names=[*rows.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _cuts(segments: int) -> list[tuple[int, int]]:
    edges = [64 * k // segments for k in range(segments + 1)]
    return list(zip(edges[:-1], (b - a for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))


def _filed(segments: int, ranges: int):
    radius = DISTANCE // segments

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(every), 20_000):
                fp = every[a : a + 20_000]
                keys, fps, home = [], [], []
                for k, (low, width) in enumerate(_cuts(segments)):
                    own = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
                    for flip in flips:
                        to = own ^ np.uint64(flip)
                        look = to >= own
                        keys.append(to[look] | np.uint64(k << 60))
                        fps.append(fp[look])
                        home.append(np.full(look.sum(), not flip, dtype=np.uint8))
                key, out = np.concatenate(keys), []
                for d, x in cut_by(bucket_of(ranges, key.view(np.int64)), key, np.concatenate(fps), np.concatenate(home)):
                    out.append((d, pack(*x)))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["dest", "blob"])

    return filed


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _connected(rest: np.ndarray, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is near in rest, distinct values that may differ in bits."""
    if len(rest) > MANY and len(bits) > DISTANCE:
        for piece in np.array_split(np.array(bits), DISTANCE + 1):
            value = rest & np.uint64(sum(1 << b for b in piece.tolist()))
            order = np.argsort(value, kind="stable")
            edges = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1], True])
            others = [b for b in bits if b not in piece]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    yield from _connected(rest[order[a:b]], others)
        return
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = np.uint64(todo.pop())
            ok = _near(rest, x)
            if ok.any():
                got, rest = rest[ok], rest[~ok]
                todo += got.tolist()
                yield np.full(len(got), x, dtype=np.uint64), got


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among what lies under one value; in large groups only as many as connect the same."""
    order = np.lexsort((fp, 1 - home, key))
    key, fp, home = key[order], fp[order], home[order].astype(np.int64)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[edge, len(key)])
    homes = np.add.reduceat(home, edge) if len(edge) else edge
    worth = (homes > 0) & (size > 1)
    left, right = [], []
    few = np.flatnonzero(worth & (size <= SMALL))
    for some in np.array_split(few, max(1, len(few) // 50_000)):
        n, m, at = homes[some], size[some], edge[some]
        row = np.repeat(np.arange(len(some)), n * m)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        i, j = at[row] + k // m[row], at[row] + k % m[row]
        ok = (i < j) & _near(fp[i], fp[j])
        left.append(fp[i[ok]])
        right.append(fp[j[ok]])
    for g in np.flatnonzero(worth & (size > SMALL)).tolist():
        for x, y in _connected(np.unique(fp[edge[g] : edge[g] + size[g]]), list(range(64))):
            left.append(x)
            right.append(y)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b, as (node, least node)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _met(t: pa.Table) -> pa.Table:
    key, fp, home = merge_blobs(t.column("blob").to_pylist(), [np.uint64, np.uint64, np.uint8])
    a, b = stars(*_links(key, fp, home))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_stars(distinct: DataFrame, rows: int) -> DataFrame:
    """distinct(fp) to links (a, b) that connect what is within DISTANCE."""
    ranges = max(partitions(distinct.sparkSession), rows // 20_000)
    filed = distinct.select("fp").mapInArrow(_filed(SEGMENTS, ranges), "dest int, blob binary")
    return filed.groupBy("dest").applyInArrow(_met, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text)."""
    marked = materialise(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "fp"), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct")
    found = components(link_stars(distinct, distinct.count()))
    joined = distinct.join(found, distinct["fp"] == found["node"], "left")
    linked = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(linked, "component", "left").where("component IS NOT NULL OR copies > 1")
    # a row alone is its own component; others meet theirs in as many tasks as there are salts
    named = named.select(F.col("fp").alias("named_fp"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # of a written table: the same for a row however often it is read; ids may be null
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    out = marked.withColumn("mine", salt).join(named, (F.col("fp") == F.col("named_fp")) & (F.col("mine") == F.col("salt")), "left")
    return out.select("doc_id", "fp", F.when(F.col("named_fp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: of its smallest doc_id, and of rows that share that, one."""
    marked = materialise(with_fingerprint(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")).select("doc_id", "text_hash", F.col("fp").alias("unit")), "fingerprints")
    distinct = materialise(marked.select(F.col("unit").alias("fp")).distinct(), "distinct")
    return kept_rows(docs, marked, components(link_stars(distinct, distinct.count())))


def kept_rows(docs: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component: marked(doc_id, text_hash, unit) is a row each, found(node, component) names linked units.

    Rows are told apart by doc_id and text, as ids may be null or shared.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    reps = marked.groupBy("unit").agg(F.min(first).alias("rep"))
    named = reps.join(found, reps["unit"] == found["node"], "left").groupBy(F.coalesce("component", "unit")).agg(F.min("rep").alias("rep")).select("rep.kept_id", "rep.kept_hash")
    repeats = marked.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("kept_rows")).where("kept_rows > 1")
    keep = named.join(repeats, named["kept_hash"].eqNullSafe(repeats["hash"]) & named["kept_id"].eqNullSafe(repeats["id"]), "left").select("kept_id", "kept_hash", F.coalesce("kept_rows", F.lit(1)).alias("kept_rows"))
    names = [unused(c, docs.columns) for c in keep.columns]
    kept_id, kept_hash, rows = names
    keep = materialise(keep.toDF(*names), "keep")
    # kept ids have no proven bound: never broadcast, the same spilling join at every size
    joined = docs.join(keep.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(keep[kept_id]) & (F.xxhash64(docs["text"]) == keep[kept_hash]))
    if keep.where(F.col(rows) > 1).isEmpty():
        return joined.select(docs.columns)
    several = joined.where(F.col(rows) > 1).dropDuplicates([kept_id, kept_hash])
    return joined.where(F.col(rows) == 1).select(docs.columns).unionByName(several.select(docs.columns))

"""Near copies by SimHash, verified by the Jaccard coefficient of five-word shingles.

Texts whose sets of shingles reach THRESHOLD are linked. Each set has a SimHash
fingerprint, and groups of fingerprints that differ in few bits (as simhash finds them)
are candidates first; each is verified on the whole sets. Few bits lose sets near the
threshold, so what SimHash leaves apart is completed: further candidates share a band
of minhashes: of pairs at exactly 0.8, 1 - (1 - 0.8**ROWS)**BANDS = 0.99997 meet in
one, and more above. Each candidate is verified on the whole sets (32-bit hashes).

Texts with the same set are one unit. Under a band, all units are compared to one
drawn from them. Groups that hold several components still are then joined within
tasks by prefixes: in order of rarity in the group, two sets that reach the
threshold share one of their rarest shingles, a fifth of the set and one more. A
unit whose rarest fifth is its own meets nobody, so copies too far apart cost
little; links leave the task as stars. No pair becomes a row there, and no link
between units that meet is lost. A group above GROUP units is cut into blocks, and
each pair of blocks is a group.

A text of fewer words is one shingle; texts without words, null ones too, are copies
of each other. A null doc_id counts as the largest. Rows that repeat count as copies.
An empty table gives an empty one. Columns may have any names. A very long text is
read whole by one task, as a set of 4 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, partitions, remove, text_slices, texts_of, trim
from .components import components
from .simhash import kept_rows, link_stars, majority, stars

WORDS, SEED = 5, 42
#: The threshold is 4 / 5, kept whole so that its comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 20, 4
#: Units of one group that a task joins at once, and bytes of sets that one task gets.
GROUP, TASK_BYTES = 400, 16 << 20
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes, in order, of the runs of WORDS words of a UTF-8 text."""
    digest, words = xxhash.xxh64_intdigest, text.lower().split()
    if len(words) <= WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - WORDS])]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)], dtype=np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; those of empty sets are zero."""
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    h = np.concatenate([sets[k] for k in some])
    at = np.cumsum([0, *(len(sets[k]) for k in some[:-1])])
    for band in range(BANDS):
        key = np.full(len(some), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix64(key ^ np.minimum.reduceat((h ^ _TURNS[0, k]) * _TURNS[1, k], at))
        out[some, band] = key
    return out


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, unit, fp, n, hashes, keys) of each row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                sets = [shingles(t) for t in texts_of(rows.column("text"))]
                unit = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                short = [np.unique(s.astype(np.uint32)) for s in sets]
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sets).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                fp = majority(np.concatenate(sets), [len(s) for s in sets]).view(np.int64)
                columns = [rows.column("doc_id"), rows.column("text_hash"), pa.array(unit), pa.array(fp), pa.array([len(s) for s in short], pa.int64()), pa.array([s.tobytes() for s in short], pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "unit", "fp", "n", "hashes", "keys"])

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(add, "doc_id long, text_hash long, unit long, fp long, n long, hashes binary, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes in order reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b) or DENOMINATOR * len(a) < NUMERATOR * len(b):
        return not len(b)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that reach the threshold on sets(unit, hashes)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k) for k in (2, 3))
            ok = [similar(*(np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in two)) for two in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("unit").alias("a"), F.col("hashes").alias("left"))
    two = sets.select(F.col("unit").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _sized(n: str, m: str) -> F.Column:
    """Sets of such sizes can reach the threshold."""
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def group_links(own: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs (x, y) of places of one group that reach the threshold and join what components (own) and earlier pairs leave apart."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    start = np.cumsum(size) - size
    order = np.lexsort((token, many[token], owner))
    rare = token[order]
    post = np.argsort(token, kind="stable")
    holders, first = owner[post], np.r_[0, np.cumsum(many)]
    # a set that reaches the threshold with another lacks at most a fifth of it
    head = size - -(-NUMERATOR * size // DENOMINATOR) + 1
    short = np.arange(len(rare)) - np.repeat(start, size) < np.repeat(head, size)
    post = np.argsort(rare[short], kind="stable")
    starters, heads = owner[order][short][post], np.searchsorted(rare[short][post], np.arange(len(many) + 1))
    names, at = np.unique(np.array(own), return_inverse=True)
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    def runs(of: np.ndarray, edges: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([of[edges[t] : edges[t + 1]] for t in tokens.tolist()])

    most = np.bincount(at).argmax()
    for x in np.flatnonzero(at != most).tolist():
        mine = rare[start[x] : start[x] + size[x]]
        meets = np.unique(runs(starters, heads, mine[: head[x]]))
        if not any(find(at[y]) != find(at[x]) for y in meets.tolist()):
            continue
        both = np.bincount(runs(holders, first, mine), minlength=len(sets))
        for y in meets[DENOMINATOR * both[meets] >= NUMERATOR * (size[x] + size[meets] - both[meets])].tolist():
            if find(at[y]) != find(at[x]):
                root[find(at[y])] = find(at[x])
                yield x, y


def _joined(t: pa.Table) -> pa.Table:
    """Stars of the links within each group (key, low, high) of t."""
    cell = np.stack([t.column(c).to_numpy() for c in ("key", "low", "high")])
    order = np.lexsort(cell)
    edges = np.flatnonzero(np.r_[True, (cell[:, order][:, 1:] != cell[:, order][:, :-1]).any(axis=0), True]) if len(order) else [0]
    own, unit, hashes = t.column("own").to_numpy(), t.column("unit").to_numpy(), t.column("hashes").combine_chunks()
    a, b = [], []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        rows = order[lo:hi]
        if len(set(own[rows].tolist())) > 1:
            for x, y in group_links(own[rows].tolist(), [np.frombuffer(hashes[int(k)].as_buffer(), dtype=np.uint32) for k in rows]):
                a.append(unit[rows[x]])
                b.append(unit[rows[y]])
    a, b = stars(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _within_groups(named: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of named(key, unit, own) that share a key, written."""
    apart = named.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.ceil(F.count(F.lit(1)) / GROUP).alias("blocks")).where("x <> y").select("key", "blocks")
    apart = materialise(apart, "apart")
    dealt = named.join(apart, "key").withColumn("mine", F.pmod(F.xxhash64("unit"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "unit", "own").join(sets, "unit")
    dealt = materialise(dealt, "groups")
    total = dealt.select(F.sum(F.octet_length("hashes"))).first()[0] or 0
    # several for each partition, so that large groups spread evenly
    tasks = max(16 * partitions(named.sparkSession), -(-total // TASK_BYTES))
    found = dealt.withColumn("dest", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks))).groupBy("dest").applyInArrow(_joined, "a long, b long")
    found = materialise(found, "more")
    remove(apart, dealt)
    return found


def near_copies(marked: DataFrame) -> DataFrame:
    """(node, component) of units that are linked to others: by SimHash where marked has fp, completed by bands."""
    sets = marked.select("unit", "hashes").groupBy("unit").agg(F.first("hashes").alias("hashes"))
    links, found = None, None
    if "fp" in marked.columns:
        alike = simhash_groups(marked)
        if not alike.isEmpty():
            links, found = _joined_groups(alike, sets, None, None)
        remove(alike)
        trim(marked.sparkSession)  # what planning the first half took of the driver's memory
    bands = materialise(marked.select("unit", "n", F.explode("keys").alias("key")).distinct(), "bands")
    links, done = _joined_groups(bands, sets, links, found)
    remove(bands, links)
    trim(marked.sparkSession)
    return done


def simhash_groups(marked: DataFrame) -> DataFrame:
    """(unit, n, key) of units whose fingerprints are linked: key is the least fingerprint of their component."""
    units = materialise(marked.where("n > 0").select("unit", "n", "fp").distinct(), "units")
    distinct = materialise(units.select("fp").distinct(), "distinct")
    found = components(link_stars(distinct, distinct.count()))
    named = units.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("unit", "n", F.coalesce("component", "fp").alias("key"))
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    out = materialise(named.join(several, "key").select("unit", "n", "key"), "alike")
    remove(units, distinct, found)
    return out


def _joined_groups(bands: DataFrame, sets: DataFrame, links: DataFrame | None, found: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(links, components) with those of bands(unit, n, key) among units of one key, each verified, added to those there; what was there goes."""
    # each band of a group has a centre of its own, so a member is compared to many of the others
    drawn = F.struct(F.xxhash64("unit", "key").alias("turn"), "unit", "n")
    centres = bands.groupBy("key").agg(F.min(drawn).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("c.unit").alias("centre"), F.col("c.n").alias("m"))
    centres = materialise(centres, "centres")
    met = materialise(bands.join(centres, "key"), "met")
    remove(centres)
    sets = materialise(sets.join(met.select("unit").distinct(), "unit", "left_semi"), "sets")

    tried = met.where((F.col("unit") != F.col("centre")) & _sized("n", "m")).select(F.col("centre").alias("a"), F.col("unit").alias("b")).distinct()
    if found is not None:
        # what is linked already needs no second proof
        own = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        tried = tried.join(own("a"), "a", "left").join(own("b"), "b", "left").where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")
    proven = _verified(tried, sets)
    new = materialise(proven if links is None else links.unionByName(proven), "links")
    old, links = [x for x in (links, found) if x is not None], new
    found = components(links)
    named = met.select("key", "unit").join(found.withColumnRenamed("node", "unit"), "unit", "left")
    named = materialise(named.select("key", "unit", F.coalesce("component", "unit").alias("own")), "named")
    remove(met, *old)
    more = _within_groups(named, sets)
    if not more.isEmpty():
        first, every = found, materialise(links.unionByName(more), "links")
        found = components(every)
        remove(first, links)
        links = every
    remove(sets, named, more)
    return links, found


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near copies: of its smallest doc_id, and of rows that share that, one."""
    marked = materialise(_marked(docs), "shingles")
    found = near_copies(marked)
    kept = kept_rows(docs, marked.select("doc_id", "text_hash", "unit"), found)
    remove(marked, found)
    return kept

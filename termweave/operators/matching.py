"""Matching of texts against dictionaries and of blocks of rows against each other.

Dictionary keywords match leftmost, longest, without overlaps, in any case. A lowered
text is cut into runs of word and other characters. The dictionary comes to the tasks
in blocks of at most about DICTIONARY_BYTES; a task looks up every span of runs that
begins with a keyword's first run and has as many runs as one, so only hits leave it.
A fold over the hits by place keeps those that begin after the last kept one ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ASCII_WORD, WORD

#: Bytes of keywords in one broadcast block.
DICTIONARY_BYTES = 8 << 20


def _runs(text: str, mode: str) -> Column:
    word = WORD if mode == "unicode" else ASCII_WORD
    other = word.replace("[", "[^", 1)
    pieces = f"({word}+|{other}+)" if mode == "unicode" else f"({word}+|{other})"
    return F.regexp_extract_all(F.lower(text), F.lit(pieces), F.lit(1))


def _blocks(dictionary: DataFrame, mode: str, limit: int) -> Iterator[dict[str, dict[int, set[str]]]]:
    """The keywords by first run and number of runs, block by block at the driver; in unicode mode those that begin and end with a word."""
    total = dictionary.select(F.sum(F.octet_length("keyword"))).first()[0] or 0
    count = -(-total // limit)
    runs = dictionary.select("keyword", _runs("keyword", mode).alias("runs")).where("size(runs) > 0")
    if mode == "unicode":
        runs = runs.where((F.size("runs") % 2 == 1) & F.regexp_like(F.col("runs")[0], F.lit(f"^{WORD}")))
    runs = runs.select("keyword", F.col("runs")[0].alias("first"), F.size("runs").alias("n"))
    for k in range(count):
        block: dict[str, dict[int, set[str]]] = {}
        for r in runs.where(F.pmod(F.xxhash64("keyword"), F.lit(count)) == k).collect():
            block.setdefault(r.first, {}).setdefault(r.n, set()).add(r.keyword)
        yield block


def raw_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, mode: str = "unicode", limit: int = DICTIONARY_BYTES) -> DataFrame:
    """(key, start, stop, keyword) of each span that is a keyword; start and stop count runs."""
    spark, kind = texts.sparkSession, texts.schema[key].dataType
    cut = texts.select(F.col(key).alias("key"), _runs(text, mode).alias("runs")).where(F.size("runs") > 0)
    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("keyword", T.StringType())])
    out = spark.createDataFrame([], schema)
    for block in _blocks(dictionary, mode, limit):
        table = spark.sparkContext.broadcast(block)

        def look(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            known = table.value
            for batch in batches:
                row, start, stop, found = [], [], [], []
                for i, runs in enumerate(batch.column(1)):
                    runs = runs.as_py()
                    for at, run in enumerate(runs):
                        for n, words in known.get(run, {}).items():
                            if at + n <= len(runs) and (span := run if n == 1 else "".join(runs[at : at + n])) in words:
                                row.append(i)
                                start.append(at + 1)
                                stop.append(at + n + 1)
                                found.append(span)
                keys = batch.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(found, pa.string())], names=["key", "start", "stop", "keyword"])

        out = out.unionAll(cut.mapInArrow(look, schema))
    return out.withColumnRenamed("key", key)


def keyword_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, mode: str = "unicode", limit: int = DICTIONARY_BYTES) -> DataFrame:
    """(key, keyword, start) of each accepted hit; dictionary(keyword) is lower-cased and distinct. Terms have any number of words."""
    found = raw_hits(texts, key, text, dictionary, mode, limit)
    hit = F.struct("start", (-F.col("stop")).alias("far"), "keyword")
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    empty = F.struct(F.lit(0).cast("long").alias("last"), F.expr("cast(array() as array<struct<start:bigint,far:bigint,keyword:string>>)").alias("kept"))
    folded = F.aggregate("hits", empty, lambda a, h: F.when(h["start"] >= a["last"], F.struct((-h["far"]).alias("last"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a))
    return listed.select(key, F.explode(folded["kept"]).alias("h")).select(key, "h.keyword", "h.start")


def first_hits(hits: DataFrame, key: str) -> DataFrame:
    """One row for each text and keyword, at its first place."""
    return hits.groupBy(key, "keyword").agg(F.min("start").alias("start"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def by_blocks(left: DataFrame, right: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = 8192, limit: int = 4 << 20, band: str | None = None) -> DataFrame:
    """meet() over every pair of a block of left and a block of right: a query set against all rows.

    A block has about `rows` rows or `limit` bytes, whichever is less, so a task's memory does not
    grow with either side; nothing is broadcast. With band, only rows that agree in it meet.
    """

    def blocks(df: DataFrame) -> DataFrame:
        size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)), F.lit(0))
        size = sum((4 * F.coalesce(F.size(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.ArrayType)), size)
        own = df.withColumn("_band", F.col(band) if band else F.lit(0))
        # a row a band
        return own.groupBy("_band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum(size) / limit)).cast("int").alias("n"))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        x = df.withColumn("_band", F.col(band) if band else F.lit(0)).join(plan, "_band")
        x = x.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(f"n{mine}")).cast("int"))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).drop("n_l", "n_r")

    # a handful of numbers for each band
    plan = blocks(left).withColumnRenamed("n", "n_l").join(blocks(right).withColumnRenamed("n", "n_r"), "_band")
    counts = plan.collect()
    plan = F.broadcast(left.sparkSession.createDataFrame(counts, plan.schema))
    cell = ["_band", "_l", "_r"]
    # cells cost by the pairs they hold, not by their bytes, so they are not gathered into few tasks
    tasks = max(1, min(2048, sum(r.n_l * r.n_r for r in counts)))
    names = left.columns, right.columns

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet(a.select(names[0]), b.select(names[1]))

    return dealt(left, "_l", "_r").repartition(tasks, *cell).groupBy(*cell).cogroup(dealt(right, "_r", "_l").repartition(tasks, *cell).groupBy(*cell)).applyInArrow(run, schema)


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, qid) of texts(id, text) that hold patterns(qid, pattern), exactly as they are written."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        held = Held(a.column("text").to_pylist())
        at, ids = [], []
        for k, pattern in enumerate(b.column("pattern").to_pylist()):
            rows = held.rows(pattern)
            ids += rows
            at += [k] * len(rows)
        return pa.table({"id": a.column("id").take(pa.array(ids, pa.int64())), "qid": b.column("qid").take(pa.array(at, pa.int64()))})

    kind = texts.schema["id"].dataType.simpleString()
    x, p = texts.select("id", "text").where("text IS NOT NULL"), patterns.select("qid", "pattern").where("pattern IS NOT NULL")
    return by_blocks(x, p, meet, f"id {kind}, qid {patterns.schema['qid'].dataType.simpleString()}")


class Held:
    """Texts as one string, in which a pattern's rows are found at the speed of a search in it."""

    def __init__(self, texts: list[str]):
        self.starts, parts, at = [], [], 0
        for t in texts:
            self.starts.append(at)
            parts.append(t)
            at += len(t) + 1
        self.text, self.end = "\0".join(parts), at

    def rows(self, pattern: str) -> list[int]:
        from bisect import bisect_right

        if not pattern or "\0" in pattern:
            return [i for i, s in enumerate(self.starts) if pattern in self.text[s : (self.starts[i + 1] if i + 1 < len(self.starts) else self.end) - 1]]
        out, at = [], self.text.find(pattern)
        while at >= 0:
            row = bisect_right(self.starts, at) - 1
            out.append(row)
            at = self.text.find(pattern, self.starts[row + 1]) if row + 1 < len(self.starts) else -1
        return out

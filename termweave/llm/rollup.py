"""Token counts kept as additive rollups of signed deltas.

A batch of changes (inserts, deletes, revised counts) is added up by source,
language and tokenizer version to signed numbers of documents and tokens, and
written under its batch id in one commit; the totals are the sum over batches.
A batch id that is committed is not applied again, and an attempt that failed
leaves nothing that counts, so a batch may be sent any number of times.
compact() adds a sum that names the batches in it, by one rename; what it covers is
ignored from then on, and removed. A crash at any point leaves either state whole.

Changes have the columns op ('insert', 'delete', 'revise'), source, lang,
tokenizer, tokens (of the text as it is, or was when deleted) and old_tokens
(of the revised text before). A column times, where there is one, says how often
a change stands there, so that equal changes may come as one row. Nulls: null
source, lang or tokenizer are values of their own; a null count is 0, null times
is 1; a null or unknown op fails the batch. Rows that repeat within a batch count
as often as they stand there. An empty batch commits and changes nothing. A very long
text is counted whole. Columns beside these are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_path, text_slices

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Totals in a folder of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, dots and dashes only")
        return f"{self.path}/batch={batch_id}"

    def _names(self, folder: str) -> list[str]:
        store, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The last sum, the ids in it, and the batches that it does not cover."""
        names = self._names(self.path)
        sums = sorted((n for n in names if n.startswith("sum=")), key=lambda n: int(n[4:]))
        last = sums[-1] if sums else None
        ids = {x[3:] for x in self._names(f"{self.path}/{last}/ids")} if last else set()
        return last, ids, [n for n in names if n.startswith("batch=") and n[6:] not in ids]

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        _, ids, batches = self._state()
        return ids | {n[6:] for n in batches}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before. The batch counts from the rename of its folder on."""
        folder = self._folder(batch_id)
        if batch_id in self.committed():
            return False
        attempt = f"{self.path}/_attempt-{batch_id}"
        self.deltas(changes).write.mode("overwrite").parquet(attempt)
        store, p = self._fs(attempt)
        if not store.rename(p, self._fs(folder)[1]):
            raise OSError(f"{folder} can't be made")
        return True

    @staticmethod
    def deltas(changes: DataFrame) -> DataFrame:
        tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        times = F.coalesce("times", F.lit(1)) if "times" in changes.columns else F.lit(1)
        x = changes.select(*KEYS, known.alias("op"), tokens.alias("tokens"), old.alias("old"), times.cast("long").alias("times"))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        moved = F.when(F.col("op") == "revise", F.col("tokens") - F.col("old")).otherwise(sign * F.col("tokens"))
        return x.groupBy(KEYS).agg(F.sum(sign * F.col("times")).cast("long").alias("docs"), F.sum(moved * F.col("times")).cast("long").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); keys whose documents and tokens are all gone are left out."""
        last, _, batches = self._state()
        kept = [f"{self.path}/{n}" for n in batches] + ([f"{self.path}/{last}/totals"] if last else [])
        rows = self.spark.read.schema(DELTA).parquet(*kept) if kept else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """One sum for all batches so far, built aside and put in place by one rename; only then do those it covers go."""
        last, ids, batches = self._state()
        fresh, attempt = f"{self.path}/sum={int(last[4:]) + 1 if last else 0}", f"{self.path}/_attempt-sum"
        store, p = self._fs(attempt)
        store.delete(p, True)
        self.totals().write.parquet(f"{attempt}/totals")
        for i in sorted(ids | {n[6:] for n in batches}):
            store.mkdirs(self._fs(f"{attempt}/ids/id={i}")[1])
        if not store.rename(p, self._fs(fresh)[1]):
            raise OSError(f"{fresh} can't be made")
        self.clean()

    def clean(self) -> None:
        """Removes what the last sum covers; a crash in between leaves it to the next call."""
        last, ids, _ = self._state()
        for n in self._names(self.path):
            if (n.startswith("sum=") and n != last) or (n.startswith("batch=") and n[6:] in ids):
                store, p = self._fs(f"{self.path}/{n}")
                store.delete(p, True)


#: Where the vocabularies are, and the tokenizer version that each file stands for.
TOKENIZERS = "/opt/tokenizers"
VERSIONS = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how byte-level vocabularies of this family cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is longer is cut out by hand, as the pattern's look-ahead does not bear it.
LONG = 4096
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


class Counter:
    """Token counts by one vocabulary in tiktoken's format."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        total, at = 0, 0
        for m in _BLANKS.finditer(text):
            # the last blank before another character belongs to what follows
            end = m.end() - (m.end() < len(text))
            total += len(self.coder.encode_ordinary(text[at : m.start()])) + len(self.coder._encode_single_piece(text[m.start() : end]))
            at = end
        return total + len(self.coder.encode_ordinary(text[at:]))


def vocabularies(folder: str = TOKENIZERS, versions: dict[str, str] = VERSIONS) -> dict[str, bytes]:
    """The files' bytes, read at the driver; some 1 MB each, so tasks get them by broadcast and need no such folder."""
    out = {}
    for name, file in versions.items():
        with open(f"{folder}/{file}", "rb") as f:
            out[name] = f.read()
    return out


def token_counts(docs: DataFrame, known: dict[str, bytes], pattern: str = PATTERN) -> DataFrame:
    """docs with text left out, and by version in the order of known: tokens of the text, and of the text freed of white space at its ends."""
    table = docs.sparkSession.sparkContext.broadcast(list(known.values()))
    rest = [c for c in docs.columns if c != "text"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter(v, pattern) for v in table.value]
        for batch in batches:
            for rows in text_slices(batch):
                first, then = [], []
                for t in rows.column(rows.schema.get_field_index("text")).to_pylist():
                    t = t or ""
                    bare = t.strip()
                    first.append([c.count(t) for c in counters])
                    then.append(first[-1] if bare == t else [c.count(bare) for c in counters])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (first, then)]
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in rest), *lists], names=[*rest, "tokens", "bare_tokens"])

    fields = [docs.schema[c] for c in rest] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("tokens", "bare_tokens")]
    return docs.mapInArrow(add, T.StructType(fields))


def history(docs: DataFrame, known: dict[str, bytes] | None = None, path: str | None = None) -> DataFrame:
    """The totals after three batches: all documents come, counted by every version; those that begin or end in
    white space are freed of it, and their counts revised; of equal texts all but one row go. That one has the
    smallest (doc_id, source, lang), nulls first; a row that repeats counts as a copy."""
    spark, known = docs.sparkSession, vocabularies() if known is None else known
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), digest, "text")
    counted = materialise(token_counts(slim, known), "counts")
    # copies of a text in one source and language are one row before they meet the row that stays
    groups = counted.groupBy("digest", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id")).alias("least"), F.first("bare_tokens").alias("bare_tokens"))
    stays = groups.groupBy("digest").agg(F.min(F.struct("least", "source", "lang")).alias("stay"))
    gone = groups.join(stays, "digest").withColumn("times", F.col("n") - F.struct("least", "source", "lang").eqNullSafe(F.col("stay")).cast("long"))
    versions = F.array(*[F.lit(v) for v in known]) if known else F.array().cast("array<string>")

    def rows(df: DataFrame, op: str, tokens: str, old: str | None = None) -> DataFrame:
        times = F.col("times") if "times" in df.columns else F.lit(1).cast("long")
        each = df.select("source", "lang", times.alias("times"), F.explode(F.arrays_zip(versions.alias("v"), F.col(tokens).alias("t"), F.col(old or tokens).alias("o"))).alias("x"))
        return each.select(F.lit(op).alias("op"), "source", "lang", F.col("x.v").alias("tokenizer"), F.col("x.t").alias("tokens"), (F.col("x.o") if old else F.lit(0).cast("long")).alias("old_tokens"), "times")

    book = Rollup(spark, path or shared_path(spark, "rollup"))
    arrive = rows(counted, "insert", "tokens")
    revise = rows(counted.where(F.col("tokens") != F.col("bare_tokens")), "revise", "bare_tokens", "tokens")
    leave = rows(gone.where("times > 0"), "delete", "bare_tokens")
    for batch, changes in (("1-arrive", arrive), ("2-revise", revise), ("3-leave", leave), ("2-revise", revise)):
        book.commit(batch, changes)
    return book.totals()

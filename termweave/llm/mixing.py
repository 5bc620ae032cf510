"""Mixing of sources to target weights, by Sainte-Lague apportionment; DataFrame functions only.

Sources by code point (null last) weigh 1, 2, 3, 1, 2, 3, ...; their targets
share the words of all documents by weight, each at most CAP times what its
source has, the excess shared again by weight among the others until none is
above. The target of source i is so min(CAP * size_i, level * weight_i) for one
level, which a running sum over the sources in the order of size / weight finds.

The words are given out in blocks of BLOCK: sources, then the shards of each
source (rows by hash of doc_id, about SHARD_ROWS each, so a source with a third
of all rows is many shards), get blocks by highest quotients votes / (2 k + 1).
Quotients below those that surely win are not enumerated. Within a shard,
documents stand in a seeded order, one after the other; as many blocks as the
quota says are taken from it, round after round, so every word is taken
quota // words or one time more, and no document more than CAP times its size.

What is taken of a document is taken // size whole passes over its words, and of one
more pass the first taken % size words.

Nulls: a null text has no words; null sources are one source, the last. Rows are
dealt to shards by doc_id and text, so a null or repeated doc_id is no hot key.
Repeated rows are documents of their own. Empty tables give an empty result. A very
long text is counted whole. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAP, BLOCK, SHARD_ROWS, SEED = 3, 16, 1000, 20


def word_count(text: Column | str) -> Column:
    """Runs of anything but space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, source_size) with weight and target."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    # if all sources before this one in the order of room are full, the rest is shared at this level
    left = F.sum("source_size").over(every) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = x.withColumn("level", left.cast("double") / share.cast("double"))
    fits = F.when(F.col("level") * F.col("weight") <= CAP * F.col("source_size"), F.col("level"))
    x = x.withColumn("level", F.coalesce(F.first(fits, ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return x.withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))).drop("level")


def apportion(units: DataFrame, votes: str, blocks: Column, within: list[str], order: list[Column]) -> DataFrame:
    """units with quota: blocks (one number for each group of within) by highest quotients votes / (2 k + 1).

    With total votes V and n units, the divisor V / (blocks - n / 2) gives no
    unit more than it wins, V / (blocks + n / 2) none less; only the quotients
    between compete.
    """
    group = Window.partitionBy(*within)
    ranked = Window.partitionBy(*within).orderBy(F.desc("quotient"), *order)
    x = units.withColumn("blocks", blocks).withColumn("all_votes", F.sum(votes).over(group)).withColumn("units", F.count(F.lit(1)).over(group))

    def at(divisor_blocks: Column) -> Column:
        return F.when((F.col("all_votes") > 0) & (divisor_blocks > 0), F.floor(F.col(votes) * divisor_blocks / F.col("all_votes") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")

    x = x.withColumn("sure", at(F.col("blocks") - F.col("units") / 2)).withColumn("most", at(F.col("blocks") + F.col("units") / 2 + 1))
    x = x.withColumn("most", F.greatest("most", "sure"))
    seats = x.where("most > sure").select("*", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("k")).withColumn("quotient", F.col(votes) / (2 * F.col("k") + 1))
    sure = x.groupBy(*within).agg(F.sum("sure").alias("sure_all"))
    keys = [seats[c].eqNullSafe(sure[c]) for c in within]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    won = seats.withColumn("place", F.row_number().over(ranked)).join(sure, on).where(F.col("place") <= F.col("blocks") - F.col("sure_all"))
    won = won.groupBy("unit").agg(F.count(F.lit(1)).alias("extra"))
    return x.join(won, "unit", "left").withColumn("quota", F.col("sure") + F.coalesce("extra", F.lit(0))).drop("blocks", "all_votes", "units", "sure", "most", "extra")


def mix(docs: DataFrame, columns: list[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs; the columns asked for come in a struct `kept`."""
    every = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("row"), *([F.struct(*columns).alias("kept")] if columns else []))
    sized = materialise(every.drop("kept"), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(per_source).withColumn("shards", F.ceil(F.col("rows") / SHARD_ROWS).cast("int"))
    plan = plan.withColumn("unit", F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).withColumn("all", F.lit(1))
    total = F.floor(F.sum("target").over(Window.partitionBy("all")) / BLOCK + F.lit(0.5)).cast("long")
    plan = materialise(apportion(plan, "target", total, ["all"], [F.col("source").cast("binary").asc_nulls_last()]), "plan")
    # a handful of numbers a source; joined by hash, as sources have no proven bound
    shares = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "shards", F.col("quota").alias("source_quota"))

    def deal(rows: DataFrame) -> DataFrame:
        x = rows.join(shares, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
        x = x.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(SEED)), F.col("shards").cast("long")))
        return x.withColumn("unit", F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "shard"))

    units = deal(sized).groupBy("unit", "source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = apportion(units, "shard_size", F.col("source_quota"), ["source"], [F.col("shard")]).select(F.col("unit").alias("u"), F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "quota")
    quotas = materialise(quotas, "quotas")
    # rows meet their shard's quota and take their place in it by one key, so what they carry moves once
    placed = deal(every if columns else sized).join(quotas, (F.col("unit") == F.col("u")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    seeded = Window.partitionBy("unit", "source", "shard").orderBy(F.xxhash64("row", F.lit(SEED + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("before", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    words = F.least(F.col("quota") * BLOCK, CAP * F.col("shard_size"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    rest = words - rounds * F.col("shard_size") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["kept"] if columns else []))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with all their columns in `kept`: passes whole readings of the text, and of one more the first head_words words."""
    out = mix(docs, docs.columns).where("taken > 0")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("long").alias("passes"), (F.col("taken") % F.greatest("size", F.lit(1))).alias("head_words"), "kept")


#: The result but for taken, whose choice of documents is the operator's own.
TARGET_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS place
  FROM w WINDOW b AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT coalesce((SELECT level FROM r WHERE level * weight <= 3 * source_size ORDER BY place LIMIT 1), 'Infinity'::DOUBLE) AS level)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, least((3 * r.source_size)::DOUBLE, l.level * r.weight) AS target
FROM sized d JOIN r ON d.source IS NOT DISTINCT FROM r.source, l
"""

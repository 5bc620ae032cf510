"""Quality checks on segments(seg_id, source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def filled(segments: DataFrame) -> DataFrame:
    return segments.where(F.coalesce(strip("target"), F.lit("")) != "")


def numbers(segments: DataFrame) -> DataFrame:
    """A warning where the sets of numbers differ; numbers are listed in order."""
    of = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(\d+)"), F.lit(1)))
    x = filled(segments).withColumns({"missing": F.array_sort(F.array_except(of("source"), of("target"))), "extra": F.array_sort(F.array_except(of("target"), of("source")))})
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {name}: "), F.array_join(c, ", "), F.lit("."))).otherwise("")
    message = F.concat(F.lit("Number mismatch."), part("Missing", "missing"), part("Extra", "extra"))
    return x.where((F.size("missing") > 0) | (F.size("extra") > 0)).select("seg_id", F.lit("numbers").alias("check"), F.lit("warning").alias("type"), message.alias("message"))


def terms(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """An error for each glossary hit (seg_id, source_term, target_term) whose target term is not in the target."""
    x = filled(segments).join(hits, "seg_id")
    bad = F.contains(F.lower("source"), F.lower("source_term")) & ~F.contains(F.lower("target"), F.lower("target_term"))
    message = F.concat(F.lit("Glossary violation: '"), "source_term", F.lit("' should be translated as '"), "target_term", F.lit("'."))
    return x.where(bad).select("seg_id", F.lit("terms").alias("check"), F.lit("error").alias("type"), message.alias("message"))


def punctuation(segments: DataFrame) -> DataFrame:
    ends = lambda c: F.regexp_like(c, F.lit(r"[.!?]\z"))
    x = filled(segments).withColumns({"a": ends("source"), "b": ends("target")}).where("a <> b")
    message = F.when(F.col("a"), F.lit("Source ends with punctuation, target does not.")).otherwise(F.lit("Target ends with punctuation, source does not."))
    return x.select("seg_id", F.lit("punctuation").alias("check"), F.lit("warning").alias("type"), message.alias("message"))


def check(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """All warnings (seg_id, check, type, message)."""
    return numbers(segments).unionByName(terms(segments, hits)).unionByName(punctuation(segments))


def rollup(segments: DataFrame, warnings: DataFrame) -> DataFrame:
    """(seg_id, errors, warnings) of segments with a target."""
    flags = warnings.groupBy("seg_id").agg(F.bool_or(F.col("type") == "error").alias("errors"), F.bool_or(F.col("type") == "warning").alias("warnings"))
    return filled(segments).select("seg_id").join(flags, "seg_id", "left").select("seg_id", F.coalesce("errors", F.lit(False)).alias("errors"), F.coalesce("warnings", F.lit(False)).alias("warnings"))

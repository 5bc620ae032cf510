"""Projects and their exports: segments(project_id, id, source, target, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty, percent_done, strip
from ..functions.text import vocabulary as words_of


def progress(segments: DataFrame) -> DataFrame:
    """(project_id, total, done, percent)."""
    x = segments.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"))
    return x.withColumn("percent", percent_done(F.col("done"), F.col("total")))


def export_text(segments: DataFrame) -> DataFrame:
    """(project_id, body): of each segment its target if filled, else its source, with an empty line between."""
    line = F.coalesce(nonempty(strip("target")), strip("source"))
    listed = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return segments.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n\n").alias("body"))


def export_paragraphs(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """paragraphs(at, text) with the filled target of the last segment with this source, if there is one."""
    last = segments.groupBy(F.col("source").alias("key")).agg(F.max_by("target", "id").alias("target"))
    return paragraphs.join(last, strip("text") == F.col("key"), "left").select("at", F.coalesce(F.when(strip("target") != "", F.col("target")), F.col("text")).alias("text"))


def as_documents(segments: DataFrame, projects: DataFrame) -> DataFrame:
    """projects(id, filename, lang_pair, active_index, saved_at) with nested segments, total and done."""
    s = segments.groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "source", "target", "status"))).alias("segments"))
    return projects.join(s, "id", "left").withColumns({"total": F.coalesce(F.size("segments"), F.lit(0)), "done": F.size(F.filter("segments", lambda x: x["status"] == "done"))})


def confirm(segments: DataFrame, chosen: DataFrame, source_lang: str, target_lang: str) -> tuple[DataFrame, DataFrame]:
    """chosen(project_id, id) confirmed: segments with these done where they have a target, and each with the id that comes
    next in its project; and the pairs (pos, source, target, source_lang, target_lang) to promote and to append to the memory."""
    marked = segments.join(chosen.select("project_id", "id", F.lit(True).alias("_chosen")).distinct(), ["project_id", "id"], "left")
    ok = F.coalesce(F.col("_chosen"), F.lit(False)) & (F.coalesce(strip("target"), F.lit("")) != "")
    after = F.lead("id").over(Window.partitionBy("project_id").orderBy("id"))
    done = marked.select(*[F.when(ok, F.lit("done")).otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in segments.columns], after.alias("next_id"))
    pairs = marked.where(ok).select(F.xxhash64("project_id", "id").alias("pos"), "source", "target", F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"))
    return done, pairs


def vocabulary(segments: DataFrame) -> DataFrame:
    """(project_id, word): the words of 3 or more characters in a project's sources and targets."""
    both = segments.select("project_id", F.explode(F.array("source", "target")).alias("text")).where("text IS NOT NULL")
    return both.select("project_id", F.explode(words_of("text")).alias("word")).distinct()

"""A training corpus from documents, in stages that each write what they keep.

Every stage reads all that the one before it kept, whole texts, and returns the columns
of documents as they were, whatever else they are called; the last adds what the mix
takes. Rows are judged one by one: a null doc_id or one that repeats loses no other row.
A null or empty text is not toxic, has no words and no repeats; of texts without words
the near dedup keeps one. Ties go to the smallest doc_id, then to the smallest hash of
the text. A very long text is held whole by one task of each stage. Empty tables pass
through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import decontam, mixing, near, suffix_dedup, toxicity
from termweave.llm.common import materialise, remove, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keeps the smallest doc_id: those SimHash finds, verified by the Jaccard of
    five-word shingles (0.8 or more), and what its few bits lose between such texts."""
    return near.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that repeat earlier ones; a document of which nothing is left goes."""
    return suffix_dedup.keep_unrepeated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what stands in the benchmark."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with all its columns in kept; those it takes nothing of go."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read goes then."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and iterated components have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None

"""The corpus pipeline: documents in, clean encoded documents out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from silverleaf.lineage import checkpoint_dir
from silverleaf.llm import decontamination, language_id, near_dedup, queries, toxicity
from silverleaf.llm.common import read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays unclear, go."""
    return language_id.keep_known(docs, language_id.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item's question and answer go."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return queries.encoded(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", near_duplicates),
    ("decontamination", not_in_benchmark),
    ("bpe", encoded),
]

#: No stage is expressible in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again.

    A stage's folder goes when the next has been written; the last one, which the result
    reads, when the session's JVM ends. Awkward rows are as the stages' operators say:
    null and empty texts have no language and go in the first; of rows that repeat, with
    an id or without, one stays; an empty table gives an empty result. Columns other than
    doc_id and text are carried along, whatever their names.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(folder)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        there = f"{folder.toString()}/{name}"
        stage(spark, docs, sf_dir).write.parquet(there)
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(before), True)
        docs, before = spark.read.parquet(there), there
    return STAGES[-1][1](spark, docs, sf_dir)

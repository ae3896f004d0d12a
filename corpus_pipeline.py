"""A corpus pipeline of four of the operators of tallyloom.llm; part of that subpackage.

Each stage takes (spark, docs, sf_dir) and returns the table that the next one reads; run() writes each stage's rows as Parquet to the
folder that driver and executors share, deletes a stage's table once the next one is written, and the last one's when the session's process ends.

All stages take null and empty texts as texts without words, texts of any length, tables without rows and further columns of any name;
what each does with repeated rows, null ids and ties is said at its function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import minhash, packing, passages, quality
from tallyloom.llm.common import delete, delete_at_exit, shared_dir, table
from tallyloom.llm.queries import VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of all documents.

    Each row is judged by its text alone, so repeated rows stay or go together; a score of exactly 0.5 stays. Without labels all rows stay.
    """
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id, of equal ids that whose text has the least MD5.

    Rows without doc_id stay; of rows that repeat an id and text one stays. Empty and null texts are copies of each other.
    """
    return minhash.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier row has, in Spark's reading order; those left without words go, those that had none stay.

    Each row is a document of its own, whether its doc_id repeats or is null.
    """
    return passages.without_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in token sequences; each row is packed, repeated or not, and one without text is its end token."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality", good_quality), ("near_dedup", one_of_near_copies), ("substring_dedup", without_repeated_passages), ("packing", packed)]

#: SQL has no twin of the trained classifier, the tokenizer and the retrieval order; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    delete_at_exit(spark, folder)
    return docs

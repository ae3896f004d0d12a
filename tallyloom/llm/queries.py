"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, codes, embeddings, fingerprints, idfiles, licences, lm, minhash, packing, passages, quality, sql, urls
from .common import table


#: The vocabulary file of the queries that need tokens.
VOCABULARY = "word_bpe_49k.json"


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.learn(docs)).drop("found")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), quality.in_fold("doc_id", 7, 2))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Fixed rules (verdict, host, path prefix) that op5_url_filters puts before the mined ones.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    block = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    rules = urls.mine(pages, labels.select(F.col("doc_id").alias("page_id"), block.alias("block")))
    return urls.judge(pages, rules, URL_RULES)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(~quality.in_fold("doc_id", 3, 1)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.in_fold("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_edits(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    coded = codes.with_label_error(codes.compress(vectors, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return clusters.with_inertia(*clusters.cluster(vectors, clusters.first_centroids(vectors)))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = idfiles.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, end=1)
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_licence_scan, op2_lm_scoring, op3_packing, op4_minhash_near_dedup, op5_url_filters, op6_quality_classifier, op7_bpe_round_trip, op8_embedding_near_dedup, op9_document_fingerprints, op10_substring_dedup, op11_vector_codes, op12_centroid_clusters, op13_token_files]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: whole-number rounds over vectors."""
    return {"op11_vector_codes": sql.vector_codes(), "op12_centroid_clusters": sql.centroid_clusters()}

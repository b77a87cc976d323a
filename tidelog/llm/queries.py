"""Registered queries of this subpackage: name -> query, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm import (ann, decontam, divergence, licenses, merkle, packing, quality, repeats, secrets, simhash, token_counts, token_store,
                         warc)
from tidelog.llm.checks import DIVERGENCE_SQL, REPEATS_SQL, merkle_sql
from tidelog.llm.common import table

TOKENIZER = "byte_bpe_50k.json"

Run = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    """The installed file of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2, added=True)
    return token_store.read_digests(manifest)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer_file(), added=True)
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), path_col="source")
    return found.select("doc_id", "pos", "digest", "length", "coverage", "score", "is_secret")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), window=1024, end_id=0, added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.checked(merkle.proofs(merkle.build(docs, merkle.tampered(docs))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Run] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_token_store, op3_decontamination, op4_warc, op5_token_counts, op6_secret_scan, op7_license_scan, op8_quality, op9_packing, op10_tree_search,
    op11_merkle_manifest, op12_source_divergence, op13_suffix_dedup)}
ORACLES: dict[str, str] = {
    "op11_merkle_manifest": merkle_sql(), "op12_source_divergence": DIVERGENCE_SQL, "op13_suffix_dedup": REPEATS_SQL}

"""The thin queries of this subpackage: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, minhash, packing, periodic, phrases, quality, sharding, substring_dedup, suffix_dedup, token_files, topk
from .oracles import ORACLE_SQL  # noqa: F401
from .store import new_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 8, law="bytes", store=new_path(spark, "slot-map"))[0]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), threshold=0.8).select("doc_id", "class_id")


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(_documents(spark, sf_dir))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=64)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20).select(F.col("query_id"), F.col("rank"), F.col("vec_id"), F.col("score"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.echoed(_documents(spark, sf_dir)), min_exp=4, least=6))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir), longest=5, least=100, top=2000)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learned_and_judged(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_best_fit_packing, op4_sharding, op5_byte_bpe, op6_minhash_near_dedup, op7_merkle_fingerprints, op8_exact_topk, op9_token_files, op10_suffix_dedup, op11_periodic_runs, op12_phrase_mining, op13_language_id)}

"""A training corpus from raw documents: quality, near-duplicates, shared passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents; n_chars follows the text.

Null and empty texts: the classifier scores them as texts without words; those it keeps are one class of equal texts, of which one
document stays; the substring stage makes a null text an empty one, with n_chars 0; packing gives each its closing id alone. Very long texts are
judged, compared and cut as a whole; packing cuts them into pieces. Of copies and ties the document with the least id stays (one without an id
last); rows that repeat an id and a text are one document after the near-duplicate stage. Columns beside those of documents are kept, whatever
their names. An empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, packing, quality, substring_dedup
from tessera.llm.store import written

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus's labels, does not reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.one_of_each(docs, threshold=0.8)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document with a smaller id holds too; untouched texts stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = substring_dedup.substring_dedup(docs, window=50, carry=others, as_is=True)
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")} | {c: F.col(f"carry_{i}") for i, c in enumerate(others)}
    return out.select(*(named[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2,048 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", shared_passages),
    ("best-fit packing", best_fit_packing),
]

#: Boosted trees and signatures have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs

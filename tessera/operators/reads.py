"""The canonical reads over append-only attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = "success"


def latest_success(records: DataFrame, key: str = "document_id", at: str = "extracted_at", tie: str = "id") -> DataFrame:
    """The latest successful attempt of each document; of attempts at one time the greatest id. The rank is limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return records.where(F.col("extraction_status") == SUCCESS).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def current(docs: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with their latest success (columns of the record under their own names, company_name and id from the document); with how="left" all documents."""
    latest = latest_success(records)
    own = [F.col(f"r.{c}").alias("record_id" if c == "id" else c) for c in latest.columns if c not in ("document_id", "company_name")]
    return docs.alias("d").join(latest.alias("r"), F.col("d.id") == F.col("r.document_id"), how).select("d.*", *own)


def without_success(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Documents no attempt has succeeded for."""
    done = records.where(F.col("extraction_status") == SUCCESS).select(F.col("document_id").alias("id"))
    return docs.join(done, "id", "left_anti")


def corpus_index(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Every document, with the period end of its latest success where there is one."""
    ends = latest_success(records).select(F.col("document_id").alias("id"), "fiscal_year_end")
    return docs.join(ends, "id", "left")


def exists(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with a flag: whether a document has these keys."""
    held = docs.select(*keys).distinct().withColumn("held", F.lit(True))
    return wanted.join(held, keys, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def with_derived_flag(docs: DataFrame, records: DataFrame) -> DataFrame:
    """is_extracted derived from the attempts, so that the two cannot disagree."""
    done = records.where(F.col("extraction_status") == SUCCESS).select(F.col("document_id").alias("id")).distinct().withColumn("is_extracted", F.lit(True))
    return docs.drop("is_extracted").join(done.hint("merge"), "id", "left").withColumn("is_extracted", F.coalesce("is_extracted", F.lit(False)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: Spark enforces no uniqueness, so it is checked."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def restricted(df: DataFrame, ticker: Column | str | None = None, sections: list[str] | None = None) -> DataFrame:
    """Metadata filter: ticker equal and section among a set; none given, no filter."""
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if sections:
        df = df.where(F.col("section").isin(*sorted(sections)))
    return df

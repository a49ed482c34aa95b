"""Loading, keeping and exporting the corpus: idempotent batches, upserts, artifacts, caches, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cache_key, display_name
from ..operators import quality, reads
from ..schemas import METRICS, NARRATIVE

EXPORT_COLUMNS = (
    "ticker", "company_name", "cik", "fiscal_year", "fiscal_year_end", "auditor_name",
    *(f"{m}{s}" for m in METRICS for s in ("", "_quality", "_quality_reason", "_quality_note", "_source_line")),
    "extraction_strategy_used", "prompt_version", "model_name", "extracted_at",
)
# Accounting concepts of each figure, the first that a filing states counts.
CONCEPTS = {
    "total_revenue": ("us-gaap_Revenues", "us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax"),
    "net_income": ("us-gaap_NetIncomeLoss", "us-gaap_ProfitLoss"),
    "total_assets": ("us-gaap_Assets",),
    "total_liabilities": ("us-gaap_Liabilities",),
    "operating_cash_flow": ("us-gaap_NetCashProvidedByUsedInOperatingActivities",),
}


def to_acquire(targets: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Targets nobody holds yet: a batch can be run again without loading twice."""
    return targets.join(held.select(*keys), keys, "left_anti")


def acquisition_summary(targets: DataFrame, held: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """stage and count: skipped, failed or acquired; the counts sum to the targets."""
    have = held.select(*keys).distinct().withColumn("_held", F.lit(True))
    stage = F.when(F.col("_held"), "skipped").when(failed, "failed").otherwise("acquired")
    return targets.join(have, keys, "left").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def filing_for_period(filings: DataFrame, company: str, period: str, year: int | None = None) -> DataFrame:
    """The first filing of each company and period year (not filing year)."""
    rows = filings.withColumn("period_year", F.year(F.try_to_date(F.substring(F.col(period).cast("string"), 1, 10), "yyyy-MM-dd")))
    rows = rows.where(F.col("period_year").isNotNull()) if year is None else rows.where(F.col("period_year") == year)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(company, "period_year").orderBy("filing_order"))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """Rows by key, the new ones replacing old; of several new ones the last (by column seq). Unusable keys are skipped."""
    tagged = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    if usable is not None:
        tagged = tagged.where(usable)
    w = Window.partitionBy(*keys).orderBy(F.col("_src").desc(), F.col("seq").desc())
    return tagged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_src")


class Rejected(ValueError):
    """Rows that a table must not take."""


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new appended. Raises, before anything is written, if a key is held already or comes twice."""
    again = reads.duplicate_keys(new, keys).select(*keys).unionByName(new.join(old.select(*keys), keys, "left_semi").select(*keys))
    if (first := again.first()) is not None:
        raise Rejected(f"a document with {first.asDict()} exists")
    return old.unionByName(new, allowMissingColumns=True)


def appended_attempts(docs: DataFrame, records: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and attempts after new attempts: the flag is derived from the attempts returned with it, so the two cannot disagree.

    Fields that attempts do not have are dropped; an attempt without its document raises.
    """
    if (orphan := new.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti").first()) is not None:
        raise Rejected(f"no document with id {orphan.document_id}")
    records = records.unionByName(new.select(*(c for c in new.columns if c in records.columns)), allowMissingColumns=True)
    return reads.with_derived_flag(docs, records), records


def write_status(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Each key's status by content hash: new, changed, unchanged, or kept where nothing new came."""
    o = old.select(*keys, F.sha2(F.col(content), 256).alias("_o"))
    n = new.select(*keys, F.sha2(F.col(content), 256).alias("_n"))
    status = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "new").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, status.alias("status"))


def first_concept(facts: DataFrame, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """For each (filing, field) the value of its first concept that is undimensioned, concrete and not null."""
    spark = facts.sparkSession
    order = spark.createDataFrame([(f, c, i) for f, cs in concepts.items() for i, c in enumerate(cs)], "field string, concept string, priority int")
    strict = facts.where(~F.col("dimension") & ~F.col("abstract") & F.col("value").isNotNull())
    return strict.join(F.broadcast(order), "concept").groupBy("filing", "field").agg(F.min_by("value", F.struct("priority", "line_no")).alias("value"))  # a fixed table


def period_column(columns: Column, period: Column) -> Column:
    """The column named exactly by a period, else the first whose leading word is it."""
    return F.coalesce(F.get(F.filter(columns, lambda c: c == period), 0), F.get(F.filter(columns, lambda c: F.split_part(c, F.lit(" "), F.lit(1)) == period), 0))


def read_narrative(spark: SparkSession, path: str) -> DataFrame:
    """Narrative artifacts as rows; malformed files give a row with the text that could not be read, not an error."""
    schema = T.StructType([*NARRATIVE.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the fields of a JSON text and status: read, malformed or missing.

    Each row is parsed by itself, so one that cannot be read leaves the others; its fields are null, as are those of a text that is no object or
    has a value of another type. Absent fields are null, others than the schema's are ignored. A null or blank text is missing.
    """
    fields = T.StructType.fromDDL(schema)
    both = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    j = F.from_json(F.col(column), both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("_j", j)
    text = F.trim(column)
    status = F.when(F.col(column).isNull() | (text == ""), "missing").when(F.col("_j._corrupt").isNotNull() | F.col("_j").isNull() | ~F.startswith(text, F.lit("{")), "malformed").otherwise("read")
    out = out.withColumn("status", status)
    for f in fields.fields:
        out = out.withColumn(f.name, F.when(F.col("status") == "read", F.col(f"_j.{f.name}")))
    return out.drop("_j")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cached_or_missing(requests: DataFrame, cache: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers the content-addressed cache holds, and the requests it lacks. Unreadable entries (null) are misses."""
    keyed = requests.withColumn("cache_key", cache_key(*(F.col(p) for p in parts)))
    usable = cache.where(F.col("response").isNotNull())
    return keyed.join(usable, "cache_key"), keyed.join(usable.select("cache_key"), "cache_key", "left_anti")


def cache_entries(results: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """What results (parts, extraction_status, response) add to the cache: cache_key, response and whether it failed validation.

    A call that never completed (technical_failed) is not kept, so it is made again; an answer that failed validation is kept, so it is
    not paid for again. Usable entries stay as they are.
    """
    keyed = results.where(F.col("extraction_status") != "technical_failed").select(cache_key(*(F.col(p) for p in parts)).alias("cache_key"), F.coalesce("response", F.lit("")).alias("response"), (F.col("extraction_status") == "extraction_failed").alias("invalid"))
    fresh = keyed.groupBy("cache_key").agg(F.min(F.struct("invalid", "response")).alias("e")).select("cache_key", "e.response", "e.invalid")
    return fresh.join(cache.where(F.col("response").isNotNull()).select("cache_key"), "cache_key", "left_anti")


def fetched(wanted: DataFrame, fetch: Callable[[dict], str]) -> DataFrame:
    """wanted with the text that `fetch` gives for each row, or the error that kept it; one row's failure leaves the others."""
    columns = wanted.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text, error = [], []
            for row in f.to_dict("records"):
                try:
                    text.append(fetch({c: row[c] for c in columns}))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  kept beside the row
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield f.assign(text=text, error=error)

    return wanted.mapInPandas(run, T.StructType([*wanted.schema.fields, T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))


def persisted(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes fetched texts by key, replacing only the keys that occur, and gives a row for each with whether it was kept."""
    stored = rows.where(F.col("error").isNull()).select("text", *keys)
    replace_partitions(stored, path, keys)
    return rows.select(*keys, F.when(F.col("error").isNull(), "kept").otherwise("failed").alias("status"), "error")


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows partitioned by keys, replacing only the partitions that occur (delete, then insert)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a stored table, or -1 if it cannot be read."""
    try:
        return spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001  any failure to read means the same here
        return -1


def params_match(spark: SparkSession, path: str, params_hash: str) -> bool | None:
    """Whether a store was built with these parameters; None where it does not say."""
    try:
        return spark.read.text(f"{path}/_params").first()[0] == params_hash
    except Exception:  # noqa: BLE001
        return None


def pending(docs: DataFrame, flag: str) -> DataFrame:
    return docs.where(~F.col(flag)).orderBy("ticker", "id")


def in_scope(docs: DataFrame, scope: str, evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """all, eval (among the evaluated) or held_out (not among them)."""
    if scope == "all":
        return docs
    return docs.join(evaluated.select(*keys), keys, {"eval": "left_semi", "held_out": "left_anti"}[scope])


def targets(tickers: DataFrame, first_year: int, cycle: int = 3, order: str = "position") -> DataFrame:
    """Tickers with years that cycle by position."""
    return tickers.withColumn("year", (F.lit(first_year) + F.pmod(F.col(order), F.lit(cycle))).cast("int"))


def export_rows(current: DataFrame) -> DataFrame:
    """One row a company with every figure, its quality, the sentence and the cited line, in order of ticker."""
    lines = [f"{m}_source_line" for m in METRICS]
    flags = quality.assessed(current).groupBy("id").agg(
        *(F.max(F.when(F.col("metric") == m, F.struct("verdict", "reason", quality.note(F.col("reason"), F.col("suspected_value")).alias("note")))).alias(f"_{m}") for m in METRICS)
    )
    rows = current.join(flags, "id")
    named = {"company_name": display_name(F.col("company_name"), F.col("ticker")), "fiscal_year": F.col("filing_year"), "extracted_at": F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss")}
    for m in METRICS:
        named |= {f"{m}_quality": F.col(f"_{m}.verdict"), f"{m}_quality_reason": F.col(f"_{m}.reason"), f"{m}_quality_note": F.col(f"_{m}.note")}
    assert set(lines) <= set(EXPORT_COLUMNS)
    return rows.select(*(named.get(c, F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in EXPORT_COLUMNS)).orderBy("ticker")


def write_csv(rows: DataFrame, path: str) -> None:
    """One UTF-8 file with a byte-order mark, streamed row by row in order; for results that fit a file."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])

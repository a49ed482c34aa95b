"""Lookups, rankings and filters over current figures, with what they leave out."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name, format_value
from ..schemas import Comparison, Direction, Metric
from ..store import Files, new_folder
from . import quality, reads

CAP = 20
COMPARE = {Comparison.GT: Column.__gt__, Comparison.GTE: Column.__ge__, Comparison.LT: Column.__lt__, Comparison.LTE: Column.__le__}


def metric_rows(current: DataFrame, metric: Metric) -> DataFrame:
    """A row for each company's current record: name, ticker, year, period end, value and quality."""
    rows = quality.assessed(current, Metric(metric).value)
    return rows.select(F.col("id").alias("document_id"), display_name(F.col("company_name"), F.col("ticker")).alias("company_name"), "ticker", F.col("filing_year").alias("fiscal_year"), "fiscal_year_end", "value", "verdict", "reason", "suspected_value")


def lookup(rows: DataFrame, document_id: int) -> DataFrame:
    return rows.where(F.col("document_id") == document_id)


def limit_of(limit: int | None) -> int:
    return min(limit or 1, CAP)


def ranking(rows: DataFrame, direction: Direction, limit: int | None = None, year: int | None = None) -> DataFrame:
    """The first companies by value; ties by document. A year is an extension and off by default."""
    value = F.col("value")
    rows = rows.where(value.isNotNull())
    if year is not None:
        rows = rows.where(F.col("fiscal_year") == year)
    return rows.orderBy(value.desc() if direction is Direction.HIGHEST else value.asc(), "document_id").limit(limit_of(limit))


def threshold_filter(rows: DataFrame, comparison: Comparison, threshold: float, limit: int | None = None) -> DataFrame:
    """All companies whose value passes, the highest first; with a limit the first of them."""
    passing = rows.where(F.col("value").isNotNull() & COMPARE[comparison](F.col("value"), threshold)).orderBy(F.col("value").desc(), "document_id")
    return passing if limit is None else passing.limit(limit)


def placed(ordered: DataFrame, path: str) -> DataFrame:
    """Rows that are sorted as a whole, with their place from 0. They are stored sorted, in the parts of the sort, and of a part only its number of rows is looked at."""
    # the upper 31 bits of this number are the part, the lower 33 the row in it
    rows = ordered.withColumn("_at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = ordered.sparkSession.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # at most as many as the session's shuffle partitions
    before = dict(zip((r["_part"] for r in sizes), accumulate((r.n for r in sizes), initial=0), strict=False))
    starts = F.broadcast(ordered.sparkSession.createDataFrame(list(before.items()), "_part long, _start long"))
    return rows.join(starts, "_part").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def excluded_null(rows: DataFrame, unextracted: DataFrame) -> DataFrame:
    """Companies a ranking or filter cannot place: no value, or no successful extraction."""
    missing = rows.where(F.col("value").isNull()).select("document_id", "ticker", "company_name", "fiscal_year")
    none = unextracted.select(F.col("id").alias("document_id"), "ticker", display_name(F.col("company_name"), F.col("ticker")).alias("company_name"), F.col("filing_year").alias("fiscal_year"))
    return missing.unionByName(none)


def mixed_years(shown: DataFrame) -> DataFrame:
    return shown.agg((F.countDistinct("fiscal_year") > 1).alias("mixed_years"))


def flagged_not_shown(rows: DataFrame, shown: DataFrame, comparison: Comparison | None = None, threshold: float | None = None, direction: Direction | None = None, limit: int | None = None) -> DataFrame:
    """Scale-flagged companies left out that a correction would bring in. A ranking shows at most CAP rows, a filter as many as pass, which are never broadcast."""
    held = shown.select("ticker").hint("merge") if comparison is not None else F.broadcast(shown.select("ticker"))  # CAP rows
    left = rows.where(F.col("value").isNotNull() & F.col("reason").isin(*quality.SCALE_REASONS)).join(held, "ticker", "left_anti")
    left = left.withColumn("_p", quality.plausible_values(F.col("value"), F.col("suspected_value")))
    if comparison is not None:
        return left.where(F.exists("_p", lambda v: COMPARE[comparison](v, F.lit(threshold)))).drop("_p")
    bounds = shown.agg(F.count("value").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")).withColumn("_one", F.lit(1))
    beats = (lambda v: v > F.col("_low")) if direction is Direction.HIGHEST else (lambda v: v < F.col("_high"))
    left = left.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")  # one row
    return left.where((F.col("_n") < limit_of(limit)) | F.exists("_p", beats)).drop("_p", "_one", "_n", "_low", "_high")


@dataclass(frozen=True)
class MetricResult:
    """Lazy parts of a financial answer."""

    rows: DataFrame
    excluded: DataFrame | None
    flagged: DataFrame | None
    threshold: float | None = None
    #: A folder whose table "rows" all parts read, a row for each company.
    kept: str | None = None

    def release(self) -> None:
        if self.kept is not None:
            Files(self.rows.sparkSession, self.kept).remove(self.kept)


def run(docs: DataFrame, records: DataFrame, metric: Metric, document_id: int | None = None, direction: Direction | None = None, limit: int | None = None, comparison: Comparison | None = None, threshold: float | None = None, keep: bool = False) -> MetricResult:
    """One financial task: a lookup, a ranking or a filter, with its disclosures. With keep, the rows that all parts read are computed once and stored until release().

    A filter without a limit shows all that pass.
    """
    if document_id is not None:
        return MetricResult(lookup(metric_rows(reads.current(docs, records), metric), document_id), None, None)
    # a document without a success has no value, so one read of the attempts serves all parts
    rows = metric_rows(reads.current(docs, records, "left"), metric)
    path = new_folder(docs.sparkSession, "figures") if keep else None
    if path:
        rows.write.parquet(f"{path}/rows")
        rows = docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    shown = ranking(rows, direction, limit) if direction is not None else threshold_filter(rows, comparison, threshold, limit)
    excluded = rows.where(F.col("value").isNull()).select("document_id", "ticker", "company_name", "fiscal_year").orderBy("ticker")
    return MetricResult(shown, excluded, flagged_not_shown(rows, shown, comparison, threshold, direction, limit).orderBy("ticker"), threshold, path)


def export(current: DataFrame) -> DataFrame:
    """The export's rows in order of ticker, with a readable revenue."""
    return current.withColumn("revenue_text", format_value(F.col("total_revenue"))).orderBy("ticker")

"""Binding free-text company mentions to held documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifying_tokens, normalise
from . import joins

# Short names that no token of a registrant's name would reach.
ALIASES = {
    "google": "GOOGL", "alphabet": "GOOGL", "facebook": "META", "bofa": "BAC", "bank of america": "BAC", "jpm": "JPM",
    "j p morgan": "JPM", "goldman": "GS", "jnj": "JNJ", "j j": "JNJ", "exxon": "XOM",
}


def resolve_company(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """mention_id, ticker, failure, candidates: exact ticker, then alias, then the only name with all tokens.

    mentions: mention_id, mention. index: ticker, company_name. Failures: no_company_mention for blanks,
    ambiguous_company (candidates sorted) for several names or no identifying token, non_corpus_company for none.
    """
    spark = mentions.sparkSession
    m = mentions.withColumn("_norm", normalise(F.col("mention"))).withColumn("_upper", F.upper(F.trim(F.col("mention")))).withColumn("tokens", identifying_tokens(F.col("mention")))
    tickers = index.select(F.col("ticker").alias("_t")).distinct().hint("merge")  # as many as companies, so never by way of the driver
    alias = F.broadcast(spark.createDataFrame(list(ALIASES.items()), "_norm string, _alias string"))  # a fixed table
    m = m.join(tickers, F.col("_upper") == F.col("_t"), "left").join(alias, "_norm", "left").join(tickers.withColumnRenamed("_t", "_at").hint("merge"), F.col("_alias") == F.col("_at"), "left")
    names = index.select(F.col("ticker").alias("name_id"), identifying_tokens(F.col("company_name")).alias("tokens"))
    open_ones = m.where(F.col("_t").isNull() & F.col("_at").isNull())
    found = joins.name_matches(open_ones.select("mention_id", "tokens"), names).groupBy("mention_id").agg(F.array_sort(F.collect_set("name_id")).alias("_found"))
    m = m.join(found, "mention_id", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    blank = F.coalesce(F.trim("mention"), F.lit("")) == ""
    settled = F.coalesce(F.when(~blank, F.col("_t")), F.when(~blank, F.col("_at")), F.when(~blank & (F.size("_found") == 1), F.get("_found", 0)))
    failure = F.when(settled.isNotNull(), F.lit(None)).when(blank, "no_company_mention").when((F.size("tokens") == 0) | (F.size("_found") > 1), "ambiguous_company").otherwise("non_corpus_company")
    return m.select("mention_id", settled.alias("ticker"), failure.alias("failure"), F.when(settled.isNull() & (F.size("_found") > 1), F.col("_found")).alias("candidates"))


def period_failure(requested: Column, held: Column) -> Column:
    return F.when(requested.isNotNull() & (requested != held), "year_not_held")


def first_failure(company: Column, requested_year: Column, held_year: Column, embedded: Column, extracted: Column, need_embedded: Column, need_extracted: Column) -> Column:
    """The first of: company, period, embedding, extraction."""
    return F.coalesce(company, period_failure(requested_year, held_year), F.when(need_embedded & ~embedded, "company_not_embedded"), F.when(need_extracted & ~extracted, "company_not_extracted"))

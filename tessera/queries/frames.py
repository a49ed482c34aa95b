"""The test tables in the shapes the operators expect, as expressions that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRICS

DOCS = {
    "id": "c_custkey", "company_name": "c_name", "ticker": "concat('T', CAST(c_custkey AS STRING))", "cik": "lpad(CAST(c_custkey AS STRING), 10, '0')",
    "filing_year": "CAST(2021 + c_custkey % 3 AS INT)", "is_extracted": "FALSE", "is_embedded": "c_custkey % 4 <> 0",
}
PRINTED = "(CAST(floor(o_totalprice) AS BIGINT) + {k} * 1000 + o_orderkey % 97)"
NULLS = {1: "o_orderkey % 10 = 0", 3: "o_orderkey % 11 = 0"}
UNITS = {4: "CASE WHEN o_orderkey % 11 = 0 THEN 1000 ELSE 1000000 END", 5: "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 1000 ELSE 1000000 END"}
RECORDS = {
    "id": "o_orderkey", "document_id": "o_custkey", "extraction_status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'validation_failed' END",
    "extracted_at": "o_orderdate", "fiscal_year_end": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "auditor_name": "o_orderpriority", "extraction_strategy_used": "'S3'", "prompt_version": "'v1'", "model_name": "'m'",
}
for _k, _m in enumerate(METRICS, 1):
    _p = PRINTED.format(k=_k)
    _null = NULLS.get(_k, "FALSE")
    RECORDS[_m] = f"CASE WHEN {_null} THEN NULL ELSE CAST({_p} * {UNITS.get(_k, '1000000')} AS DOUBLE) END"
    RECORDS[f"{_m}_source_line"] = f"CASE WHEN {_null} THEN NULL WHEN {'o_orderkey % 13 = 0' if _k == 2 else 'FALSE'} THEN 'item 7' ELSE concat('item ', CAST({_p} AS STRING)) END"


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


CTE_BASE = f"docs AS ({_sql(DOCS, 'customer')}), recs AS ({_sql(RECORDS, 'orders')})"
CTE_LATEST = CTE_BASE + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY extracted_at DESC, id DESC) AS nth FROM recs WHERE extraction_status = 'success') WHERE nth = 1)"
_FIGS = " UNION ALL ".join(f"SELECT d.id AS document_id, d.ticker, d.company_name, d.filing_year, l.fiscal_year_end, '{m}' AS metric, l.{m} AS value, l.{m}_source_line AS line FROM docs d JOIN latest l ON l.document_id = d.id" for m in METRICS)
CTE_ASSESSED = (
    CTE_LATEST
    + f", figs AS ({_FIGS})"
    + ", mult AS (SELECT *, CASE WHEN value IS NULL OR line IS NULL THEN NULL ELSE list_filter([1.0::DOUBLE, 1e3::DOUBLE, 1e6::DOUBLE, 1e9::DOUBLE], lambda s: abs(CAST(regexp_extract(line, '\\d+') AS DOUBLE) * s - abs(value)) <= greatest(abs(value) * 1e-3, 1e-6))[1] END AS multiplier FROM figs)"
    + ", cnt AS (SELECT document_id, multiplier, count(*) AS n FROM mult WHERE multiplier IS NOT NULL GROUP BY 1, 2)"
    + ", tot AS (SELECT document_id, sum(n) AS total, max(n) AS top FROM cnt GROUP BY 1)"
    + ", scl AS (SELECT t.document_id, CASE WHEN min(t.total) >= 3 AND count(*) = 1 THEN min(c.multiplier) END AS scale, min(t.total) >= 3 AND count(*) > 1 AS ambiguous FROM tot t JOIN cnt c ON c.document_id = t.document_id AND c.n = t.top GROUP BY 1)"
    + ", assessed AS (SELECT m.*, s.scale AS document_scale, CASE WHEN value IS NULL THEN 'null_field' WHEN multiplier IS NULL THEN 'evidence_mismatch' WHEN coalesce(s.ambiguous, FALSE) THEN 'scale_ambiguous' WHEN s.scale IS NULL THEN 'scale_not_checkable' WHEN multiplier <> s.scale THEN 'scale_disagreement' ELSE 'consistent' END AS reason FROM mult m LEFT JOIN scl s USING (document_id))"
    + ", judged AS (SELECT *, CASE WHEN reason = 'consistent' THEN 'verified' WHEN reason IN ('null_field', 'scale_not_checkable') THEN 'unverified' ELSE 'disputed' END AS verdict, CASE WHEN reason = 'scale_disagreement' THEN value * (document_scale / multiplier) END AS suspected_value FROM assessed)"
)


def registry() -> tuple[dict, dict, Callable]:
    """Queries by name, their SQL, and a decorator that adds both."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in DOCS.items()))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in RECORDS.items()))


_P = [PRINTED.format(k=k) for k in range(1, 6)]
#: One attempt's figures as a report prints them: behind a letter's dollar sign, with a percentage in front, scaled by words, in brackets, and where they are no amounts.
STATEMENT = (
    f"concat('Total net sales$', {{c[0]}}, ' 33 %$', {{c[1]}}, ' 6 %; assets of $ ', CAST({{third}} AS STRING), '.', lpad(CAST({_P[2]} % 1000 AS STRING), 3, '0'),"
    f" ' Billions (', {{c[3]}}, '), FY2021, cash ', CAST({_P[4]} AS STRING), ' mn and x', {{c[0]}}, '.')"
)
CTE_REPORTS = (
    "statements AS (SELECT o_custkey AS id, string_agg(" + STATEMENT.format(c=[f"format('{{:,}}', {p})" for p in _P], third=f"{_P[2]} // 1000") + ", ' ' ORDER BY o_orderkey) AS said FROM orders GROUP BY 1), "
    "reports AS (SELECT doc_id, concat('T', CAST(doc_id + 1 AS STRING)) AS ticker, concat(text, chr(10), said) AS text FROM documents LEFT JOIN statements ON id = doc_id + 1)"
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with all attempts' figures of the company next in number printed behind its text."""
    said = F.expr(STATEMENT.format(c=[f"format_number({p}, 0)" for p in _P], third=f"{_P[2]} div 1000"))
    of_company = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", said.alias("said")))), lambda x: x["said"]), " ").alias("said"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") + 1).alias("id")).join(of_company, "id", "left")
    return d.select("doc_id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.concat("text", F.lit("\n"), F.coalesce("said", F.lit(""))).alias("text"))

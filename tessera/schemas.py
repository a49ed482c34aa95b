"""Fixed schemas and enumerations. Nothing is inferred from data.

Figures are doubles in actual dollars, tri-state flags are nullable booleans, and
enumerations are stored as their text.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T

#: The five figures of a filing, in order.
METRICS = ("total_revenue", "net_income", "total_assets", "total_liabilities", "operating_cash_flow")

_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}


def _columns(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in text.split(","))])


DOCUMENTS = _columns("id bigint, company_name string, ticker string, cik string, filing_year int, filing_date string, accession_number string, local_path string, is_extracted boolean, is_embedded boolean, created_at timestamp")
RECORDS = _columns(
    "id bigint, document_id bigint, company_name string, fiscal_year_end string, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", auditor_name string, "
    + ", ".join(f"{m}_source_line string, {m}_evidence_present boolean, {m}_evidence_consistent boolean" for m in METRICS)
    + ", evidence_json string, extraction_strategy_used string, prompt_version string, model_name string, section_source string, input_tokens int, output_tokens int, extraction_status string, failure_reason string, extracted_at timestamp"
)
CHUNKS = _columns("id string, text string, source_company string, source_ticker string, source_cik string, source_year int, source_section string, chunk_index int, embedding vector")
EVIDENCE = T.MapType(T.StringType(), _columns("value double, source_line string"))
NARRATIVE = T.StructType([*_columns("cik string, year int").fields, T.StructField("sections", T.ArrayType(_columns("name string, text string, token_count int")))])


class Intent(StrEnum):
    FINANCIAL_METRIC = "financial_metric"
    FINANCIAL_RANKING = "financial_ranking"
    FINANCIAL_FILTER = "financial_filter"
    COMPANY_OVERVIEW = "company_overview"
    STRATEGY = "strategy"
    COMPETITION_AND_REGULATION = "competition_and_regulation"
    RISK_FACTORS = "risk_factors"
    MANAGEMENT_COMMENTARY = "management_commentary"
    MARKET_RISK = "market_risk"


class Tool(StrEnum):
    SQL = "sql"
    RAG = "rag"


class Metric(StrEnum):
    """A column outside this list cannot reach a query."""

    TOTAL_REVENUE = "total_revenue"
    NET_INCOME = "net_income"
    TOTAL_ASSETS = "total_assets"
    TOTAL_LIABILITIES = "total_liabilities"
    OPERATING_CASH_FLOW = "operating_cash_flow"


class Comparison(StrEnum):
    GT = "gt"
    GTE = "gte"
    LT = "lt"
    LTE = "lte"


class Direction(StrEnum):
    HIGHEST = "highest"
    LOWEST = "lowest"


class PlanType(StrEnum):
    SINGLE = "single"
    HYBRID = "hybrid"
    CLARIFICATION = "clarification"
    UNSUPPORTED = "unsupported"
    OUT_OF_SCOPE = "out_of_scope"


class Unsupported(StrEnum):
    CROSS_YEAR = "cross_year"
    AGGREGATION = "aggregation"
    RATIO_OR_DERIVED = "ratio_or_derived"
    MULTI_CONDITION = "multi_condition"
    FIELD_NOT_QUERYABLE = "field_not_queryable"


class Unresolved(StrEnum):
    NON_CORPUS = "non_corpus_company"
    NOT_EMBEDDED = "company_not_embedded"
    NOT_EXTRACTED = "company_not_extracted"
    YEAR_NOT_HELD = "year_not_held"
    AMBIGUOUS = "ambiguous_company"
    NO_MENTION = "no_company_mention"


class Status(StrEnum):
    SUCCESS = "success"
    REFUSED = "refused"
    FAILED = "failed"

"""Queries of the canonical reads, figures, quality, sources and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import figures, joins, quality, reads, resolve, sections
from ..schemas import METRICS, Comparison, Direction, Metric
from ..sources import corpus, extraction
from .frames import CTE_ASSESSED, CTE_BASE, CTE_LATEST, docs, records, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rows(s, d, m=Metric.TOTAL_REVENUE):
    return figures.metric_rows(reads.current(docs(s, d), records(s, d)), m)


@query(f"WITH {CTE_LATEST} SELECT document_id, id, extracted_at, total_assets FROM latest")
def r1_latest_success(s, d):
    return reads.latest_success(records(s, d)).select("document_id", "id", "extracted_at", "total_assets")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type <> 'error') WHERE nth = 1")
def r1_latest_event(s, d):
    e = table(s, d, "events").withColumn("extraction_status", F.when(F.col("event_type") != "error", "success").otherwise("failed"))
    return reads.latest_success(e, "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query(f"WITH {CTE_BASE} SELECT id, ticker FROM docs d WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.document_id = d.id AND r.extraction_status = 'success')")
def r2_without_success(s, d):
    return reads.without_success(docs(s, d), records(s, d)).select("id", "ticker")


@query(f"WITH {CTE_LATEST} SELECT d.ticker, d.company_name, l.id AS record_id, l.net_income FROM docs d JOIN latest l ON l.document_id = d.id")
def r3_latest_by_ticker(s, d):
    return reads.current(docs(s, d), records(s, d)).select("ticker", "company_name", "record_id", "net_income").orderBy("ticker")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, ticker, filing_year AS fiscal_year, value, verdict, reason FROM judged WHERE metric = 'net_income' AND document_id = 7")
def r4_lookup(s, d):
    return figures.lookup(_rows(s, d, Metric.NET_INCOME), 7).select("document_id", "ticker", "fiscal_year", "value", "verdict", "reason")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, ticker, fiscal_year, value FROM (SELECT document_id, ticker, filing_year AS fiscal_year, value FROM judged WHERE metric = 'total_revenue' AND value IS NOT NULL ORDER BY value DESC, document_id LIMIT 20)")
def r5_ranking_highest(s, d):
    return figures.ranking(_rows(s, d), Direction.HIGHEST, 20).select("document_id", "ticker", "fiscal_year", "value")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, ticker, fiscal_year, value FROM (SELECT document_id, ticker, filing_year AS fiscal_year, value FROM judged WHERE metric = 'operating_cash_flow' AND value IS NOT NULL ORDER BY value, document_id LIMIT 5)")
def r5_ranking_lowest(s, d):
    return figures.ranking(_rows(s, d, Metric.OPERATING_CASH_FLOW), Direction.LOWEST, 5).select("document_id", "ticker", "fiscal_year", "value")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, value FROM (SELECT document_id, value FROM judged WHERE metric = 'total_assets' AND value > 2e11 ORDER BY value DESC, document_id LIMIT 20)")
def r6_filter_above(s, d):
    return figures.threshold_filter(_rows(s, d, Metric.TOTAL_ASSETS), Comparison.GT, 2e11, figures.CAP).select("document_id", "value")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, value FROM (SELECT document_id, value FROM judged WHERE metric = 'operating_cash_flow' AND value <= 1e9 ORDER BY value DESC, document_id LIMIT 20)")
def r6_filter_at_most(s, d):
    return figures.threshold_filter(_rows(s, d, Metric.OPERATING_CASH_FLOW), Comparison.LTE, 1e9, figures.CAP).select("document_id", "value")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, ticker, filing_year AS fiscal_year FROM judged WHERE metric = 'total_revenue' AND value IS NULL UNION ALL SELECT id, ticker, filing_year FROM docs WHERE id NOT IN (SELECT document_id FROM latest)")
def r8_excluded_null(s, d):
    return figures.excluded_null(_rows(s, d), reads.without_success(docs(s, d), records(s, d))).select("document_id", "ticker", "fiscal_year").orderBy("ticker")


@query(f"WITH {CTE_ASSESSED} SELECT document_id, ticker, filing_year AS fiscal_year, fiscal_year_end, value, verdict, reason, suspected_value FROM judged WHERE metric = 'operating_cash_flow'")
def r9_metric_rows(s, d):
    return _rows(s, d, Metric.OPERATING_CASH_FLOW).drop("company_name")


@query(f"WITH {CTE_ASSESSED} SELECT count(DISTINCT fiscal_year) > 1 AS mixed_years FROM (SELECT filing_year AS fiscal_year FROM judged WHERE metric = 'total_revenue' AND value IS NOT NULL ORDER BY value DESC, document_id LIMIT 20)")
def r10_mixed_years(s, d):
    return figures.mixed_years(figures.ranking(_rows(s, d), Direction.HIGHEST, 20))


_PLAUSIBLE = "CASE WHEN suspected_value IS NOT NULL THEN [suspected_value] ELSE [value * 1000, value / 1000] END"
_SUSPECT = "reason IN ('scale_ambiguous', 'scale_disagreement', 'scale_not_checkable')"


@query(f"WITH {CTE_ASSESSED}, ocf AS (SELECT * FROM judged WHERE metric = 'operating_cash_flow' AND value IS NOT NULL), shown AS (SELECT ticker FROM ocf WHERE value > 3e11 ORDER BY value DESC, document_id LIMIT 20) SELECT document_id, ticker, reason FROM ocf WHERE {_SUSPECT} AND ticker NOT IN (SELECT ticker FROM shown) AND len(list_filter({_PLAUSIBLE}, lambda v: v > 3e11)) > 0")
def r11_flagged_filter(s, d):
    rows = _rows(s, d, Metric.OPERATING_CASH_FLOW)
    shown = figures.threshold_filter(rows, Comparison.GT, 3e11, figures.CAP)
    return figures.flagged_not_shown(rows, shown, Comparison.GT, 3e11).select("document_id", "ticker", "reason")


@query(f"WITH {CTE_ASSESSED}, ocf AS (SELECT * FROM judged WHERE metric = 'operating_cash_flow' AND value IS NOT NULL), shown AS (SELECT ticker, value FROM ocf ORDER BY value DESC, document_id LIMIT 10), b AS (SELECT count(*) AS n, min(value) AS low FROM shown) SELECT document_id, ticker FROM ocf, b WHERE {_SUSPECT} AND ticker NOT IN (SELECT ticker FROM shown) AND (n < 10 OR list_max({_PLAUSIBLE}) > low)")
def r11_flagged_ranking(s, d):
    rows = _rows(s, d, Metric.OPERATING_CASH_FLOW)
    return figures.flagged_not_shown(rows, figures.ranking(rows, Direction.HIGHEST, 10), direction=Direction.HIGHEST, limit=10).select("document_id", "ticker")


@query(f"WITH {CTE_ASSESSED}, t AS (SELECT * FROM judged WHERE metric = 'total_assets'), shown AS (SELECT document_id FROM t WHERE value < 1.5e11 ORDER BY value DESC, document_id LIMIT 20) SELECT 'shown' AS part, document_id FROM shown UNION ALL SELECT 'excluded', document_id FROM t WHERE value IS NULL UNION ALL SELECT 'excluded', id FROM docs WHERE id NOT IN (SELECT document_id FROM latest) UNION ALL SELECT 'flagged', document_id FROM t WHERE value IS NOT NULL AND {_SUSPECT} AND document_id NOT IN (SELECT document_id FROM shown) AND len(list_filter({_PLAUSIBLE}, lambda v: v < 1.5e11)) > 0")
def r12_financial_task(s, d):
    r = figures.run(docs(s, d), records(s, d), Metric.TOTAL_ASSETS, limit=figures.CAP, comparison=Comparison.LT, threshold=1.5e11, keep=True)
    parts = [x.select(F.lit(n).alias("part"), "document_id") for n, x in (("shown", r.rows), ("excluded", r.excluded), ("flagged", r.flagged))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {CTE_LATEST} SELECT d.id, d.ticker, d.cik, l.fiscal_year_end FROM docs d LEFT JOIN latest l ON l.document_id = d.id")
def r13_corpus_index(s, d):
    return reads.corpus_index(docs(s, d), records(s, d)).select("id", "ticker", "cik", "fiscal_year_end")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def r14_metadata_filter(s, d):
    c = table(s, d, "documents").select("doc_id", F.col("lang").alias("ticker"), F.col("source").alias("section"))
    return reads.restricted(c, "en", ["src3", "src1", "src2"]).select("doc_id")


@query(f"WITH {CTE_ASSESSED} SELECT DISTINCT ticker, target FROM (SELECT ticker, unnest(CASE WHEN reason IN ('scale_ambiguous', 'scale_disagreement') THEN [abs(value), abs(value) * 1000, abs(value) / 1000] ELSE [abs(value)] END) AS target FROM judged WHERE value IS NOT NULL AND value <> 0)")
def r15_guard_values(s, d):
    return quality.guard_values(quality.assessed(reads.current(docs(s, d), records(s, d))))


@query(f"WITH {CTE_LATEST} SELECT id, coalesce(total_revenue BETWEEN 1e11 AND 2e11, FALSE) AS hit FROM latest")
def j8_band_match(s, d):
    return reads.latest_success(records(s, d)).select("id", F.coalesce(joins.within(F.col("total_revenue"), F.lit(1.5e11), 1 / 3), F.lit(False)).alias("hit"))


ORACLE_SQL["j8_band_match"] = f"WITH {CTE_LATEST} SELECT id, coalesce(abs(total_revenue - 1.5e11) <= (1.0::DOUBLE / 3) * 1.5e11, FALSE) AS hit FROM latest"


# quality

@query(f"WITH {CTE_ASSESSED} SELECT document_id, metric, multiplier, document_scale, verdict, reason, suspected_value FROM judged")
def q4_q5_assessed(s, d):
    return quality.assessed(reads.current(docs(s, d), records(s, d))).select(F.col("id").alias("document_id"), "metric", "multiplier", "document_scale", "verdict", "reason", "suspected_value")


@query(f"WITH {CTE_LATEST} SELECT id, CASE WHEN net_income IS NOT NULL AND net_income_source_line IS NOT NULL THEN len(list_filter([1.0::DOUBLE, 1e3::DOUBLE, 1e6::DOUBLE, 1e9::DOUBLE], lambda s: abs(CAST(regexp_extract(net_income_source_line, '\\d+') AS DOUBLE) * s - abs(net_income)) <= greatest(abs(net_income) * 1e-3, 1e-6))) > 0 END AS consistent FROM latest")
def q2_evidence_consistent(s, d):
    return reads.latest_success(records(s, d)).select("id", quality.evidence_consistent(F.col("net_income"), F.col("net_income_source_line")).alias("consistent"))


@query(f"WITH {CTE_LATEST} SELECT id, CASE WHEN operating_cash_flow IS NULL THEN NULL ELSE list_filter([1.0::DOUBLE, 1e3::DOUBLE, 1e6::DOUBLE, 1e9::DOUBLE], lambda s: abs(CAST(regexp_extract(operating_cash_flow_source_line, '\\d+') AS DOUBLE) * s - abs(operating_cash_flow)) <= greatest(abs(operating_cash_flow) * 1e-3, 1e-6))[1] END AS multiplier FROM latest")
def q3_implied_multiplier(s, d):
    return reads.latest_success(records(s, d)).select("id", quality.implied_multiplier(F.col("operating_cash_flow"), F.col("operating_cash_flow_source_line")).alias("multiplier"))


_NOTE = "CASE reason WHEN 'null_field' THEN 'This figure was not extracted from the filing.' WHEN 'evidence_mismatch' THEN 'Flagged: the line cited for this figure does not contain it, so the value may be derived or drawn from a neighbouring item.' WHEN 'scale_disagreement' THEN concat('Flagged: this figure''s implied scale disagrees with the rest of the filing. The value is likely ', format('{:,}', CAST(round(suspected_value) AS BIGINT)), '.') WHEN 'scale_ambiguous' THEN 'Flagged: figures in this filing were extracted at two different scales and neither is in the majority, so which is authoritative cannot be determined from the filing alone.' WHEN 'scale_not_checkable' THEN 'Flagged: the scale of this figure could not be checked.' END"


@query(f"WITH {CTE_ASSESSED} SELECT document_id, metric, {_NOTE} AS note FROM judged")
def q6_disclosure(s, d):
    a = quality.assessed(reads.current(docs(s, d), records(s, d)))
    return a.select(F.col("id").alias("document_id"), "metric", quality.note(F.col("reason"), F.col("suspected_value")).alias("note"))


@query("WITH n AS (SELECT source, lang, sum(n_chars) AS n_chars FROM documents GROUP BY 1, 2), t AS (SELECT source, sum(n_chars) AS total FROM n GROUP BY 1) SELECT n.source, n.lang, round(CAST(n_chars AS DOUBLE) / CAST(total AS DOUBLE), 9) AS share, CAST(n_chars AS DOUBLE) / CAST(total AS DOUBLE) < 0.2 AS collapsed FROM n JOIN t USING (source)")
def q10_section_health(s, d):
    n = table(s, d, "documents").groupBy(F.col("source").alias("doc_id"), "lang").agg(F.sum("n_chars").alias("n_chars"))
    return quality.section_health(n, 0.2).select(F.col("doc_id").alias("source"), "lang", F.round("share", 9).alias("share"), "collapsed")


@query("SELECT b.item_id AS passage_id, d.doc_id AS text_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q1_evidence_present(s, d):
    p = table(s, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    t = table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return joins.contained_passages(p, t)


@query("SELECT doc_id, contains(replace(regexp_replace(lower(d.text), '\\s+', '', 'g'), '$', ''), replace(regexp_replace(lower(b.text), '\\s+', '', 'g'), '$', '')) AS present FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40")
def q1_flattened_present(s, d):
    """Whether a benchmark passage stands in a document, white space, case and dollar signs aside."""
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("line"))
    t = table(s, d, "documents").join(b, F.col("item_id") == F.col("doc_id") % 40, "left")
    return t.select("doc_id", quality.evidence_present(F.col("line"), F.col("text")).alias("present"))


# sources

@query(f"WITH {CTE_BASE} SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE year(o_orderdate) >= 1998 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) < 1998)")
def io1_to_acquire(s, d):
    o = table(s, d, "orders")
    old, new = o.where(F.year("o_orderdate") < 1998), o.where(F.year("o_orderdate") >= 1998)
    return corpus.to_acquire(new, old, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("WITH held AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 1997) SELECT CASE WHEN h.o_custkey IS NOT NULL THEN 'skipped' WHEN o.o_orderstatus = 'P' THEN 'failed' ELSE 'acquired' END AS stage, count(*) AS n FROM orders o LEFT JOIN held h ON h.o_custkey = o.o_custkey WHERE year(o_orderdate) >= 1997 GROUP BY 1")
def io1_acquisition_summary(s, d):
    o = table(s, d, "orders")
    return corpus.acquisition_summary(o.where(F.year("o_orderdate") >= 1997), o.where(F.year("o_orderdate") < 1997), ["o_custkey"], F.col("o_orderstatus") == "P")


@query("SELECT o_custkey, period_year, o_orderkey FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS period_year, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def io2_filing_for_period(s, d):
    f = table(s, d, "orders").withColumn("filing_order", F.col("o_orderkey"))
    return corpus.filing_for_period(f, "o_custkey", "o_orderdate").select("o_custkey", "period_year", "o_orderkey")


@query("SELECT c_custkey AS o_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey) AS held FROM customer")
def io4_exists(s, d):
    wanted = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return reads.exists(table(s, d, "orders"), wanted, ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def io5_duplicate_keys(s, d):
    return reads.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {CTE_BASE} SELECT id, ticker, EXISTS (SELECT 1 FROM recs r WHERE r.document_id = d.id AND r.extraction_status = 'success') AS is_extracted FROM docs d")
def io6_derived_flag(s, d):
    return reads.with_derived_flag(docs(s, d), records(s, d)).select("id", "ticker", "is_extracted")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages")
def io7_page_artifacts(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"))


_BODY = "string_agg(CAST(o_orderkey AS STRING), ',' ORDER BY o_orderkey) AS body"


@query(f"WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, {_BODY} FROM orders GROUP BY 1, 2), n AS (SELECT o_custkey, y, {_BODY} FROM (SELECT DISTINCT o_custkey, o_orderkey, year(l_shipdate) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2) SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CAST(coalesce(o.y, n.y) AS INT) AS y, CASE WHEN n.body IS NULL THEN 'kept' WHEN o.body IS NULL THEN 'new' WHEN o.body = n.body THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.y = n.y")
def io8_write_status(s, d):
    """The orders that each customer placed in a year, as written, against those with lines shipped in it."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    shipped = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("y")).join(o.drop("y"), "o_orderkey").distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("body")
    return corpus.write_status(o.groupBy("o_custkey", "y").agg(body), shipped.groupBy("o_custkey", "y").agg(body), ["o_custkey", "y"], "body")


@query("SELECT o_custkey, seq, price FROM (SELECT o_custkey, o_orderkey AS seq, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 0 END DESC, o_orderkey DESC) AS n FROM orders WHERE o_totalprice > 1000) WHERE n = 1")
def io9_upsert(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("y"))
    return corpus.upsert(o.where("y < 1998").drop("y"), o.where("y >= 1998").drop("y"), ["o_custkey"], F.col("price") > 1000)


@query("WITH f AS (SELECT l_orderkey AS filing, CASE l_returnflag WHEN 'A' THEN 'us-gaap_Revenues' WHEN 'N' THEN 'us-gaap_ProfitLoss' ELSE 'us-gaap_NetIncomeLoss' END AS concept, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS value, l_linestatus = 'O' AS dimension, l_linenumber % 7 = 0 AS abstract, l_linenumber * 1000000 + l_partkey AS line_no FROM lineitem), o(field, concept, priority) AS (VALUES ('total_revenue', 'us-gaap_Revenues', 0), ('net_income', 'us-gaap_NetIncomeLoss', 0), ('net_income', 'us-gaap_ProfitLoss', 1)) SELECT filing, field, min(value) AS value FROM (SELECT f.*, o.field, rank() OVER (PARTITION BY filing, field ORDER BY priority, line_no) AS k FROM f JOIN o USING (concept) WHERE NOT dimension AND NOT abstract AND value IS NOT NULL) WHERE k = 1 GROUP BY 1, 2")
def io10_first_concept(s, d):
    li = table(s, d, "lineitem")
    f = li.select(F.col("l_orderkey").alias("filing"), F.expr("CASE l_returnflag WHEN 'A' THEN 'us-gaap_Revenues' WHEN 'N' THEN 'us-gaap_ProfitLoss' ELSE 'us-gaap_NetIncomeLoss' END").alias("concept"), F.expr("CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice END").alias("value"), F.expr("l_linestatus = 'O'").alias("dimension"), F.expr("l_linenumber % 7 = 0").alias("abstract"), F.struct(F.expr("l_linenumber * 1000000 + l_partkey").alias("n"), "l_extendedprice").alias("line_no"))
    return corpus.first_concept(f)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), ' (FY)') END AS col FROM orders")
def io11_period_column(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cols = F.array(F.lit("concept"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit(" (FY)"))).otherwise(F.lit("label")), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.lit("unit")))
    return table(s, d, "orders").select("o_orderkey", corpus.period_column(cols, day).alias("col"))


_CURRENT = "(SELECT d.*, l.fiscal_year_end, l.auditor_name, l.extracted_at, l.extraction_strategy_used, l.prompt_version, l.model_name FROM docs d JOIN latest l ON l.document_id = d.id)"
_EXPORTED = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {e} END) AS {m}{x}" for m in METRICS for x, e in (("", "value"), ("_quality", "verdict"), ("_quality_reason", "reason"), ("_quality_note", _NOTE), ("_source_line", "line")))


@query(f"WITH {CTE_ASSESSED} SELECT c.ticker, c.company_name, c.cik, c.filing_year AS fiscal_year, c.fiscal_year_end, c.auditor_name, {_EXPORTED}, c.extraction_strategy_used, c.prompt_version, c.model_name, strftime(c.extracted_at, '%Y-%m-%dT%H:%M:%S') AS extracted_at FROM {_CURRENT} c JOIN judged j ON j.document_id = c.id GROUP BY c.ticker, c.company_name, c.cik, c.filing_year, c.fiscal_year_end, c.auditor_name, c.extraction_strategy_used, c.prompt_version, c.model_name, c.extracted_at")
def io12_export(s, d):
    return corpus.export_rows(reads.current(docs(s, d), records(s, d)))


@query("SELECT vec_id, label FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.n_chars % 10 = e.label)")
def io16_chunks_by_key(s, d):
    """Embeddings by (label, id) as all documents name them; most name one that nobody holds."""
    from ..operators import retrieval

    keys = table(s, d, "documents").select((F.col("n_chars") % 10).cast("int").alias("label"), F.col("doc_id").alias("vec_id"))
    return retrieval.chunks_by_key(table(s, d, "embeddings"), keys, ["label", "vec_id"]).select("vec_id", "label")


@query("SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def io17_row_counts(s, d):
    n = [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("documents", "pages")]
    return n[0].unionByName(n[1])


@query("SELECT doc_id, substr(sha256(concat(lang, chr(0), source, chr(0), text)), 1, 32) AS cache_key, doc_id % 3 = 0 AS hit FROM documents")
def io18_cache(s, d):
    t = table(s, d, "documents").select("doc_id", "lang", "source", "text")
    parts = ["lang", "source", "text"]
    answered = t.join(table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    cache = answered.select(X.cache_key(*(F.col(p) for p in parts)).alias("cache_key"), F.lit("x").alias("response"), F.col("doc_id").alias("own")).drop("own").distinct()
    hit, miss = corpus.cached_or_missing(t, cache, parts)
    return hit.select("doc_id", "cache_key", F.lit(True).alias("hit")).unionByName(miss.select("doc_id", "cache_key", F.lit(False).alias("hit")))


ORACLE_SQL["io18_cache"] = "WITH k AS (SELECT doc_id, substr(sha256(concat(lang, chr(0), source, chr(0), text)), 1, 32) AS cache_key FROM documents) SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) AS hit FROM k"


@query("SELECT concat('T', CAST(c_custkey AS STRING)) AS ticker, c_custkey AS id FROM customer WHERE c_custkey % 4 = 0")
def io20_pending(s, d):
    return corpus.pending(docs(s, d), "is_embedded").select("ticker", "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def io21_held_out(s, d):
    evaluated = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return corpus.in_scope(docs(s, d), "held_out", evaluated, ["id"]).select("id")


@query("SELECT n_name AS ticker, CAST(2021 + n_nationkey % 3 AS INT) AS year FROM nation")
def io22_targets(s, d):
    return corpus.targets(table(s, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("position")), 2021).select("ticker", "year")


# joins

@query("WITH n AS (SELECT n_nationkey, string_split(lower(n_name), ' ') AS t FROM nation), p AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS t FROM part) SELECT a.n_nationkey AS mention_id, b.n_nationkey AS name_id FROM n a JOIN n b ON len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) = 0")
def j6_token_containment(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.split(F.lower("n_name"), " ").alias("tokens"))
    return joins.name_matches(n.withColumnRenamed("n_nationkey", "mention_id"), n.withColumnRenamed("n_nationkey", "name_id"))


@query("WITH c AS (SELECT o_orderkey AS claim_id, unnest(CAST([o_orderkey % 7, o_custkey % 9, o_orderkey % 7] AS INT[])) AS cite, unnest([0, 1, 2]) AS pos FROM orders), f AS (SELECT claim_id, cite, min(pos) AS pos FROM c GROUP BY 1, 2) SELECT claim_id, array_to_string(list(CAST(cite AS STRING) ORDER BY pos) FILTER (cite BETWEEN 1 AND 5), ',') AS valid, CAST(count(*) FILTER (cite NOT BETWEEN 1 AND 5) AS BIGINT) AS invalid FROM f GROUP BY 1")
def j9_q8_citations(s, d):
    c = table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.array((F.col("o_orderkey") % 7).cast("int"), (F.col("o_custkey") % 9).cast("int"), (F.col("o_orderkey") % 7).cast("int")).alias("cites"))
    blocks = s.range(1, 6).select(F.col("id").cast("int").alias("rank"))
    return joins.cited(c, blocks).select("claim_id", F.nullif(F.array_join(F.transform("valid", lambda x: x.cast("string")), ","), F.lit("")).alias("valid"), "invalid")


@query("SELECT c_custkey AS task_id, coalesce(o.status, 'failed') AS status FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def j10_outcomes(s, d):
    tasks = table(s, d, "customer").select(F.col("c_custkey").alias("task_id"))
    outcomes = table(s, d, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.min("o_orderstatus").alias("status"))
    return joins.outcomes_of(tasks, outcomes)


@query("WITH a AS (SELECT o_custkey, o_orderkey AS l_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS r_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'O') SELECT a.o_custkey, CAST(a.nth AS INT) AS nth, l_id, r_id FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.nth = b.nth")
def j12_multiset_alignment(s, d):
    o = table(s, d, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("l_id"))
    b = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("r_id"))
    return joins.aligned(a, b, "o_custkey", "l_id", "r_id")


@query("SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)")
def j13_orphans(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return joins.orphans(table(s, d, "events").select("event_id", "user_id"), sup, "user_id")


_CMP = "WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey % 5 END AS v FROM customer), b AS (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey % 5 END AS v FROM customer UNION ALL SELECT -1 - s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey % 5 END FROM supplier) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k"


@query(_CMP)
def j15_j16_parity(s, d):
    """All customers against all customers numbered a hundred on, whose group of nations may be another, and all suppliers, whom only one side has."""
    v = "CASE WHEN {0}key % 5 = 0 THEN NULL ELSE {1}_nationkey % 5 END AS v"
    a = table(s, d, "customer").selectExpr("c_custkey AS k", v.format("c_cust", "c"))
    b = table(s, d, "customer").selectExpr("c_custkey + 100 AS k", v.format("c_cust", "c")).unionByName(table(s, d, "supplier").selectExpr("-1 - s_suppkey AS k", v.format("s_supp", "s")))
    return joins.compared(a, b, ["k"], "v").select("k", "status")


# text

_HAZARDS = ("BANK OF AMERICA CORP /DE/", "QUALCOMM INC/DE", "AMAZON COM INC", "salesforce.com, inc.", "JPMORGAN CHASE & CO", "AT&T INC", "J.P. MORGAN, INC., ", "", "The  Goldman-Sachs Group")


def _names(s, d):
    fixed = s.createDataFrame([(x,) for x in _HAZARDS], "name string")
    return table(s, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(s, d, "nation").select(F.col("n_name").alias("name"))).unionByName(table(s, d, "part").select(F.col("p_type").alias("name"))).unionByName(fixed).distinct()


_NAMES = "names AS (SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_type FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in _HAZARDS) + ")))"
_NORMAL = "trim(regexp_replace(lower(split_part(name, '/', 1)), '[^a-z0-9]+', ' ', 'g'))"
_GENERIC = "[" + ", ".join(f"'{t}'" for t in X.GENERIC_TOKENS) + "]"


@query(f"WITH {_NAMES} SELECT name, {_NORMAL} AS normal FROM names")
def t1_normalise(s, d):
    return _names(s, d).select("name", X.normalise(F.col("name")).alias("normal"))


@query(f"WITH {_NAMES} SELECT name, array_to_string(list_sort(list_distinct(list_filter(string_split({_NORMAL}, ' '), lambda t: t <> '' AND NOT list_contains({_GENERIC}, t)))), ' ') AS tokens FROM names")
def t2_identifying_tokens(s, d):
    return _names(s, d).select("name", F.array_join(X.identifying_tokens(F.col("name")), " ").alias("tokens"))


_CLEAN = "regexp_replace(trim(regexp_replace(name, '/[A-Z]{2}/?\\s*$', '')), ',+$', '')"


@query(f"WITH {_NAMES} SELECT name, CASE WHEN regexp_matches({_CLEAN}, '[a-z]') THEN {_CLEAN} ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({_CLEAN}, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('of', 'and', 'the', 'for', 'in', 'on', 'at', 'to') THEN lower(w) ELSE array_to_string(list_transform(regexp_extract_all(w, '[A-Za-z]+|[^A-Za-z]+'), lambda r: concat(upper(substr(r, 1, 1)), lower(substr(r, 2)))), '') END), ' ') END AS display FROM names")
def t6_display_name(s, d):
    return _names(s, d).select("name", X.display_name(F.col("name"), F.lit(None).cast("string")).alias("display"))


@query(f"WITH {_NAMES} SELECT name, nullif(trim(regexp_replace(translate(lower(name), '.,', '  '), '\\s+', ' ', 'g')), '') AS scoring FROM names")
def t7_scoring_text(s, d):
    return _names(s, d).select("name", X.scoring_text(F.col("name")).alias("scoring"))


@query("SELECT doc_id, sha256(replace(regexp_replace(lower(text), '\\s+', '', 'g'), '$', '')) AS flat, sha256(regexp_replace(text, '\\s+', '', 'g')) AS unspaced FROM documents")
def t8_t9_flattened(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.flattened(F.col("text")), 256).alias("flat"), F.sha2(X.unspaced(F.col("text")), 256).alias("unspaced"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(translate(text, '‘’“”', '''''\"\"'), '\\s+', ' ', 'g')))) AS span FROM documents")
def t10_span_text(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.span_text(F.col("text")), 256).alias("span"))


_CLAIMS = ("Revenue grew (passage 1).", "Sales rose (2, 3) in 2021 (2021).", "Costs fell [1] , and margins [2-4] improved .", "Nothing to strip", "Growth (10%) held (blocks 1 and 2) .", "(Source 9)A start")


@query("WITH c AS (SELECT concat(x, ' ', CAST(o_orderkey AS STRING), ' (', CAST(o_orderkey % 250 AS STRING), ') ,') AS claim FROM orders, (VALUES " + ", ".join(f"('{x}')" for x in _CLAIMS) + ") v(x)) SELECT claim, trim(regexp_replace(regexp_replace(regexp_replace(trim(claim), '(?i)\\s*(?:\\((?:(?:passages?|blocks?|sources?)\\s+)?\\d{1,2}(?:\\s*(?:,|and|&|-|–)\\s*\\d{1,2})*\\)|\\[\\d{1,2}(?:\\s*(?:,|and|&|-|–)\\s*\\d{1,2})*\\])', '', 'g'), '\\s+([.,;:])', '\\1', 'g'), '\\s{2,}', ' ', 'g')) AS cleaned FROM c")
def t11_clean_claim(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.explode(X.literals(_CLAIMS)).alias("x"))
    c = o.select(F.concat("x", F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ("), (F.col("o_orderkey") % 250).cast("string"), F.lit(") ,")).alias("claim"))
    return c.select("claim", X.clean_claim(F.col("claim")).alias("cleaned"))


_SUFFIXES = ("", " billion", "bn", " million dollars", "k", " dollars", " usd", " zillion", " T", "mm")
_SCALE_SQL = "CASE s " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in X.SCALES.items()) + " END"


@query("WITH t AS (SELECT DISTINCT concat(CASE WHEN p_partkey % 2 = 0 THEN '$' ELSE ' ' END, CAST(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.5' WHEN p_partkey % 5 = 0 THEN ',000' ELSE '' END, x) AS phrase FROM part, (VALUES " + ", ".join(f"('{x}')" for x in _SUFFIXES) + f") v(x)), m AS (SELECT phrase, regexp_matches(lower(phrase), '^\\s*\\$?\\s*(\\d[\\d,]*\\.?\\d*)\\s*([a-z]+)?\\s*(?:dollars|usd)?\\s*$') AS ok, CAST(nullif(replace(regexp_extract(lower(phrase), '^\\s*\\$?\\s*(\\d[\\d,]*\\.?\\d*)\\s*([a-z]+)?\\s*(?:dollars|usd)?\\s*$', 1), ',', ''), '') AS DOUBLE) AS n, regexp_extract(lower(phrase), '^\\s*\\$?\\s*(\\d[\\d,]*\\.?\\d*)\\s*([a-z]+)?\\s*(?:dollars|usd)?\\s*$', 2) AS s FROM t) SELECT phrase, CASE WHEN ok THEN CASE WHEN s = '' THEN n ELSE n * {_SCALE_SQL} END END AS dollars FROM m")
def t12_parse_threshold(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size", F.explode(X.literals(_SUFFIXES)).alias("x"))
    phrase = F.concat(F.when(F.col("p_partkey") % 2 == 0, "$").otherwise(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".5").when(F.col("p_partkey") % 5 == 0, ",000").otherwise(""), "x")
    return p.select(phrase.alias("phrase")).distinct().select("phrase", X.parse_threshold(F.col("phrase")).alias("dollars"))


@query("SELECT doc_id, len(n) AS n_numbers, round(list_sum(n), 3) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(translate(text, '$', ' '), '\\d[\\d,]*\\.?\\d*'), lambda x: CAST(regexp_replace(replace(x, ',', ''), '\\.+$', '') AS DOUBLE)) AS n FROM documents)")
def t13_numbers(s, d):
    n = X.numbers_in_line(F.col("text"))
    return table(s, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.when(F.size("n") > 0, F.round(F.aggregate("n", F.lit(0.0), lambda a, b: a + b), 3)).alias("total"))


@query(f"WITH {CTE_LATEST} SELECT id, CASE WHEN v IS NULL THEN 'not extracted' WHEN v >= 1e9 THEN concat('$', regexp_replace(regexp_replace(format('{{:,.2f}}', v / 1e9), '0+$', ''), '\\.$', ''), ' billion') WHEN v >= 1e6 THEN concat('$', regexp_replace(regexp_replace(format('{{:,.2f}}', v / 1e6), '0+$', ''), '\\.$', ''), ' million') ELSE concat('$', format('{{:,}}', CAST(v AS BIGINT))) END AS shown FROM (SELECT id, CASE WHEN id % 3 = 0 THEN CAST(floor(operating_cash_flow / 1e6) * 1000 AS DOUBLE) ELSE floor(total_revenue / 1e9) * 1e9 / CASE WHEN id % 2 = 0 THEN 4 ELSE 1 END END AS v FROM latest)")
def t14_format_value(s, d):
    r = reads.latest_success(records(s, d)).selectExpr("id", "CASE WHEN id % 3 = 0 THEN CAST(floor(operating_cash_flow / 1e6) * 1000 AS DOUBLE) ELSE floor(total_revenue / 1e9) * 1e9 / CASE WHEN id % 2 = 0 THEN 4 ELSE 1 END END AS v")
    return r.select("id", X.format_value(F.col("v")).alias("shown"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def t15_iso_date(s, d):
    return table(s, d, "events").select("event_id", X.to_iso_date(F.col("ts")).alias("day"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 10, '0') AS cik FROM customer")
def t16_cik(s, d):
    return table(s, d, "customer").select("c_custkey", X.normal_cik(F.col("c_custkey")).alias("cik"))


@query("SELECT page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) AS h FROM pages")
def t17_canonical_hash(s, d):
    return table(s, d, "pages").select("page_id", X.canonical_hash(F.col("html")).alias("h"))


@query("SELECT conv_id, turn, concat_ws('|', concat('C', CAST(conv_id AS STRING)), role, CAST(turn AS STRING)) AS key, concat('C', CAST(conv_id AS STRING)) AS ticker, role AS section, CAST(turn AS INT) AS chunk_index FROM conversations")
def t18_keys(s, d):
    k = X.chunk_key(F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.col("role"), F.col("turn"))
    return table(s, d, "conversations").select("conv_id", "turn", k.alias("key")).withColumn("p", X.split_key(F.col("key"))).select("conv_id", "turn", "key", "p.ticker", "p.section", "p.chunk_index")


@query("WITH n AS (SELECT concat('N', CAST(n_nationkey AS STRING)) AS ticker, n_name AS name FROM nation), m AS (SELECT c_custkey AS mention_id, CASE c_custkey % 5 WHEN 0 THEN concat('n', CAST(c_custkey % 30 AS STRING)) WHEN 1 THEN nn.n_name WHEN 2 THEN lower(nn.n_name) WHEN 3 THEN '  ' ELSE 'the company' END AS mention FROM customer c JOIN nation nn ON nn.n_nationkey = c.c_nationkey) SELECT m.mention_id, coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NOT NULL OR b.ticker IS NOT NULL THEN NULL WHEN trim(mention) = '' THEN 'no_company_mention' WHEN mention = 'the company' THEN 'ambiguous_company' ELSE 'non_corpus_company' END AS failure FROM m LEFT JOIN n a ON a.ticker = upper(trim(m.mention)) LEFT JOIN n b ON a.ticker IS NULL AND lower(b.name) = lower(m.mention)")
def t3_resolve_company(s, d):
    n = table(s, d, "nation")
    index = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("company_name"))
    c = table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    kind = F.col("c_custkey") % 5
    m = c.select(F.col("c_custkey").alias("mention_id"), F.when(kind == 0, F.concat(F.lit("n"), (F.col("c_custkey") % 30).cast("string"))).when(kind == 1, F.col("n_name")).when(kind == 2, F.lower("n_name")).when(kind == 3, "  ").otherwise("the company").alias("mention"))
    return resolve.resolve_company(m, index).select("mention_id", "ticker", "failure")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'non_corpus_company' WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 1 THEN 'year_not_held' WHEN c_custkey % 4 = 0 THEN 'company_not_embedded' WHEN c_custkey % 5 = 0 THEN 'company_not_extracted' END AS failure FROM customer")
def t4_t5_first_failure(s, d):
    k = F.col("c_custkey")
    out = resolve.first_failure(F.when(k % 10 == 0, "non_corpus_company"), F.when(k % 2 == 0, 2022), 2021 + k % 3, k % 4 != 0, k % 5 != 0, F.lit(True), F.lit(True))
    return table(s, d, "customer").select("c_custkey", out.alias("failure"))


@query("WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('## item', CAST(turn AS STRING)) WHEN turn % 3 = 1 THEN concat('Label: ', CASE WHEN conv_id % 2 = 0 THEN 's' ELSE 'x' END) ELSE 'text' END AS line FROM conversations), h AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS item FROM l) SELECT conv_id, item, max(CASE WHEN line = 'Label: s' THEN 'S' END) AS label FROM h WHERE line LIKE 'Label:%' AND item IS NOT NULL GROUP BY 1, 2")
def t19_label_sheet(s, d):
    from ..operators import evaluation

    c = table(s, d, "conversations")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## item"), F.col("turn").cast("string"))).when(F.col("turn") % 3 == 1, F.when(F.col("conv_id") % 2 == 0, "Label: s").otherwise("Label: x")).otherwise("text")
    return evaluation.label_sheet(c.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@query("SELECT concat('T', CAST(c_custkey AS STRING)) AS ticker, c_name AS company_name, CAST(2021 + c_custkey % 3 AS INT) AS filing_year, c_custkey % 4 <> 0 AS is_embedded FROM customer")
def io19_listing(s, d):
    return docs(s, d).select("ticker", "company_name", "filing_year", "is_embedded").orderBy("ticker")


@query(f"WITH {CTE_LATEST} SELECT id, net_income, net_income_source_line AS line, CAST(" + " + ".join(f"CASE WHEN {m} IS NOT NULL THEN 1 ELSE 0 END" for m in METRICS) + " AS INT) AS n_figures FROM latest")
def e2_evidence_map(s, d):
    r = reads.latest_success(records(s, d)).select("id", extraction.evidence_map().alias("e"))
    plain = extraction.plain_figures(F.col("e"))
    return r.select("id", plain["net_income"].alias("net_income"), F.col("e")["net_income"]["source_line"].alias("line"), F.size(F.map_filter(plain, lambda _, v: v.isNotNull())).alias("n_figures"))


@query("SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), substr(text, 1, 12000), text)) AS assembled FROM documents")
def e3_assembled_input(s, d):
    """The cover and the whole statements; a document without a part of its own for them has its full text there."""
    text = F.col("text")
    return table(s, d, "documents").select("doc_id", F.sha2(extraction.assembled_input(sections.cover(text), text), 256).alias("assembled"))

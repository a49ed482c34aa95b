"""Queries of retrieval, sections, evaluation statistics, limits and plans, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import evaluation as ev
from ..operators import guards, reads, resolve, retrieval, sections
from ..plans import executor, planner
from ..streaming import limits
from .frames import CTE_LATEST, docs, records, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# retrieval over embeddings: label is the company, the query is the vector of least id

def _query_vector(s, d) -> list[float]:
    return table(s, d, "embeddings").orderBy("vec_id").first()["embedding"]


_DIST = "q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1), dist AS (SELECT vec_id, label, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(qe[i] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS distance FROM embeddings, q)"


@query(f"WITH {_DIST} SELECT vec_id, round(distance, 6) AS distance FROM (SELECT * FROM dist WHERE label IN (2, 4, 6) ORDER BY distance, vec_id LIMIT 10)")
def c10_filtered_nearest(s, d):
    return retrieval.nearest(table(s, d, "embeddings"), _query_vector(s, d), 10, F.col("label").isin(2, 4, 6)).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_DIST} SELECT label, vec_id, rank, round(distance, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS INT) AS rank FROM dist) WHERE rank <= 2")
def c11_nearest_each(s, d):
    return retrieval.nearest_each(table(s, d, "embeddings"), _query_vector(s, d), 2, "label").select("label", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT label, count(*) AS n_blocks, 'searched' AS status FROM embeddings GROUP BY 1")
def c16_all_groups(s, d):
    e = table(s, d, "embeddings")
    return retrieval.with_status(e.select("label").distinct(), e, "label").select("label", F.col("n_blocks").cast("long").alias("n_blocks"), "status")


_GROUP = "concat(source, '|', CAST(n_chars // 500 AS STRING))"


@query(f"WITH t AS (SELECT *, {_GROUP} AS grp FROM documents), has AS (SELECT grp, bool_or(lang = 'en') AS own FROM t WHERE lang IN ('en', 'de') GROUP BY 1) SELECT t.grp, doc_id, NOT h.own AS fallback_used FROM t JOIN has h ON h.grp = t.grp WHERE CASE WHEN h.own THEN lang = 'en' ELSE lang = 'de' END")
def c14_structural_fallback(s, d):
    t = table(s, d, "documents").withColumn("grp", F.expr("concat(source, '|', CAST(n_chars div 500 AS STRING))"))
    return retrieval.with_fallback(t.select("grp").distinct(), t, F.col("lang") == "en", F.col("lang") == "de", "grp").select("grp", "doc_id", "fallback_used")


@query("WITH p(intent, sections) AS (VALUES ('company_overview', ['Item 1']), ('strategy', ['Item 1', 'Item 7']), ('competition_and_regulation', ['Item 1', 'Item 1A']), ('risk_factors', ['Item 1A']), ('management_commentary', ['Item 7']), ('market_risk', ['Item 7', 'Item 7A'])), a(section, stored) AS (VALUES ('Item 1', 'Item 1A')), t AS (SELECT source, bool_and(lang <> 'es') AS renamed FROM documents GROUP BY 1) SELECT concat(t.source, '|', intent) AS ticker, array_to_string(list_sort(list_distinct(list(coalesce(CASE WHEN t.renamed THEN a.stored END, s)))), ',') AS sections FROM (SELECT intent, unnest(sections) AS s FROM p) x CROSS JOIN t LEFT JOIN a ON a.section = s GROUP BY 1")
def c12_c13_section_policy(s, d):
    """The sections that each kind of question searches, for every source; sources without Spanish texts keep Item 1 under another label."""
    t = table(s, d, "documents").groupBy("source").agg(F.bool_and(F.col("lang") != "es").alias("renamed"))
    policy = F.array(*(F.struct(F.lit(i).alias("intent"), X.literals(x).alias("sections")) for i, x in retrieval.POLICY.items()))
    asked = t.withColumn("p", F.explode(policy)).select(F.concat_ws("|", "source", "p.intent").alias("ticker"), "p.sections", "renamed")
    alias = asked.where("renamed").select("ticker", F.lit(retrieval.ITEM_1).alias("section"), F.array(F.lit(retrieval.ITEM_1A)).alias("stored"))
    return retrieval.stored_sections(asked, alias).select("ticker", F.array_join("sections", ",").alias("sections"))


@query("SELECT conv_id, string_agg(concat('[', CAST(turn + 1 AS STRING), '] ', text), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def c15_numbered_context(s, d):
    c = table(s, d, "conversations").withColumn("rank", F.col("turn") + 1)
    return retrieval.numbered_context(c, "conv_id")


@query("WITH r AS (SELECT doc_id AS vec_id, rank, hits FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, len(regexp_extract_all(text, 'the')) AS hits FROM documents)), b AS (SELECT vec_id, 10 + row_number() OVER (ORDER BY hits DESC, rank) AS place FROM r WHERE hits > 0) SELECT vec_id, CAST(min(place) AS INT) AS place FROM (SELECT vec_id, rank AS place FROM r WHERE rank <= 10 UNION ALL SELECT vec_id, place FROM b WHERE place <= 35) GROUP BY 1")
def c17_candidate_pool(s, d):
    t = table(s, d, "documents")
    from pyspark.sql import Window

    # rank over ranges of length, so that no one task sorts all
    per = t.groupBy("n_chars").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n_chars", "before")
    nth = F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id"))
    ranked = t.select("doc_id", "n_chars").withColumn("nth", nth).join(before, "n_chars").select(F.col("doc_id").alias("vec_id"), (F.col("before") + F.col("nth")).cast("int").alias("rank"))
    hits = t.select(F.col("doc_id").alias("vec_id"), F.regexp_count("text", F.lit("the")).alias("hits"))
    return retrieval.candidate_pool(ranked, hits).select("vec_id", F.col("place").cast("int").alias("place"))


@query("WITH r AS (SELECT concat('T', CAST(l_suppkey % 40 AS STRING)) AS ticker, CAST(2021 AS INT) AS fiscal_year, l_returnflag AS section, l_linenumber AS chunk_index, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS position FROM lineitem) SELECT ticker, section, chunk_index, CAST(dense_rank() OVER (ORDER BY p) AS INT) AS number FROM (SELECT ticker, fiscal_year, section, chunk_index, min(position) AS p FROM r GROUP BY 1, 2, 3, 4)")
def s3_citation_numbers(s, d):
    r = table(s, d, "lineitem").select(F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string")).alias("ticker"), F.lit(2021).alias("fiscal_year"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"))
    return retrieval.citation_numbers(r).select("ticker", "section", "chunk_index", "number")


# every embedding is searched: four sections by id, and a seed of each kind for each label and section, whose claim is the vector of least id

@query("WITH e AS (SELECT *, vec_id % 4 AS section, row_number() OVER (PARTITION BY label, vec_id % 4 ORDER BY vec_id) AS n FROM embeddings), s AS (SELECT label, section, kind, embedding AS qe FROM e, (VALUES ('wrong_block_same_company'), ('wrong_block_other_company')) k(kind) WHERE n = 1), d AS (SELECT s.label, s.section, kind, vec_id, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(qe[i] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS distance FROM s JOIN e ON e.section = s.section AND CASE kind WHEN 'wrong_block_same_company' THEN e.label = s.label AND n > 2 ELSE e.label <> s.label END), r AS (SELECT *, row_number() OVER (PARTITION BY label, section, kind ORDER BY distance, vec_id) AS nth, count(*) OVER (PARTITION BY label, section, kind) AS c FROM d) SELECT s.label, s.section, s.kind, CAST(nth AS INT) AS nth, vec_id, round(distance, 6) AS distance, CASE WHEN vec_id IS NULL THEN 'no_candidate' ELSE 'swapped' END AS status FROM s LEFT JOIN r ON r.label = s.label AND r.section = s.section AND r.kind = s.kind AND nth = CASE s.kind WHEN 'wrong_block_same_company' THEN least(10, c) ELSE 1 END")
def c21_seed_swap(s, d):
    from pyspark.sql import Window

    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("company"), (F.col("vec_id") % 4).alias("section"), "embedding")
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("company", "section").orderBy("vec_id"))).where("n <= 2")
    base = first.groupBy("company", "section").agg(F.min_by("embedding", "n").alias("claim"), F.collect_list("vec_id").alias("cited"))
    seeds = base.withColumn("kind", F.explode(X.literals((retrieval.SAME_COMPANY, retrieval.OTHER_COMPANY)))).withColumn("seed_id", F.concat_ws("|", "company", "section", "kind"))
    return retrieval.seed_swap(seeds, e).select(F.col("company").alias("label"), "section", "kind", "nth", "vec_id", F.round("distance", 6).alias("distance"), "status")


# sections and chunks

@query("SELECT doc_id, sha256(substr(text, 1, 12000)) AS cover FROM documents")
def c1_cover(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(sections.cover(F.col("text")), 256).alias("cover"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'full_text_no_statements' WHEN n_chars - n_chars // 3 < 1000 THEN 'full_text_below_floor' WHEN n_chars // 4 > 2000 THEN 'full_text_over_budget' ELSE 'statements' END AS section_source, length(CASE WHEN doc_id % 9 <> 0 AND n_chars - n_chars // 3 >= 1000 AND n_chars // 4 <= 2000 THEN substr(text, n_chars // 3 + 1) ELSE text END) AS n FROM documents")
def c2_statement_gate(s, d):
    t = table(s, d, "documents").withColumn("third", F.expr("CAST(n_chars div 3 AS INT)"))
    st = F.when(F.col("doc_id") % 9 != 0, F.substr("text", F.col("third") + 1))
    g = sections.statement_slice(st, F.col("text"), F.expr("n_chars div 4"), 1000, 2000)
    return t.select("doc_id", g.alias("g")).select("doc_id", "g.section_source", F.length("g.text").cast("long").alias("n"))


_SECT = "s AS (SELECT doc_id // 4 AS d, CASE doc_id % 4 WHEN 0 THEN 'Item 1A' WHEN 1 THEN 'Item 7' WHEN 2 THEN 'Item 1' ELSE 'Item 7A' END AS section, doc_id % 4 AS priority, regexp_replace(text, '\\s+', '', 'g') AS u, n_chars // 5 AS n_tokens FROM documents)"
_CLASH = "CASE WHEN length({a}) <= length({b}) THEN length({a}) >= 300 AND contains({b}, substr({a}, length({a}) // 2 + 1, 100)) ELSE length({b}) >= 300 AND contains({a}, substr({b}, length({b}) // 2 + 1, 100)) END"


@query(f"WITH {_SECT}, a0 AS (SELECT *, n_tokens >= 200 AS ok FROM s WHERE priority = 0), a1 AS (SELECT s.*, s.n_tokens >= 200 AND NOT coalesce(a0.ok AND {_CLASH.format(a='a0.u', b='s.u')}, FALSE) AS ok FROM s LEFT JOIN a0 ON a0.d = s.d WHERE s.priority = 1), a2 AS (SELECT s.*, s.n_tokens >= 200 AND NOT coalesce(a0.ok AND {_CLASH.format(a='a0.u', b='s.u')}, FALSE) AND NOT coalesce(a1.ok AND {_CLASH.format(a='a1.u', b='s.u')}, FALSE) AS ok FROM s LEFT JOIN a0 ON a0.d = s.d LEFT JOIN a1 ON a1.d = s.d WHERE s.priority = 2), a3 AS (SELECT s.*, s.n_tokens >= 200 AND NOT coalesce(a0.ok AND {_CLASH.format(a='a0.u', b='s.u')}, FALSE) AND NOT coalesce(a1.ok AND {_CLASH.format(a='a1.u', b='s.u')}, FALSE) AND NOT coalesce(a2.ok AND {_CLASH.format(a='a2.u', b='s.u')}, FALSE) AS ok FROM s LEFT JOIN a0 ON a0.d = s.d LEFT JOIN a1 ON a1.d = s.d LEFT JOIN a2 ON a2.d = s.d WHERE s.priority = 3) SELECT d AS doc_id, section, CAST(priority AS INT) AS priority FROM (SELECT d, section, priority, ok FROM a0 UNION ALL SELECT d, section, priority, ok FROM a1 UNION ALL SELECT d, section, priority, ok FROM a2 UNION ALL SELECT d, section, priority, ok FROM a3) WHERE ok")
def c3_c4_accepted_sections(s, d):
    t = table(s, d, "documents").select(F.expr("doc_id div 4").alias("doc_id"), F.element_at(X.literals(("Item 1A", "Item 7", "Item 1", "Item 7A")), (F.col("doc_id") % 4 + 1).cast("int")).alias("section"), "text", F.expr("n_chars div 5").alias("n_tokens"))
    return sections.accepted_sections(t, ("Item 1A", "Item 7", "Item 1", "Item 7A"), 200, 100, 300)


@query("WITH c AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(sha256(concat_ws('|', lang, '2021', source, CAST(i AS STRING), piece)), 1, 32) AS chunk_id FROM c WHERE length(trim(piece)) >= 100")
def c6_c7_chunks(s, d):
    t = table(s, d, "documents")
    c = sections.line_chunks(t).join(t.select("doc_id", "lang", "source"), "doc_id")
    return sections.with_ids(c, F.col("lang"), F.lit("2021"), F.col("source")).select("doc_id", "chunk_index", "chunk_id")


@query("WITH n AS (SELECT source AS ticker, CASE lang WHEN 'en' THEN 'Item 1' WHEN 'de' THEN 'Item 1A' WHEN 'fr' THEN 'Item 7' ELSE 'Item 7A' END AS section, count(*) AS n FROM documents GROUP BY 1, 2), p(intent, sections) AS (VALUES ('company_overview', ['Item 1']), ('strategy', ['Item 1', 'Item 7']), ('competition_and_regulation', ['Item 1', 'Item 1A']), ('risk_factors', ['Item 1A']), ('management_commentary', ['Item 7']), ('market_risk', ['Item 7A', 'Item 7'])) SELECT ticker, intent, CAST(sum(CASE WHEN list_contains(sections, section) THEN n ELSE 0 END) AS BIGINT) AS eligible, CASE WHEN sum(CASE WHEN list_contains(sections, section) THEN n ELSE 0 END) > 0 THEN 'answerable' ELSE 'section_absent' END AS status FROM n CROSS JOIN p GROUP BY 1, 2")
def c18_inventory(s, d):
    t = table(s, d, "documents").select(F.col("source").alias("ticker"), F.expr("CASE lang WHEN 'en' THEN 'Item 1' WHEN 'de' THEN 'Item 1A' WHEN 'fr' THEN 'Item 7' ELSE 'Item 7A' END").alias("section"))
    return sections.inventory(t, retrieval.POLICY)


@query("SELECT conv_id, turn, sha256(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS heading_before FROM conversations")
def c19_heading_carried(s, d):
    c = table(s, d, "conversations")
    return sections.headings_carried(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", F.sha2("heading_before", 256).alias("heading_before"))


@query("SELECT lang, min(n_chars) AS least, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, max(n_chars) AS greatest, CAST(count(*) FILTER (n_chars < 200) AS BIGINT) AS n_under, CAST(count(*) FILTER (n_chars > 4000) AS BIGINT) AS n_over FROM documents GROUP BY 1")
def c20_size_distribution(s, d):
    return sections.size_distribution(table(s, d, "documents"), "lang", "n_chars", 200, 4000)


# evaluation: lines are scored fields; the truth is the part key, asserted by a rule of the supplier

_SCORE = "sc AS (SELECT l_returnflag AS field, l_linestatus AS section_source, CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN l_partkey * 2 ELSE l_partkey END AS v, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey END AS t FROM lineitem), o AS (SELECT *, CASE WHEN t IS NULL THEN 'n_a' WHEN v IS NULL THEN 'missing' WHEN t = 0 THEN CASE WHEN v = 0 THEN 'correct' ELSE 'wrong' END WHEN abs(v - t) <= 1e-5 * t THEN 'correct' ELSE 'wrong' END AS outcome, CASE WHEN t IS NULL OR v IS NULL THEN NULL WHEN t = 0 THEN CASE WHEN v = 0 THEN 0.0::DOUBLE END ELSE CAST(abs(v - t) AS DOUBLE) / t END AS e FROM sc)"
_COUNTS = "count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'n_a') AS n_a, round(avg(e), 9) AS mean_rel_error"


def _scores(s, d):
    x = table(s, d, "lineitem").selectExpr("l_returnflag AS field", "l_linestatus AS section_source", "CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN l_partkey * 2 ELSE l_partkey END AS DOUBLE) AS v", "CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey END AS DOUBLE) AS t")
    o = ev.numeric_outcome(F.col("v"), F.col("t"))
    return x.select("field", "section_source", o.alias("outcome"), F.when(F.col("v").isNotNull() & F.col("t").isNotNull(), ev.relative_error(F.col("v"), F.col("t"))).alias("rel_error"))


def _shown(df, *groups):
    return df.select(*groups, "correct", "wrong", "missing", "n_a", F.round("mean_rel_error", 9).alias("mean_rel_error"), "n_scored", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_RATIOS = "SELECT {g}, correct, wrong, missing, n_a, mean_rel_error, correct + wrong + missing AS n_scored, round(CAST(correct AS DOUBLE) / (correct + wrong), 9) AS precision, round(CAST(correct AS DOUBLE) / (correct + wrong + missing), 9) AS recall, round(2.0::DOUBLE * correct / (2 * correct + 2 * wrong + missing), 9) AS f1 FROM c"


@query(f"WITH {_SCORE}, c AS (SELECT field, {_COUNTS} FROM o GROUP BY 1) " + _RATIOS.format(g="field"))
def a1_a2_field_metrics(s, d):
    return _shown(ev.field_metrics(_scores(s, d)), "field")


@query(f"WITH {_SCORE}, c AS (SELECT field, section_source, {_COUNTS} FROM o GROUP BY GROUPING SETS ((field), (field, section_source))) " + _RATIOS.format(g="field, section_source"))
def a3_by_provenance(s, d):
    return _shown(ev.field_metrics(_scores(s, d), True), "field", "section_source")


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linenumber = 4 THEN NULL WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rate FROM lineitem GROUP BY 1")
def a4_grounding_rate(s, d):
    flag = F.when(F.col("l_linenumber") != 4, F.col("l_discount") > 0.05)
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(flag.cast("double")), 9).alias("rate"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS billed_in, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 ELSE 0 END) AS BIGINT) AS billed_out, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS cached_in, round(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE 0 END) / 1e6 * 0.15 + sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 ELSE 0 END) / 1e6 * 0.6, 6) AS cost FROM orders GROUP BY 1")
def a5_a6_costs(s, d):
    r = table(s, d, "orders").selectExpr("o_orderstatus AS status", "o_orderkey % 3 = 0 AS cached", "o_custkey AS input_tokens", "o_orderkey % 100 AS output_tokens")
    return ev.run_costs(r, 0.15, 0.6).withColumn("cost", F.round("cost", 6))


_WILSON = "round(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (({s}) / ({n}) + 3.8416::DOUBLE / (2 * ({n}))) / (1 + 3.8416::DOUBLE / ({n})) - 1.96::DOUBLE * sqrt(({s}) / ({n}) * (1 - ({s}) / ({n})) / ({n}) + 3.8416::DOUBLE / (4 * ({n}) * ({n}))) / (1 + 3.8416::DOUBLE / ({n}))) END, 9) AS {low}, round(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (({s}) / ({n}) + 3.8416::DOUBLE / (2 * ({n}))) / (1 + 3.8416::DOUBLE / ({n})) + 1.96::DOUBLE * sqrt(({s}) / ({n}) * (1 - ({s}) / ({n})) / ({n}) + 3.8416::DOUBLE / (4 * ({n}) * ({n}))) / (1 + 3.8416::DOUBLE / ({n}))) END, 9) AS {high}"


@query("WITH c AS (SELECT c_nationkey, CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) SELECT c_nationkey, " + _WILSON.format(s="s", n="n", low="low", high="high") + " FROM c")
def a7_wilson(s, d):
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("s"), F.count("*").alias("n")).withColumn("w", stats.wilson(F.col("s"), F.col("n")))
    return c.select("c_nationkey", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("WITH q AS (SELECT event_type, user_id, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s, avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS l, count(DISTINCT props) > 1 AS pv, count(DISTINCT value > 50) > 1 AS sv FROM events GROUP BY 1, 2), g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, sum(s) AS s, sum(l) AS l, count(*) FILTER (pv) AS plan_varied, count(*) FILTER (sv) AS score_varied FROM q GROUP BY 1) SELECT event_type AS grp, CAST(n AS BIGINT) AS n, round(s / n, 9) AS strict_mean, round(l / n, 9) AS lenient_mean, " + _WILSON.format(s="s", n="n", low="strict_low", high="strict_high") + ", plan_varied, score_varied FROM g")
def a8_group_summary(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("grp"), F.col("user_id").alias("question"), F.col("event_id").alias("run"), (F.col("value") > 50).alias("strict"), (F.col("value") > 20).alias("lenient"), F.col("props").alias("signature"))
    out = ev.group_summary(e, "grp")
    return out.select("grp", "n", *(F.round(c, 9).alias(c) for c in ("strict_mean", "lenient_mean", "strict_low", "strict_high")), "plan_varied", "score_varied")


def _routing(s, d):
    """Events as scores: a question is a user, a run an hour of the day."""
    return table(s, d, "events").select(F.col("event_type").alias("grp"), F.col("user_id").alias("question"), F.hour(F.col("ts").cast("timestamp_ntz")).alias("run"), (F.col("value") > 50).alias("strict"), (F.col("value") > 20).alias("lenient"), F.col("props").alias("signature"))


@query("SELECT event_type AS grp, CAST(extract('hour' FROM ts) AS INT) AS run, count(*) FILTER (value > 50) AS strict, count(*) FILTER (value > 20) AS lenient FROM events GROUP BY 1, 2")
def a8_run_counts(s, d):
    return ev.run_counts(_routing(s, d), "grp")


@query("WITH q AS (SELECT event_type, user_id, avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS l FROM events GROUP BY 1, 2), g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, sum(l) AS l FROM q GROUP BY 1) SELECT event_type AS grp, " + _WILSON.format(s="l", n="n", low="lenient_low", high="lenient_high") + " FROM g")
def a8_lenient_interval(s, d):
    out = ev.group_summary(_routing(s, d), "grp")
    return out.select("grp", F.round("lenient_low", 9).alias("lenient_low"), F.round("lenient_high", 9).alias("lenient_high"))


@query("WITH a AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS k FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS k FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) SELECT a.l_orderkey, a.k = b.k AS same FROM a JOIN b USING (l_orderkey)")
def a9_multiset_match(s, d):
    li = table(s, d, "lineitem")
    a, b = (ev.multisets(li.where(F.col("l_linenumber") % 2 == i), "l_orderkey", F.col("l_returnflag")).withColumnRenamed("keys", f"k{i}") for i in (0, 1))
    return a.join(b, "l_orderkey").select("l_orderkey", (F.col("k0") == F.col("k1")).alias("same"))


_PT = "CASE {x} % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'hybrid' ELSE 'single' END"
_PLANS = "ob AS (SELECT o_custkey AS question, o_orderkey AS run, " + _PT.format(x="o_orderkey") + " AS pt, o_orderstatus AS reason, o_orderkey % 17 = 0 AS fb, CASE WHEN o_orderkey % 2 = 0 THEN ['a'] ELSE ['a', 'b'] END AS i, [CAST(o_orderkey % 3 AS STRING)] AS c, [CAST(o_orderkey % 6 AS STRING)] AS k FROM orders), al AS (SELECT c_custkey AS question, alt, " + _PT.format(x="(c_custkey + alt)") + " AS pt, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS reason, CASE WHEN (c_custkey + alt) % 2 = 0 THEN ['a'] ELSE ['a', 'b'] END AS i, [CAST((c_custkey + alt) % 3 AS STRING)] AS c, [CAST((c_custkey + alt) % 6 AS STRING)] AS k FROM customer, (VALUES (0), (1)) v(alt))"


@query(f"WITH {_PLANS}, j AS (SELECT ob.question, run, fb, al.alt, al.pt IS NOT NULL AND ob.pt = al.pt AS same, coalesce(NOT fb AND ob.pt = al.pt AND CASE WHEN ob.pt = 'unsupported' THEN ob.reason = al.reason ELSE ob.k = al.k END, FALSE) AS hit, CASE WHEN ob.pt = 'unsupported' THEN 'unsupported_reason' WHEN len(ob.k) <> len(al.k) THEN 'task_count' WHEN ob.i <> al.i THEN 'intent' WHEN ob.c <> al.c THEN 'company' ELSE 'parameter' END AS level FROM ob LEFT JOIN al ON al.question = ob.question), g AS (SELECT question, run, bool_or(fb) AS fb, min(CASE WHEN hit THEN alt END) AS alt, arg_min(level, CASE WHEN same THEN alt END) AS level FROM j GROUP BY 1, 2) SELECT question, run, coalesce(alt = 0, FALSE) AS strict, alt IS NOT NULL AS lenient, CASE WHEN alt IS NOT NULL THEN NULL WHEN fb THEN 'planner_fallback' ELSE coalesce(level, 'plan_type') END AS miss FROM g")
def a10_a11_scored_plans(s, d):
    pt = lambda x: F.when(x % 5 == 0, "unsupported").when(x % 5 == 1, "hybrid").otherwise("single")
    kinds = lambda x: (F.when(x % 2 == 0, X.literals(("a",))).otherwise(X.literals(("a", "b"))).alias("intents"), F.array((x % 3).cast("string")).alias("companies"), F.array((x % 6).cast("string")).alias("keys"))
    k = F.col("o_orderkey")
    ob = table(s, d, "orders").select(F.col("o_custkey").alias("question"), k.alias("run"), pt(k).alias("plan_type"), F.col("o_orderstatus").alias("reason"), (k % 17 == 0).alias("fallback"), *kinds(k))
    x = F.col("c_custkey") + F.col("alt_no")
    al = table(s, d, "customer").withColumn("alt_no", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("c_custkey").alias("question"), "alt_no", pt(x).alias("plan_type"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("reason"), *kinds(x))
    return ev.scored_alternatives(ob, al)


@query("WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) SELECT o_custkey, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM a JOIN b USING (o_custkey, o_orderstatus) GROUP BY 1")
def a12_common_keys(s, d):
    o = table(s, d, "orders")
    return ev.common_keys(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderstatus")


_RANKED = "rk AS (SELECT source AS qid, doc_id AS key, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents), rel AS (SELECT d.source AS qid, d.doc_id AS key FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1), jud AS (SELECT d.source AS qid, d.doc_id AS key FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _ranking(s, d):
    from pyspark.sql import Window

    t = table(s, d, "documents")
    rk = t.select(F.col("source").alias("qid"), F.col("doc_id").alias("key"), F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    lab = t.join(table(s, d, "labels"), "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("key"), "toxic")
    return rk, lab.where("toxic = 1").select("qid", "key"), lab.select("qid", "key")


@query(f"WITH {_RANKED}, j AS (SELECT rk.qid, rank, rel.key IS NOT NULL AS r, jud.key IS NOT NULL AS w FROM rk LEFT JOIN rel ON rel.qid = rk.qid AND rel.key = rk.key LEFT JOIN jud ON jud.qid = rk.qid AND jud.key = rk.key), g AS (SELECT qid, count(*) FILTER (rank <= 10 AND r) AS found, count(*) FILTER (rank <= 10) AS shown, min(rank) FILTER (r) AS first_rank, count(*) FILTER (rank <= 10 AND NOT w) AS unjudged FROM j GROUP BY 1), t AS (SELECT qid, count(*) AS total FROM rel GROUP BY 1) SELECT g.qid, coalesce(total, 0) AS relevant_total, first_rank, CASE WHEN total > 0 THEN found > 0 END AS hit, CASE WHEN total > 0 THEN round(CAST(found AS DOUBLE) / least(10, total), 9) END AS recall, round(CAST(found AS DOUBLE) / shown, 9) AS precision, unjudged FROM g LEFT JOIN t USING (qid)")
def a13_ranking_metrics(s, d):
    m = ev.ranking_metrics(*_ranking(s, d), 10)
    return m.withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


@query(f"WITH {_RANKED} SELECT qid, key, rank FROM rk WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM jud WHERE jud.qid = rk.qid AND jud.key = rk.key)")
def a14_unjudged(s, d):
    rk, _, jud = _ranking(s, d)
    return ev.unjudged_in_top(rk, jud, 10)


@query("WITH q AS (SELECT event_type, user_id, avg(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) AS m FROM events GROUP BY 1, 2) SELECT event_type, round(avg(m), 6) AS mean, count(m) AS n_measured FROM q GROUP BY 1")
def a15_a16_two_level_mean(s, d):
    e = table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return ev.two_level_mean(e, "event_type", "user_id", "v").withColumn("mean", F.round("mean", 6))


@query("SELECT CASE WHEN abs(b - a) < 1e-9 THEN 'same' WHEN b > a THEN 'better' ELSE 'worse' END AS verdict, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS a, l_tax AS b FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def a17_paired(s, d):
    r = table(s, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"))
    return ev.paired(r, "a", "b")


@query("SELECT user_id, CASE WHEN count(v) > 0 THEN count(*) FILTER (v) > count(v) - count(*) FILTER (v) END AS majority, count(DISTINCT v) > 1 AS flipped FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value > 60 END AS v FROM events) GROUP BY 1")
def a18_a19_majority(s, d):
    e = table(s, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value") > 60))
    return ev.majority(e, "user_id", "v")


@query("WITH r AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), p AS (SELECT avg(CAST(a = b AS DOUBLE)) AS o, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM r) SELECT round((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM p")
def a20_kappa(s, d):
    return table(s, d, "labels").agg(F.round(stats.kappa(F.col("quality") == 1, F.col("toxic") == 1), 9).alias("kappa"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a21_confusion(s, d):
    return ev.agreement(table(s, d, "labels"), "quality", "toxic")


@query("SELECT o_orderpriority AS seed_type, count(*) AS n, count(*) FILTER (o_totalprice > 2000 OR o_orderpriority = '5-LOW') AS caught, bool_and(o_totalprice > 2000 OR o_orderpriority = '5-LOW') AS passed FROM orders GROUP BY 1")
def a22_seed_catch(s, d):
    r = table(s, d, "orders").selectExpr("o_orderpriority AS seed_type", "o_totalprice > 2000 OR o_orderpriority = '5-LOW' AS caught")
    return ev.seed_catch(r)


@query("WITH g AS (SELECT l_returnflag, l_linestatus, CAST(count(*) FILTER (v) AS DOUBLE) AS yes, CAST(count(v) AS DOUBLE) AS n FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity > 10 END AS v FROM lineitem) GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, CAST(yes AS BIGINT) AS yes, CAST(n AS BIGINT) AS n, round(yes / n, 9) AS rate, " + _WILSON.format(s="yes", n="n", low="low", high="high") + " FROM g")
def a23_support_rate(s, d):
    r = table(s, d, "lineitem").withColumn("supported", F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 10))
    out = ev.support_rate(r, "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", "l_linestatus", "yes", "n", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'year_not_held' WHEN event_id % 2 = 0 THEN CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type <> 'view' THEN 'sql_refused' WHEN value > 50 THEN 'answered_flagged' ELSE 'answered' END ELSE CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'uncited' WHEN value > 70 THEN 'fallback_answered' ELSE 'answered' END END AS outcome FROM events")
def a24_outcome_class(s, d):
    e = table(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 11 = 0 THEN 'year_not_held' END AS resolution_failure", "CASE WHEN event_id % 2 = 0 THEN 'sql' ELSE 'rag' END AS tool", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'success' ELSE 'refused' END AS status", "value > 50 AS disputed", "event_type <> 'error' AS has_result", "CASE WHEN value < 5 THEN 'uncited' END AS refusal", "value > 70 AS fallback_used")
    return e.select("event_id", ev.outcome_class().alias("outcome"))


@query("SELECT c_custkey AS question, c_acctbal > 0 AND coalesce(a, TRUE) AS correct FROM customer LEFT JOIN (SELECT o_custkey, bool_and(o_totalprice > 10000) AS a FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def a25_question_correct(s, d):
    q = table(s, d, "customer").select(F.col("c_custkey").alias("question"), (F.col("c_acctbal") > 0).alias("routed"))
    t = table(s, d, "orders").select(F.col("o_custkey").alias("question"), (F.col("o_totalprice") > 10000).alias("correct"))
    return ev.question_correct(q, t).select("question", "correct")


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY p) AS accepted FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
def a26_ordered_distinct(s, d):
    return ev.ordered_distinct(table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", F.array_join("values", ",").alias("accepted"))


@query("WITH t AS (SELECT user_id AS run, event_type AS intent, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS q, event_id FROM events), a(intent, place) AS (VALUES ('purchase', 0), ('signup', 1)), b AS (SELECT run, t.intent, q, row_number() OVER (PARTITION BY run ORDER BY place, event_id) AS n FROM t JOIN a USING (intent) WHERE q <> '') SELECT r.run, b.intent, b.q AS question_text FROM (SELECT DISTINCT user_id AS run FROM events) r LEFT JOIN b ON b.run = r.run AND n = 1")
def a27_planner_pick(s, d):
    e = table(s, d, "events")
    t = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("intent"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("question_text"), F.col("event_id").alias("task_no"))
    accepted = s.createDataFrame([("purchase", 0), ("signup", 1)], "intent string, place int")
    return ev.planner_pick(e.select(F.col("user_id").alias("run")).distinct(), t, accepted)


@query("SELECT l_shipmonth, count(*) FILTER (f) AS n_true, count(*) FILTER (NOT f) AS n_false, count(*) FILTER (f IS NULL) AS n_none FROM (SELECT CAST(month(l_shipdate) AS INT) AS l_shipmonth, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag = 'A' END AS f FROM lineitem) GROUP BY 1")
def a29_tally(s, d):
    r = table(s, d, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), F.when(F.col("l_linenumber") != 5, F.col("l_returnflag") == "A").alias("f"))
    return ev.tally(r, "l_shipmonth", "f")


@query("SELECT concat_ws('|', CAST(conv_id AS STRING), 't1', concat('c', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS STRING))) AS item, role AS company, text AS claim, 'claim' AS kind FROM conversations WHERE role = 'user' UNION ALL SELECT concat_ws('|', CAST(conv_id AS STRING), 't1', concat('A', CAST(turn AS STRING))), concat('A', CAST(turn AS STRING)), text, 'finding' FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0")
def e5_claims(s, d):
    c = table(s, d, "conversations")
    item = lambda cond, st: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), st)
    src = F.array(F.lit("k"))
    body = c.groupBy("conv_id").agg(
        item(F.col("role") == "user", lambda x: F.struct(x["text"].alias("text"), src.alias("sources"))).alias("claims"),
        item(F.col("role") == "assistant", lambda x: F.struct(F.concat(F.lit("A"), x["turn"].cast("string")).alias("ticker"), F.when(x["turn"] % 3 != 0, F.struct(x["text"].alias("text"), src.alias("sources"))).alias("claim"))).alias("findings"),
    )
    records_ = body.select(F.col("conv_id").cast("string").alias("id"), F.array(F.struct(F.lit("t1").alias("task_id"), F.lit("user").alias("company"), "claims", "findings")).alias("tasks"))
    return ev.claims(records_).select("item", "company", "claim", "kind")


# time windows and limits

@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_offered FROM events")
def w1_offered_load(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("client"), F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return limits.offered(e, 3600).select("event_id", "n_offered")


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), r AS (SELECT event_id, user_id, nth, 0 AS wait, NULL::DOUBLE AS older, asked AS newer FROM e WHERE nth = 1 UNION ALL SELECT e.event_id, e.user_id, e.nth, CASE WHEN older IS NULL OR asked - older >= 3600 THEN 0 ELSE greatest(1, CAST(ceil(3600 - (asked - older)) AS INT)) END, CASE WHEN older IS NULL OR asked - older >= 3600 THEN newer ELSE older END, CASE WHEN older IS NULL OR asked - older >= 3600 THEN asked ELSE newer END FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1) SELECT event_id, wait = 0 AS admitted, CAST(wait AS INT) AS retry_after FROM r")
def w1_admitted(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.admitted(e, 2, 3600.0).select(F.col("request_id").alias("event_id"), "admitted", "retry_after")


@query("SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100 AS admitted FROM events")
def w2_daily_budget(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    return limits.within_budget(e, 100).select(F.col("request_id").alias("event_id"), "admitted")


# guards and plans

_NEAR = "len(list_filter([total_revenue, net_income], lambda t: len(list_filter({v}, lambda v: abs(v - t) <= t * 0.005::DOUBLE)) > 0)) > 0"
_ANY_SCALE = "[{n}, {n} * 1e3::DOUBLE, {n} * 1e6::DOUBLE, {n} * 1e9::DOUBLE]"


@query(
    "WITH " + CTE_LATEST + ", r AS (SELECT id, total_revenue, net_income, format('{:,.1f}', total_revenue / 1e9) AS sales, format('{:,}', CAST(round(net_income / 1e6) AS BIGINT)) AS costs FROM latest WHERE total_revenue IS NOT NULL), "
    "h AS (SELECT *, " + _NEAR.format(v="[CAST(replace(sales, ',', '') AS DOUBLE) * 1e9::DOUBLE]") + " AS a, " + _NEAR.format(v=_ANY_SCALE.format(n="154000::DOUBLE")) + " AS b, contains(costs, ',') AND " + _NEAR.format(v=_ANY_SCALE.format(n="CAST(replace(costs, ',', '') AS DOUBLE)")) + " AS c FROM r) "
    "SELECT id, CASE WHEN net_income IS NOT NULL THEN concat('Sales were ', CASE WHEN a THEN '[figure withheld]' ELSE concat('$', sales, ' billion') END, ', of ', CASE WHEN b THEN '[figure withheld]' ELSE '154,000' END, ' staff in 2021; costs ', CASE WHEN c THEN '[figure withheld]' ELSE costs END, '.') END AS text, "
    "CASE WHEN net_income IS NULL THEN 0 ELSE CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) END AS withheld FROM h"
)
def q7_withheld_figures(s, d):
    r = reads.latest_success(records(s, d)).where("total_revenue IS NOT NULL")
    text = F.concat(F.lit("Sales were $"), F.format_number(F.col("total_revenue") / 1e9, 1), F.lit(" billion, of 154,000 staff in 2021; costs "), F.format_number(F.col("net_income") / 1e6, 0), F.lit("."))
    return r.select("id", guards.withheld(text, F.array("total_revenue", "net_income")).alias("w")).select("id", "w.text", "w.withheld")


@query()
def p_question_answers(s, d):
    """Plain questions through plan, rewrite, binding, dispatch and rendering: a row for each line of an answer, as some name every company left out."""
    c = executor.Catalog(docs(s, d), records(s, d))
    asked = ["What was T7's net income?", "Which companies had the highest total revenue?", "Which companies had total assets above $200 billion?", "What was the average revenue?", "Why did T9's margins fall and what was T9's total assets?"]
    rows = []
    for i, q in enumerate(asked):
        plan = planner.RulePlanner().plan(q)
        lines, statuses = executor.lines(s, plan, executor.execute(plan, c, as_lines=True))
        said = {"n": i, "question": q, "plan_type": plan.plan_type.value, "statuses": ",".join(x.value for x in statuses)}
        rows.append(lines.select(*(F.lit(v).alias(k) for k, v in said.items()), "block", "ticker", "document_id", F.col("line").alias("answer")))
    return reduce(DataFrame.unionByName, rows)


@query("SELECT doc_id AS mention_id, upper(source) AS ticker, CAST(NULL AS STRING) AS failure FROM documents")
def p_resolved_mentions(s, d):
    """Every document's source as a mention, in small letters, of a company that has it as its ticker."""
    t = table(s, d, "documents")
    index = t.select(F.upper("source").alias("ticker"), F.col("source").alias("company_name")).distinct()
    return resolve.resolve_company(t.select(F.col("doc_id").alias("mention_id"), F.lower("source").alias("mention")), index).select("mention_id", "ticker", "failure")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN b.text IS NOT NULL AND contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) END AS found FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40")
def e4_span_found(s, d):
    """Whether a benchmark passage stands in a document's whole text, which a judge names as support for two claims in three."""
    t, b = table(s, d, "documents"), table(s, d, "benchmark").select("item_id", F.col("text").alias("span"))
    both = t.join(b, F.col("item_id") == F.col("doc_id") % 40, "left")
    return both.select("doc_id", ev.span_found(F.when(F.col("doc_id") % 3 != 0, "supported").otherwise("not_supported"), F.col("span"), F.col("text")).alias("found"))


@query("WITH c AS (SELECT o_orderkey AS item, unnest([o_custkey, o_custkey + 1400]) AS k, unnest([0, 1]) AS pos FROM orders) SELECT item, coalesce(string_agg(c_name, ',' ORDER BY pos) FILTER (c_name IS NOT NULL), '') AS texts, count(*) FILTER (c_name IS NULL) AS missing FROM c LEFT JOIN customer ON c_custkey = k GROUP BY 1")
def j14_judged_sources(s, d):
    c = table(s, d, "orders").select(F.col("o_orderkey").alias("item"), F.array(F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1400).cast("string")).alias("sources"))
    k = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("text"))
    return ev.judged_sources(c, k).select("item", F.array_join("texts", ",").alias("texts"), "missing")


@query("SELECT o_orderkey AS fiscal_year, f AS field, CASE WHEN t IS NULL THEN 'n_a' WHEN v IS NULL THEN 'missing' WHEN abs(v - t) <= 1e-5 * abs(t) THEN 'correct' ELSE 'wrong' END AS outcome FROM (SELECT o_orderkey, f, CASE f WHEN 'net_income' THEN o_custkey ELSE o_custkey * 2 END AS v, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN f = 'net_income' THEN c_custkey ELSE c_custkey * 3 END AS t FROM orders LEFT JOIN customer ON c_custkey = o_custkey, (VALUES ('net_income'), ('total_assets')) x(f))")
def j5_against_key(s, d):
    r = table(s, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS cik", "o_orderkey AS fiscal_year", "CAST(o_custkey AS DOUBLE) AS net_income", "CAST(o_custkey * 2 AS DOUBLE) AS total_assets")
    t = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS cik", "CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS DOUBLE) AS net_income", "CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 3 END AS DOUBLE) AS total_assets")
    key = r.select("cik", "fiscal_year").join(t, "cik")
    return ev.against_key(r, key, ("net_income", "total_assets")).select("fiscal_year", "field", "outcome")


@query("SELECT doc_id, substr(sha256(concat_ws('|', lang, source)), 1, 12) AS version FROM documents")
def a28_c8_versions(s, d):
    return table(s, d, "documents").select("doc_id", X.short_hash("|", 12, F.col("lang"), F.col("source")).alias("version"))

"""Lookups, rankings, filters and their disclosures on a small store of four companies."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import figures, quality, reads, resolve
from tessera.plans import executor, planner, render
from tessera.plans.tasks import QueryPlan, Task
from tessera.schemas import DOCUMENTS, METRICS, RECORDS, Comparison, Direction, Intent, Metric, PlanType, Status, Unsupported
from tessera.sources import corpus

T = [dt.datetime(2026, 8, 1), dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 15)]
COMPANIES = [(1, "Apple Inc.", "AAPL", 2021), (2, "JPMORGAN CHASE & CO", "JPM", 2023), (3, "GOLDMAN SACHS GROUP INC", "GS", 2021), (4, "BANK OF AMERICA CORP /DE/", "BAC", 2022), (5, "INTEL CORP", "INTC", 2023)]
ATTEMPTS = [
    (1, 1, T[0], "success", (1, 1, 1, 1, 1), "MMMMM"), (2, 1, T[1], "success", (365817, 94680, 351002, 287912, 104038), "MMMMM"), (3, 1, T[2], "failed", (None,) * 5, "MMMMM"),
    (4, 2, T[1], "success", (128695, 37676, 3875393, 3548620, 12974), "MMMMM"), (5, 3, T[1], "success", (59339, 21635, 1463988, 1353998, 921), "MMMMK"),
    (6, 4, T[1], "success", (94950, 27528, 3051375, 2779999, None), "MMKKK"), (7, 5, T[1], "failed", (None,) * 5, "MMMMM"),
]
UNIT = {"M": 1e6, "K": 1e3}


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(i, n, t, str(i).zfill(10), y, None, None, None, None, True, None) for i, n, t, y in COMPANIES], DOCUMENTS)
    rows = []
    for i, doc, at, status, printed, units in ATTEMPTS:
        r = dict.fromkeys(RECORDS.names) | {"id": i, "document_id": doc, "extraction_status": status, "extracted_at": at, "fiscal_year_end": "2021-09-25" if doc == 1 else None}
        for m, p, u in zip(METRICS, printed, units, strict=True):
            if p is not None:
                r |= {m: p * UNIT[u], f"{m}_source_line": f"{m} {p:,}"}
        rows.append(tuple(r[c] for c in RECORDS.names))
    return docs, spark.createDataFrame(rows, RECORDS)


def tickers(df):
    return [r.ticker for r in df.collect()]


def run(store, metric, **kw):
    return figures.run(*store, Metric(metric), **kw)


def test_filter_above_a_trillion(store):
    r = run(store, "total_assets", comparison=Comparison.GT, threshold=1e12)
    assert tickers(r.rows) == ["JPM", "GS"] and tickers(r.flagged) == ["BAC"]
    assert r.flagged.first().reason == "scale_ambiguous" and figures.mixed_years(r.rows).first()[0]


def test_filter_nobody_could_pass(store):
    r = run(store, "total_assets", comparison=Comparison.GT, threshold=5e12)
    assert tickers(r.rows) == [] == tickers(r.flagged)


def test_highest_and_lowest_cash_flow(store):
    r = run(store, "operating_cash_flow", direction=Direction.HIGHEST, limit=1)
    assert tickers(r.rows) == ["AAPL"] and tickers(r.excluded) == ["BAC", "INTC"] and tickers(r.flagged) == []
    low = run(store, "operating_cash_flow", direction=Direction.LOWEST, limit=1).rows.first()
    assert (low.ticker, low.reason, low.suspected_value) == ("GS", "scale_disagreement", 921e6)


def test_ranking_serves_latest_success_only(store):
    r = run(store, "total_revenue", direction=Direction.HIGHEST, limit=20)
    assert tickers(r.rows) == ["AAPL", "JPM", "BAC", "GS"] and r.rows.first().value == 365817e6


def test_limits_and_names(store):
    assert [figures.limit_of(x) for x in (None, 3, 500)] == [1, 3, 20]
    rows = figures.metric_rows(reads.current(*store), Metric.NET_INCOME)
    assert {r.company_name for r in rows.collect()} == {"Apple Inc.", "JPMorgan Chase & Co.", "The Goldman Sachs Group, Inc.", "Bank of America Corp."}


def test_unextracted_index_and_flags(store):
    docs, records = store
    assert tickers(reads.without_success(docs, records)) == ["INTC"]
    assert {r.ticker: r.fiscal_year_end for r in reads.corpus_index(docs, records).collect()}["INTC"] is None
    assert {r.ticker for r in reads.with_derived_flag(docs, records).where("is_extracted").collect()} == {"AAPL", "JPM", "GS", "BAC"}
    assert reads.duplicate_keys(docs, ["cik", "filing_year"]).count() == 0


def test_empty_store(store):
    docs, records = (x.limit(0) for x in store)
    r = figures.run(docs, records, Metric.NET_INCOME, direction=Direction.HIGHEST, limit=3)
    assert r.rows.count() == r.excluded.count() == r.flagged.count() == 0


def test_document_scale_is_a_unique_plurality(spark):
    cases = [([1e6, 1e6, 1e3], (1e6, False)), ([1e6, 1e6, 1e3, 1e3], (None, True)), ([1e6, None, None, 1e6, None], (None, False)), ([1e6, 1e6, 1e3, 1.0, 1e9], (1e6, False)), ([], (None, False))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, m array<double>")
    got = {r.i: tuple(r.s) for r in df.select("i", quality.document_scale(F.col("m")).alias("s")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_guard_values(store):
    got = {(r.ticker, r.target) for r in quality.guard_values(quality.assessed(reads.current(*store))).collect()}
    assert ("GS", 921e3) in got and ("GS", 921e6) in got and ("GS", 921.0) in got and ("JPM", 37676e6) in got and ("JPM", 37676e9) not in got


def test_export_has_its_columns_and_a_mark(store, tmp_path):
    rows = corpus.export_rows(reads.current(*store))
    assert len(rows.columns) == 35 and tickers(rows) == ["AAPL", "BAC", "GS", "JPM"]
    corpus.write_csv(rows, f"{tmp_path}/x.csv")
    raw = (tmp_path / "x.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfticker,company_name") and raw.count(b"\n") == 5


# plans

def answer(store, plan):
    return executor.assemble(plan, executor.execute(plan, executor.Catalog(*store)))


def single(**kw):
    return QueryPlan(PlanType.SINGLE, (Task("t1", **kw),))


def test_lookup_answer(store):
    text, statuses = answer(store, single(intent=Intent.FINANCIAL_METRIC, company_mention="apple", metric=Metric.NET_INCOME))
    assert text == "Apple Inc.'s net income for fiscal year 2021 (period ending 2021-09-25) was $94.68 billion." and statuses == [Status.SUCCESS]


def test_filter_answer_discloses(store):
    text, _ = answer(store, single(intent=Intent.FINANCIAL_FILTER, metric=Metric.TOTAL_ASSETS, comparison=Comparison.GT, threshold_text="$1 trillion"))
    assert text.startswith("2 companies had total assets above $1 trillion:\n  JPMorgan Chase & Co. (JPM), FY2023: $3.88 trillion")
    assert "Not included: Bank of America Corp. (BAC) — its total assets are flagged" in text and "(INTC) — its total assets were not extracted" in text and "(2021–2023)" in text


def test_ranking_with_a_name_is_a_lookup(store):
    t = Task("t1", Intent.FINANCIAL_RANKING, company_mention="JPM", metric=Metric.TOTAL_REVENUE, direction=Direction.HIGHEST)
    assert t.rewritten().intent is Intent.FINANCIAL_METRIC and not t.rewritten().corpus_wide
    assert answer(store, QueryPlan(PlanType.SINGLE, (t,)))[0].startswith("JPMorgan Chase & Co.'s total revenue for fiscal year 2023 was $128.69 billion")


def test_lines_of_an_answer_are_its_text(store):
    """Companies left out are rows of a table, not collected to be joined into one text."""
    ranked = Task("t1", Intent.FINANCIAL_RANKING, metric=Metric.TOTAL_REVENUE, direction=Direction.HIGHEST)
    passing = Task("t2", Intent.FINANCIAL_FILTER, metric=Metric.TOTAL_ASSETS, comparison=Comparison.GT, threshold_text="$1 trillion")
    lookup = Task("t3", Intent.FINANCIAL_METRIC, company_mention="apple", metric=Metric.NET_INCOME, question="?")
    plan = QueryPlan(PlanType.HYBRID, (ranked, passing, lookup))
    catalog = executor.Catalog(*store)
    want, statuses = executor.assemble(plan, executor.execute(plan, catalog))
    outcomes = executor.execute(plan, catalog, as_lines=True)
    assert [any(not isinstance(b, str) for b in o.blocks) for o in outcomes] == [True, True, False]
    lines, same = executor.lines(store[0].sparkSession, plan, outcomes)
    got = [r.line for r in lines.orderBy("block", "ticker", "document_id").collect()]
    assert "\n".join(got) == want and same == statuses and sum(x.startswith("Not included: ") for x in got) > 2


def test_a_filter_names_every_company_that_passes(spark):
    """Fifty pass, of which five are doubtful; all are listed and counted, the highest first and ties by document, as rows of a table."""
    docs, rows = [], []
    for i in range(60):
        docs.append((i, f"Company {i}", f"T{99 - i}", str(i).zfill(10), 2021 + i % 2, None, None, None, None, True, None))
        assets = (i // 3 * 10 + 1000 if i < 50 else 5) * 1e6 + 250
        r = dict.fromkeys(RECORDS.names) | {"id": i, "document_id": i, "extraction_status": "success", "extracted_at": T[0]}
        r |= {"total_assets": assets, "total_assets_source_line": "none" if i % 10 == 0 else f"total assets {assets:,.0f}"}
        for m in METRICS:
            if m != "total_assets":
                r |= {m: 7e6, f"{m}_source_line": f"{m} 7,000,000"}
        rows.append(tuple(r[c] for c in RECORDS.names))
    catalog = executor.Catalog(spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(rows, RECORDS))
    order = sorted(range(50), key=lambda i: (-(i // 3), i))
    found = figures.run(catalog.docs, catalog.records, Metric.TOTAL_ASSETS, comparison=Comparison.GT, threshold=5e8)
    assert [r.document_id for r in found.rows.collect()] == order and found.flagged.count() == 0
    assert figures.run(catalog.docs, catalog.records, Metric.TOTAL_ASSETS, limit=figures.CAP, comparison=Comparison.GT, threshold=5e8).rows.count() == 20
    plan = single(intent=Intent.FINANCIAL_FILTER, metric=Metric.TOTAL_ASSETS, comparison=Comparison.GT, threshold_text="$500 million")
    said = [f"  Company {i} (T{99 - i}), FY{2021 + i % 2}: {render.money((i // 3 * 10 + 1000) * 1e6 + 250)}" for i in order]
    doubts = [f"T{99 - i} — {quality.NOTES['evidence_mismatch']}" for i in order if i % 10 == 0]
    text, _ = executor.assemble(plan, executor.execute(plan, catalog))
    want = text.split("\n")
    assert want[0] == "50 companies had total assets above $500 million:" and want[1:51] == said and want[51:56] == doubts and len(want) == 58 and "(2021–2022)" in want[-1]
    lines, _ = executor.lines(spark, plan, executor.execute(plan, catalog, as_lines=True))
    assert [r.line for r in lines.orderBy("block", "ticker", "document_id").collect()] == want
    assert {r.document_id for r in lines.where("line LIKE '  Company%'").collect()} == {str(i) for i in range(50)}


def test_the_index_of_companies_is_not_broadcast(spark):
    """Only the table of aliases goes by way of the driver, however small the files of the index are."""
    index = spark.range(50).selectExpr("concat('T', id) AS ticker", "concat('Company ', id, ' works') AS company_name")
    found = resolve.resolve_company(spark.createDataFrame([(0, "T7"), (1, "company 9")], "mention_id int, mention string"), index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 5 and plan.count("BroadcastExchange") <= plan.count("LocalTableScan") + plan.count("ExistingRDD")
    assert {(r.mention_id, r.ticker) for r in found.collect()} == {(0, "T7"), (1, "T9")}


@pytest.mark.parametrize(
    ("kw", "said"),
    [
        ({"company_mention": "Tesla"}, "I don't hold a filing for Tesla."), ({"company_mention": "apple", "year": 2019}, "I don't have 2019."), ({"company_mention": " "}, "the question didn't name one."),
        ({"company_mention": "intel"}, "its financial figures have not been extracted"), ({"company_mention": "the bank"}, "isn't specific enough"),
    ],
)
def test_refusals(store, kw, said):
    text, statuses = answer(store, single(intent=Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME, **kw))
    assert said in text and statuses == [Status.REFUSED]


def test_unreadable_threshold_is_refused(store):
    plan = single(intent=Intent.FINANCIAL_FILTER, metric=Metric.NET_INCOME, comparison=Comparison.GT, threshold_text="fifty billion")
    (o,) = executor.execute(plan, executor.Catalog(*store))
    assert executor.refusal_reason(o) == "threshold_unparsed" and not executor.nothing_answered([o.status])


def test_narrative_with_fallback_masking_and_citations(spark, store):
    docs, records = store
    chunk = lambda t, sec, i, text, v: (t, sec, 2021, i, text, v)
    chunks = spark.createDataFrame([chunk("AAPL", "Item 1A", 0, "Rates may rise; sales of $365.8 billion.", [1.0, 0.0]), chunk("AAPL", "Item 1A", 1, "Currency may move.", [0.9, 0.1]), chunk("JPM", "Item 7", 0, "We manage rates.", [0.0, 1.0])], "source_ticker string, source_section string, source_year int, chunk_index int, text string, embedding array<double>")
    seen = []

    def generate(question, blocks):
        seen.append(blocks)
        return "answered", [("Rates may rise (passage 1) , with $365.8 billion of sales.", [1, 1, 9]), ("No source.", [7])]

    c = executor.Catalog(docs, records, chunks, lambda q: [1.0, 0.0], generate)
    plan = single(intent=Intent.MARKET_RISK, company_mention="Apple", question="What are Apple's market risks?")
    text, statuses = executor.assemble(plan, executor.execute(plan, c))
    assert seen[0][0] == "[1] Rates may rise; sales of [figure withheld]." and statuses == [Status.SUCCESS]
    assert "so this answer draws on its Risk Factors (Item 1A) section instead. Risk factors describe" in text
    assert "Rates may rise, with [figure withheld] of sales. [1]" in text and "No source" not in text and render.WITHHELD_NOTE in text and "[1] AAPL, FY2021, Risk Factors (Item 1A), chunk 0" in text
    survey = single(intent=Intent.MARKET_RISK, question="Which companies flag rate risk?")
    text, _ = executor.assemble(survey, executor.execute(survey, c))
    assert "[1] Rates may rise; sales of [figure withheld]." in [blocks[0] for blocks in seen[1:]] and not any("365.8" in b for blocks in seen for b in blocks)
    assert "- Apple Inc. (AAPL): Rates may rise, with [figure withheld] of sales. [1]" in text and render.WITHHELD_NOTE in text and "Section not captured in this corpus: BAC, GS, INTC" in text and "was searched instead: AAPL" in text


def test_survey_counts_caps_and_downgrades(spark, store, monkeypatch):
    """Verdicts run a bounded number at a time; a fault is a finding, an uncited yes is none; what is masked, withheld and invalid is counted."""
    import threading
    import time

    docs, records = store
    rows = [(t, "Item 1A", 2021, 0, f"{t} speaks of risk and $365.8 billion.", [1.0, 0.0]) for t in ("AAPL", "JPM", "BAC", "GS", "INTC")]
    chunks = spark.createDataFrame(rows, "source_ticker string, source_section string, source_year int, chunk_index int, text string, embedding array<double>")
    lock, now, peak = threading.Lock(), [0], [0]

    def generate(question, blocks):
        with lock:
            now[0] += 1
            peak[0] = max(peak[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        if "JPM" in blocks[0]:
            raise RuntimeError("boom")
        return "answered", [("Risk of $365.8 billion [1].", [1, 4] if "AAPL" in blocks[0] else [8])]

    monkeypatch.setattr(executor, "SURVEY_AT_ONCE", 2)
    c = executor.Catalog(docs, records, chunks, lambda q: [1.0, 0.0], generate)
    (o,) = executor.execute(single(intent=Intent.RISK_FACTORS, question="Who names risks?"), c)
    by = {f["ticker"]: f for f in o.findings}
    assert by["AAPL"]["status"] == "supported" and by["AAPL"]["claim"] == "Risk of [figure withheld]." and by["JPM"]["status"] == "failed"
    assert {by[t]["status"] for t in by if t not in ("AAPL", "JPM")} <= {"not_found", "not_searchable"} and peak[0] == 2
    assert (o.masked, o.withheld, o.invalid) == (1, 1, 1 + sum(f["status"] == "not_found" for f in o.findings))
    none = executor.Catalog(docs, records, chunks.limit(0), lambda q: [1.0, 0.0], generate)
    (o,) = executor.execute(single(intent=Intent.RISK_FACTORS, question="Who names risks?"), none)
    assert (o.status, executor.refusal_reason(o)) == (Status.REFUSED, "section_absent")


def test_refusal_reasons():
    figure, words = Task("a", Intent.FINANCIAL_FILTER, metric=Metric.NET_INCOME, comparison=Comparison.GT, threshold_text="x"), Task("a", Intent.STRATEGY, question="?")
    ranked = Task("a", Intent.FINANCIAL_RANKING, metric=Metric.NET_INCOME, direction=Direction.HIGHEST)
    reason = lambda t, f, s=Status.REFUSED: executor.refusal_reason(executor.Outcome(t, s, "", f))
    for known in executor.REASONS:
        assert reason(words, known) == known
    assert (reason(figure, None), reason(ranked, None), reason(words, "failed"), reason(words, "uncited", Status.FAILED)) == ("threshold_unparsed", "sql_not_runnable", None, None)


def test_plan_shapes_are_checked():
    t = Task("a", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME)
    for bad in (lambda: QueryPlan(PlanType.SINGLE), lambda: QueryPlan(PlanType.HYBRID, (t,)), lambda: QueryPlan(PlanType.HYBRID, (t, t)), lambda: QueryPlan(PlanType.UNSUPPORTED), lambda: QueryPlan(PlanType.CLARIFICATION), lambda: Task("a", Intent.STRATEGY), lambda: Task("a", Intent.FINANCIAL_FILTER, metric=Metric.NET_INCOME), lambda: Task("a", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME, year=1980)):
        with pytest.raises(ValueError):
            bad()


def test_rule_planner():
    p = planner.RulePlanner()
    assert p.plan("What was Apple's net income in 2021?").tasks[0].company_mention == "Apple"
    f = p.plan("Which companies had total assets above $1 trillion?").tasks[0]
    assert (f.comparison, f.threshold_text) == (Comparison.GT, "$1 trillion")
    assert p.plan("Which 5 had the lowest revenue?").tasks[0].direction is Direction.LOWEST
    assert p.plan("What was the average revenue?").unsupported_reason is Unsupported.AGGREGATION
    assert p.plan("  ").plan_type is PlanType.CLARIFICATION
    assert p.plan("Why did Intel's margins fall and what was Intel's revenue?").plan_type is PlanType.HYBRID


def test_missing_outcomes_are_reported():
    plan = QueryPlan(PlanType.SINGLE, (Task("a", Intent.STRATEGY, question="Why?"),))
    assert executor.assemble(plan, []) == (f"Why? — {render.MISSING_PART}", [Status.FAILED])
    assert executor.assemble(QueryPlan(PlanType.OUT_OF_SCOPE), [])[0] == render.OUT_OF_SCOPE


def test_labels_become_plans():
    from tessera.plans import labels

    p = labels.plan_of_label("q1", "Why?", "hybrid", [{"intent": "financial_ranking", "metric": "net_income"}, {"intent": "strategy", "company": "AAPL"}], task_questions={"q1": {"t2": "Its strategy?"}})
    assert p.tasks[0].direction is Direction.HIGHEST and p.tasks[1].question == "Its strategy?"
    f = labels.plan_of_label("q2", "Which?", "single", [{"intent": "financial_filter", "metric": "net_income"}], {"q2": ("gt", "$1bn")})
    assert (f.tasks[0].comparison, f.tasks[0].threshold_text) == (Comparison.GT, "$1bn")
    for bad in (lambda: labels.plan_of_label("q", "x", "single", []), lambda: labels.plan_of_label("q", "x", "single", [{"intent": "financial_filter", "metric": "net_income"}]), lambda: labels.require_unchanged("a", "0"), lambda: labels.require_served("m", lambda _: None)):
        with pytest.raises(labels.LabelError):
            bad()
    assert labels.require_unchanged("a\r\nb", hashlib.sha256(b"a\nb").hexdigest()) and labels.require_served("m", lambda m: m) == "m"
    clock = iter([0.0, 5.0, 10.0, 11.0])
    gate = labels.RetryGate(10, lambda: next(clock))
    tries = iter([False, True])
    assert [gate.attempt(lambda: next(tries)) for _ in range(4)] == [False, False, True, True]

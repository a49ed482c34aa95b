"""Rules on small fixtures, each with the rows it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, guards, joins, quality, retrieval, sections
from tessera.plans import executor, planner, render
from tessera.plans.tasks import QueryPlan, Task
from tessera.schemas import Comparison, Direction, Intent, Metric, PlanType, Status
from tessera.sources import chunk_store, corpus, extraction
from tessera.store import new_folder
from tessera.streaming import limits

CASES = {}


def expects(columns: str, *rows: tuple):
    """Registers a case with the rows it must give; types behind a column's name are for the reader."""
    names = [c.split()[0] for c in columns.split(", ")]

    def add(f):
        CASES[f.__name__] = (f, names, rows)
        return f

    return add


_FIGURE = "[figure withheld]"


@expects(
    "i, text, withheld",
    (0, f"Sales of {_FIGURE}", 1), (1, "Sales of 274.5 billion", 0), (2, f"Total net sales${_FIGURE} 33 %$274,515 6 %", 1), (3, "154,000 employees", 0),
    (4, f"Net income ({_FIGURE})", 1), (5, "FY2021 and 27", 0), (6, None, 0), (7, f"{_FIGURE}, {_FIGURE}; 1.94,680 x94,680", 2), (8, f"94680 is plain; {_FIGURE} is not", 1),
)
def q7_q7n_masked(s, d):
    said = ["Sales of $365.8 billion", "Sales of 274.5 billion", "Total net sales$365,817 33 %$274,515 6 %", "154,000 employees", "Net income (94,680)", "FY2021 and 27", None, "94.68 Billions, $ 94,680 million; 1.94,680 x94,680", "94680 is plain; $94680 is not"]
    rows = s.createDataFrame(list(enumerate(said)), "i int, t string")
    return rows.select("i", guards.withheld(F.col("t"), F.array(F.lit(365817e6), F.lit(94680e6))).alias("w")).select("i", "w.text", "w.withheld")


@expects("client, request_id BIGINT, admitted, retry_after", ("a", 1, True, 0), ("a", 2, True, 0), ("a", 3, False, 50), ("a", 4, True, 0), ("a", 5, False, 1), ("a", 6, True, 0), ("b", 7, True, 0), ("b", 8, True, 0), ("b", 9, False, 60))
def w1_admitted_cases(s, d):
    """Two requests a minute: a refusal does not count, the window is half open, clients are apart."""
    at = [("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 10.0), ("a", 4, 60.0), ("a", 5, 64.5), ("a", 6, 65.0), ("b", 7, 1.0), ("b", 8, 1.0), ("b", 9, 1.0)]
    return limits.admitted(s.createDataFrame(at, "client string, request_id long, at double"), 2).select("client", "request_id", "admitted", "retry_after")


@expects("n, admitted, wait, refused_by", (0, True, 0, None), (1, False, 59, "window"), (2, True, 0, None), (3, False, 600, "budget"), (4, True, 0, None))
def w3_limiter_cases(s, d):
    """Window first, then the budget; what the budget refuses leaves the window free; a new day has a new budget."""
    limiter = limits.Limiter(per_window=1, daily_budget=2)
    asked = [("a", 0.0, 1), ("a", 1.0, 1), ("b", 2.0, 1), ("c", 3.0, 1), ("c", 3.0, 2)]
    return s.createDataFrame([(i, *limiter.check(c, at, day, 600.0)) for i, (c, at, day) in enumerate(asked)], "n int, admitted boolean, wait int, refused_by string")


@expects("doc_id BIGINT, chunk_index, text", (1, 0, "one two three four"), (1, 1, "four five six seven"), (1, 2, "eight nine"), (2, 0, "short text of four"))
def c5_recursive_cases(s, d):
    """At most four words, one shared; the coarsest separator that serves comes first, so the blank line ends a piece."""
    docs = s.createDataFrame([(1, "one two three four five six seven\n\neight nine"), (2, "short text of four"), (3, ""), (4, None)], "doc_id long, text string")
    return sections.recursive_chunks(docs, 4, 1, True, 1)


@expects("step, n_rows BIGINT, matches, texts", ("empty", -1, None, ""), ("added", 4, True, "old 0,old 1,old 2,other"), ("replaced", 2, True, "new,other"), ("reset", -1, True, ""))
def io13_io14_io15_store(s, d):
    """A store says under which parameters it was made, replaces the filings that come again, and is emptied."""
    store, out = chunk_store.ChunkStore(s, f"{new_folder(s, 'cases')}/chunks", chunk_store.params_hash(size=500)), []
    schema = "source_cik string, source_year int, source_section string, chunk_index int, text string"

    def step(name: str) -> None:
        n = store.count()
        out.append((name, n, store.matches(), ",".join(sorted(r.text for r in store.read().collect())) if n >= 0 else ""))

    step("empty")
    store.add(s.createDataFrame([("1", 2021, "Item 1", i, f"old {i}") for i in range(3)] + [("2", 2022, "Item 7", 0, "other")], schema))
    step("added")
    store.add(s.createDataFrame([("1", 2021, "Item 1", 0, "new")], schema))
    step("replaced")
    store.reset(s.createDataFrame([(1, True)], "id int, is_embedded boolean"))
    step("reset")
    return s.createDataFrame(out, "step string, n_rows long, matches boolean, texts string")


@expects("i, said", (0, "3 rows"), (1, "a document with {'cik': '1', 'year': 2021} exists"), (2, "a document with {'cik': '3', 'year': 2021} exists"))
def io5_inserted(s, d):
    """A key that is held, or that comes twice, rejects the whole insert."""
    keyed = lambda *keys: s.createDataFrame([(c, 2021) for c in keys], "cik string, year int")
    return s.createDataFrame([(i, _or_error(lambda n=new: f"{corpus.inserted(keyed('1', '2'), keyed(*n), ['cik', 'year']).count()} rows")) for i, new in enumerate((("3",), ("3", "1"), ("3", "3")))], "i int, said string")


def _or_error(f) -> str:
    try:
        return f()
    except corpus.Rejected as e:
        return str(e)


@expects("id BIGINT, is_extracted, attempts BIGINT", (1, True, 2), (2, False, 1), (-1, None, None))
def io6_appended(s, d):
    """The flag follows the attempts, unknown fields are dropped, and an attempt without a document (-1) is rejected."""
    docs = s.createDataFrame([(1, False), (2, True)], "id long, is_extracted boolean")
    kinds = "id long, document_id long, extraction_status string"
    old = s.createDataFrame([(10, 1, "technical_failed"), (11, 2, "extraction_failed")], kinds)
    new = s.createDataFrame([(12, 1, "success", "x")], f"{kinds}, unheard_of string")
    docs, records = corpus.appended_attempts(docs, old, new)
    n = records.drop("unheard_of").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("attempts"))
    rejected = _or_error(lambda: str(corpus.appended_attempts(docs, old, s.createDataFrame([(13, 9, "success")], kinds))))
    assert "unheard_of" not in records.columns
    return docs.join(n, "id").select("id", "is_extracted", "attempts").unionByName(s.createDataFrame([(-1, None, None)] if rejected == "no document with id 9" else [], "id long, is_extracted boolean, attempts long"))


@expects("question, response, invalid", ("b", "half", True), ("c", "good", False))
def io18_write_policy(s, d):
    """Held entries stay, invalid answers are kept, calls that did not complete are not."""
    from tessera.functions.text import cache_key

    results = s.createDataFrame([("a", "success", "new"), ("b", "extraction_failed", "half"), ("c", "success", "good"), ("d", "technical_failed", None)], "question string, extraction_status string, response string")
    cache = results.where("question = 'a'").select(cache_key(F.col("question")).alias("cache_key"), F.lit("old").alias("response"))
    return corpus.cache_entries(results, cache, ["question"]).join(results.select("question", cache_key(F.col("question")).alias("cache_key")), "cache_key").select("question", "response", "invalid")


def _fetch(row: dict) -> str:
    if row["year"] > 2021:
        raise ConnectionError("gone")
    return f"filing {row['cik']}"


@expects("cik, year, status, error, text", ("1", 2021, "kept", None, "filing 1"), ("2", 2022, "failed", "ConnectionError: gone", None), ("3", 2020, "kept", None, "filing 3"))
def io3_fetched(s, d):
    path = f"{new_folder(s, 'cases')}/texts"
    wanted = s.createDataFrame([("1", 2021), ("2", 2022), ("3", 2020)], "cik string, year int")
    kept = corpus.persisted(corpus.fetched(wanted, _fetch), path, ["cik", "year"])
    return kept.join(s.read.schema("text string, cik string, year int").parquet(path), ["cik", "year"], "left")


def _odd(text: str, strategy: extraction.Strategy) -> extraction.Answer:
    if text == "boom":
        raise TimeoutError("no answer")
    if text == "odd":
        return extraction.Answer({"net_income": "many"}, {}, 7, 3, True)
    return extraction.read_figures(text, strategy)


_FILING = "COVER\n(in millions)\nTotal net sales $365,817 274,515\nOf which net income $94,680\nTotal assets 351,002\n"


@expects(
    "strategy, document_id BIGINT, extraction_status, failure_reason, total_revenue, net_income, line, present, input_tokens BIGINT",
    ("S0", 1, "success", None, 365817.0, 94680.0, None, None, 16), ("S1", 1, "success", None, 365817e6, 94680e6, None, None, 16), ("S2", 1, "success", None, 365817.0, None, None, None, 16),
    ("S3", 1, "success", None, 365817e6, None, "Total net sales $365,817 274,515", True, 16), ("S4", 1, "success", None, 365817e6, None, None, None, 16),
    ("S3", 2, "extraction_failed", "no figure found", None, None, None, None, 2), ("S3", 3, "technical_failed", "FileNotFoundError: the document has no text", None, None, None, None, 0),
    ("S3", 4, "technical_failed", "TimeoutError: no answer", None, None, None, None, 0), ("S3", 5, "extraction_failed", "net_income is not a number", None, None, None, None, 7),
)
def e1_attempts(s, d):
    """Every document leaves an attempt; strategies differ in what they look at, and only one cites."""
    docs = s.createDataFrame([(1, _FILING), (2, "nothing here"), (3, None), (4, "boom"), (5, "odd")], "document_id long, text string")
    out: DataFrame | None = None
    for strategy in extraction.STRATEGIES:
        own = extraction.extracted(docs if strategy == "S3" else docs.limit(1), strategy, _odd).withColumn("strategy", F.lit(strategy))
        out = own if out is None else out.unionByName(own)
    return out.select("strategy", "document_id", "extraction_status", "failure_reason", "total_revenue", "net_income", F.col("total_revenue_source_line").alias("line"), F.col("total_revenue_evidence_present").alias("present"), "input_tokens")


@expects("processed BIGINT, success BIGINT, extraction_failed BIGINT, technical_failed BIGINT, cached_hits BIGINT, billed_input_tokens BIGINT, billed_output_tokens BIGINT, replayed_input_tokens BIGINT, replayed_output_tokens BIGINT", (5, 1, 2, 2, 1, 18, 2, 7, 3))
def e1_run_summary(s, d):
    docs = s.createDataFrame([(1, _FILING), (2, "nothing here"), (3, None), (4, "boom"), (5, "odd")], "document_id long, text string")
    return extraction.run_summary(extraction.extracted(docs, "S3", _odd))


def _judge(claim: str, texts: list[str], run: int) -> tuple[str, str]:
    if claim == "flips" and run == 2:
        return "not_supported", ""
    if claim == "breaks" and run == 1:
        raise TimeoutError("slow")
    return "supported", "Rates  MAY rise" if claim != "flips" else "made up"


@expects("item, majority, flipped, failed BIGINT, quoted BIGINT", ("a", True, False, 0, 3), ("b", True, True, 0, 0), ("c", True, False, 1, 2), ("d", None, False, 3, 0))
def e4_judged(s, d):
    """Three calls a claim: failed ones are left out of the majority, and a claim whose source is missing is not judged."""
    rows = s.createDataFrame([("a", "holds", ["k1"]), ("b", "flips", ["k1", "k2"]), ("c", "breaks", ["k1"]), ("d", "holds", ["k1", "k9"])], "item string, claim string, sources array<string>")
    chunks = s.createDataFrame([("k1", "It says rates may rise."), ("k2", "Costs fell.")], "key string, text string")
    judged = evaluation.judgements(evaluation.judged_sources(rows, chunks).join(rows.select("item", "claim"), "item"), _judge, 3)
    return evaluation.settled(judged).join(judged.groupBy("item").agg(F.count_if("span_found").alias("quoted")), "item").select("item", "majority", "flipped", "failed", "quoted")


@expects("answer, claim_id, valid, invalid BIGINT", ("x", 1, "2,1", 1), ("x", 2, "", 1), ("y", 1, "1", 2), ("y", 2, "8", 0))
def j9_answers_apart(s, d):
    """Block numbers are local to an answer."""
    claims = s.createDataFrame([(a, i, c) for a in "xy" for i, c in ((1, [2, 2, 9, 1]), (2, [8]))], "answer string, claim_id int, cites array<int>")
    blocks = s.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 8)], "answer string, rank int")
    return joins.cited(claims, blocks, ("answer",)).select("answer", "claim_id", F.array_join("valid", ",").alias("valid"), "invalid")


@expects("passage_id, text_id", (1, 1), (1, 2), (2, 2), (3, 2), (4, 2))
def q1_short_passages(s, d):
    """Passages of one and two words, and ends that cut words."""
    p = s.createDataFrame([(1, "assets"), (2, "total assets"), (3, "total assets rose in th"), (4, "tal assets rose"), (5, "Total assets"), (6, "assets  rose in")], "passage_id int, passage string")
    t = s.createDataFrame([(1, "subassets"), (2, "the total assets rose in the year"), (3, "nothing"), (4, None)], "text_id int, text string")
    return joins.contained_passages(p, t)


# a small corpus that questions are asked of

def _catalog(s, generate=None) -> executor.Catalog:
    docs = s.createDataFrame([(1, "Apple Inc.", "AAPL", "1", 2021, True), (2, "Intel Corp", "INTC", "2", 2022, True), (3, "Alphabet Inc.", "GOOGL", "3", 2023, True), (4, "Target Corp", "TGT", "4", 2022, False)], "id long, company_name string, ticker string, cik string, filing_year int, is_embedded boolean")
    figures = {"total_revenue": (365817e6, "Total net sales 365,817"), "net_income": (94680e6, "Net income 94,680"), "total_assets": (351002e6, "Total assets 351,002"), "total_liabilities": (287912e6, "Total liabilities 287,912"), "operating_cash_flow": (104038e6, "Cash generated by operating activities 104,038")}
    rows, kinds = [], "id long, document_id long, extraction_status string, extracted_at string, fiscal_year_end string, " + ", ".join(f"{m} double, {m}_source_line string" for m in figures)
    rows.append((1, 1, "success", "2024-01-01", "2021-09-25", *(x for f in figures.values() for x in f)))
    rows.append((2, 2, "success", "2024-01-01", "2022-12-31", *(x for v, line in figures.values() for x in (v / 10, line.replace(",", "")[:-1]))))
    rows.append((3, 3, "success", "2024-01-01", None, *(x for m, (v, line) in figures.items() for x in ((None, None) if m == "net_income" else (v / 1000 if m == "total_revenue" else v, line)))))
    chunks = s.createDataFrame([("AAPL", "Item 1A", 2021, 0, "Rates may rise; sales of $365.8 billion.", [1.0, 0.0]), ("AAPL", "Item 1A", 2021, 1, "Currency may move.", [0.9, 0.1]), ("GOOGL", "Item 7", 2023, 0, "We manage rates.", [0.0, 1.0])], "source_ticker string, source_section string, source_year int, chunk_index int, text string, embedding array<double>")
    return executor.Catalog(docs, s.createDataFrame(rows, kinds), chunks, lambda q: [1.0, 0.0], generate)


def _says(question: str, blocks: list[str]) -> tuple[str, list]:
    """A stand-in for a model: it answers from what it sees, so a figure it saw would be in the answer."""
    if "manage" in blocks[0]:
        return "answered", [("We do (passage 4).", [4])]
    return "answered", [(f"{blocks[0][4:-1]} and $365.8 billion more (passage 1) .", [1, 1, 9]), ("No source.", [7])]


def _said(s, plans: list[QueryPlan], c: executor.Catalog) -> DataFrame:
    out = []
    for i, plan in enumerate(plans):
        outcomes = executor.execute(plan, c)
        text, statuses = executor.assemble(plan, outcomes, lambda t: f"<{t}>")
        out.append((i, text, ",".join(x.value for x in statuses), ",".join(executor.refusal_reason(o) or "-" for o in outcomes), sum(o.masked for o in outcomes), sum(o.withheld for o in outcomes), sum(o.invalid for o in outcomes)))
    return s.createDataFrame(out, "i int, answer string, statuses string, reasons string, masked int, withheld int, invalid int")


def _one(**kw) -> QueryPlan:
    return QueryPlan(PlanType.SINGLE, (Task("t1", **kw),))


_INSTEAD = "The MD&A (Item 7) or Market Risk (Item 7A) section of Apple Inc.'s filing was not captured in this corpus, so this answer draws on its Risk Factors (Item 1A) section instead. Risk factors describe these exposures qualitatively; the quantitative market-risk disclosures are not in this corpus."


@expects(
    "i, answer, statuses, reasons, masked, withheld, invalid",
    (0, f"{_INSTEAD}\nRates may rise; sales of {_FIGURE} and {_FIGURE} more. [1]\n{render.WITHHELD_NOTE}\n\nSources:\n[1] <AAPL>, FY2021, Risk Factors (Item 1A), chunk 0", "success", "-", 1, 1, 2),
    (1, f"Companies whose filings discuss this:\n- Apple Inc. (AAPL): Rates may rise; sales of {_FIGURE} and {_FIGURE} more. [1]\nNo supporting passage found in the retrieved text: GOOGL\nSection not captured in this corpus: INTC\nMD&A (Item 7) or Market Risk (Item 7A) not captured, so Risk Factors (Item 1A) was searched instead: AAPL\n{render.WITHHELD_NOTE}\n\nSources:\n[1] <AAPL>, FY2021, Risk Factors (Item 1A), chunk 0", "success", "-", 1, 1, 2),
    (2, "I don't hold a filing for Tesla.", "refused", "non_corpus_company", 0, 0, 0),
    (3, "Target Corp. has no indexed narrative text", "refused", "company_not_embedded", 0, 0, 0),
    (4, "The Business (Item 1) section of Apple Inc.'s filing was not captured in this corpus, so this part can't be answered from the filing text.", "refused", "section_absent", 0, 0, 0),
)
def n1_n2_s4_narratives(s, d):
    """What a model sees is masked, what it says is cleaned and withheld from, cites are checked against its own blocks; the same for one company and for all."""
    ask = lambda intent, name=None: _one(intent=intent, company_mention=name, question="Which risks?")
    return _said(s, [ask(Intent.MARKET_RISK, "Apple"), ask(Intent.MARKET_RISK), ask(Intent.MARKET_RISK, "Tesla"), ask(Intent.RISK_FACTORS, "Target"), ask(Intent.COMPANY_OVERVIEW, "Apple")], _catalog(s, _says))


@expects(
    "i, answer, statuses, reasons, masked, withheld, invalid",
    (0, "Apple Inc.'s net income for fiscal year 2021 (period ending 2021-09-25) was $94.68 billion.", "success", "-", 0, 0, 0),
    (1, "Alphabet Inc.'s net income for fiscal year 2023 was not extracted from the filing, so I can't give it.", "success", "-", 0, 0, 0),
    (2, "By total revenue, highest first:\n  Apple Inc. (AAPL), FY2021: $365.82 billion\n  Intel Corp (INTC), FY2022: $36.58 billion\nNot included: Alphabet Inc. (GOOGL) — its total revenue is flagged, and at a 1,000x different scale it would be in this list. Flagged: this figure's implied scale disagrees with the rest of the filing. The value is likely 365,817,000,000.\nNot included: Target Corp. (TGT) — its total revenue was not extracted from the filing, so it may be higher than any figure shown.\nThese figures come from different fiscal years (2021–2022), because the corpus holds one annual filing per company. They are not like-for-like comparisons.", "success", "-", 0, 0, 0),
    (3, "1 company had total assets below $100 billion:\n  Intel Corp (INTC), FY2022: $35.1 billion\nNot included: Target Corp. (TGT) — its total assets were not extracted from the filing, so whether it meets this threshold is unknown.", "success", "-", 0, 0, 0),
    (4, "I couldn't read the threshold 'fifty billion'.", "refused", "threshold_unparsed", 0, 0, 0),
    (5, "I hold one Target Corp. filing, for fiscal year 2022, but its financial figures have not been extracted, so I can't answer this from them.", "refused", "company_not_extracted", 0, 0, 0),
    (6, "I hold one Apple Inc. filing, for fiscal year 2021. I don't have 2019.", "refused", "year_not_held", 0, 0, 0),
)
def s1_p6_figures(s, d):
    """Lookups, a ranking and a filter with what they leave out and why, and refusals with their reasons."""
    one = lambda name, **kw: _one(intent=Intent.FINANCIAL_METRIC, company_mention=name, metric=Metric.NET_INCOME, **kw)
    over = lambda text: _one(intent=Intent.FINANCIAL_FILTER, metric=Metric.TOTAL_ASSETS, comparison=Comparison.LT, threshold_text=text)
    ranked = _one(intent=Intent.FINANCIAL_RANKING, metric=Metric.TOTAL_REVENUE, direction=Direction.HIGHEST, limit=2)
    return _said(s, [one("Apple"), one("alphabet"), ranked, over("$100 billion"), over("fifty billion"), one("Target"), one("Apple", year=2019)], _catalog(s))


@expects(
    "question, plan_type, said",
    ("What was Apple's net income in 2021?", "single", "financial_metric:Apple:net_income:2021"), ("Which companies had total assets above $1 trillion?", "single", "financial_filter::total_assets:gt:$1 trillion"),
    ("Which 5 had the lowest revenue?", "single", "financial_ranking::total_revenue:lowest:5"), ("What was the average revenue?", "unsupported", "aggregation"), ("  ", "clarification", ""),
)
def p1_p2_plans(s, d):
    out = []
    for q in ("What was Apple's net income in 2021?", "Which companies had total assets above $1 trillion?", "Which 5 had the lowest revenue?", "What was the average revenue?", "  "):
        p = planner.RulePlanner().plan(q)
        said = p.unsupported_reason.value if p.unsupported_reason else ""
        for t in p.tasks:
            said = ":".join(str(x) for x in (t.intent.value, t.company_mention or "", t.metric.value, *(x for x in (t.comparison and t.comparison.value, t.threshold_text, t.direction and t.direction.value, t.limit, t.year) if x)))
        out.append((q, p.plan_type.value, said))
    return s.createDataFrame(out, "question string, plan_type string, said string")


@expects("i, reason", (0, "uncited"), (1, "threshold_unparsed"), (2, "sql_not_runnable"), (3, None), (4, None), (5, "year_not_held"))
def s5_refusal_reasons(s, d):
    words, over = Task("t", Intent.STRATEGY, question="?"), Task("t", Intent.FINANCIAL_FILTER, metric=Metric.NET_INCOME, comparison=Comparison.GT, threshold_text="x")
    ranked = Task("t", Intent.FINANCIAL_RANKING, metric=Metric.NET_INCOME, direction=Direction.HIGHEST)
    cases = [(words, Status.REFUSED, "uncited"), (over, Status.REFUSED, None), (ranked, Status.REFUSED, None), (words, Status.REFUSED, "failed"), (words, Status.FAILED, "uncited"), (over, Status.REFUSED, "year_not_held")]
    return s.createDataFrame([(i, executor.refusal_reason(executor.Outcome(t, status, "", why))) for i, (t, status, why) in enumerate(cases)], "i int, reason string")


@expects("i, multiplier, consistent, scale, ambiguous", (0, 1e6, True, 1e6, False), (1, 1e3, True, None, True), (2, None, False, None, False), (3, 1.0, True, None, False))
def q2_q3_q4_many_numbers(s, d):
    """Lines with several numbers, decimals and thousands separators: the first number that fits at any scale counts; two scales alike are a tie."""
    cases = [
        (0, [(2.5e6, "In 2021 2.5 of 9"), (365817e6, "sales 33 % 365,817"), (7e6, "up 1, 7.")]),
        (1, [(5e3, "5 and 6"), (6e3, "1 6"), (8e6, "8 or 8,000"), (9e6, "9")]),
        (2, [(5.0, "no figure"), (6.0, "61"), (7.0, None)]), (3, [(12.0, "3 12.0 4"), (3.0, "a 3")]),
    ]
    rows = s.createDataFrame([(i, v, t, n) for i, own in cases for n, (v, t) in enumerate(own)], "i int, v double, t string, n int")
    m = rows.withColumn("m", quality.implied_multiplier(F.col("v"), F.col("t"))).withColumn("c", quality.evidence_consistent(F.col("v"), F.col("t")))
    out = m.groupBy("i").agg(F.min_by("m", "n").alias("multiplier"), F.min_by("c", "n").alias("consistent"), F.collect_list("m").alias("ms")).withColumn("x", quality.document_scale(F.col("ms")))
    return out.select("i", "multiplier", "consistent", F.col("x.scale").alias("scale"), F.col("x.ambiguous").alias("ambiguous"))


@expects("mention, ticker, failure", ("apple", "AAPL", None), ("AAPL", "AAPL", None), ("Google", "GOOGL", None), ("Goldman Sachs", "GS", None), ("bank", None, "ambiguous_company"), ("Tesla", None, "non_corpus_company"), (" ", None, "no_company_mention"), ("northern", None, "ambiguous_company"))
def t3_mentions(s, d):
    """Ticker, alias, one name with all tokens; several names are ambiguous."""
    from tessera.operators import resolve

    names = s.createDataFrame([("AAPL", "Apple Inc."), ("GOOGL", "Alphabet Inc."), ("GS", "Goldman Sachs Group Inc"), ("NOC", "Northern Lights Corp"), ("NTRS", "Northern Trust Corp")], "ticker string, company_name string")
    asked = ["apple", "AAPL", "Google", "Goldman Sachs", "bank", "Tesla", " ", "northern"]
    m = s.createDataFrame(list(enumerate(asked)), "mention_id int, mention string")
    return resolve.resolve_company(m, names).join(m, "mention_id").select("mention", "ticker", "failure")


# plans, labels and gates

def _error(f) -> str:
    try:
        f()
    except Exception as e:  # noqa: BLE001  the message is what is asked for
        return f"{type(e).__name__}: {e}"
    return "accepted"


@expects("name, accepted", ("total_revenue", True), ("operating_cash_flow", True), ("Total_Revenue", False), ("ticker", False), ("net_income; DROP TABLE docs", False))
def r7_allowlist(s, d):
    """Only the five figures are columns a query can be asked for."""
    names = ["total_revenue", "operating_cash_flow", "Total_Revenue", "ticker", "net_income; DROP TABLE docs"]
    return s.createDataFrame([(n, _error(lambda n=n: Metric(n)) == "accepted") for n in names], "name string, accepted boolean")


@expects(
    "i, said",
    (0, "ValueError: a single plan has 1 to 1 tasks, not 0"), (1, "ValueError: a hybrid plan has 2 to 3 tasks, not 1"), (2, "ValueError: task ids must differ"), (3, "ValueError: an unsupported plan names its reason"),
    (4, "ValueError: a clarification plan asks a question"), (5, "ValueError: financial_filter needs comparison"), (6, "ValueError: strategy needs question"), (7, "ValueError: the year must lie in 1990 to 2100"), (8, "ValueError: the limit must lie in 1 to 20"), (9, "accepted"),
)
def q9_plan_rules(s, d):
    t = Task("a", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME)
    tries = [
        lambda: QueryPlan(PlanType.SINGLE), lambda: QueryPlan(PlanType.HYBRID, (t,)), lambda: QueryPlan(PlanType.HYBRID, (t, t)), lambda: QueryPlan(PlanType.UNSUPPORTED), lambda: QueryPlan(PlanType.CLARIFICATION),
        lambda: Task("a", Intent.FINANCIAL_FILTER, metric=Metric.NET_INCOME), lambda: Task("a", Intent.STRATEGY), lambda: Task("a", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME, year=1980),
        lambda: Task("a", Intent.FINANCIAL_RANKING, metric=Metric.NET_INCOME, direction=Direction.HIGHEST, limit=21), lambda: QueryPlan(PlanType.SINGLE, (t,)),
    ]
    return s.createDataFrame([(i, _error(f)) for i, f in enumerate(tries)], "i int, said string")


@expects("intent, named, tool, corpus_wide, becomes", *((i, n, "sql" if i.startswith("financial") else "rag", not n if not i.startswith("financial") else i != "financial_metric", "financial_metric" if n and i.startswith("financial") else i) for i in ("financial_metric", "financial_ranking", "financial_filter", "strategy", "market_risk") for n in (True, False)))
def p3_p4_p5_rewritten(s, d):
    """The tool follows the intent; rankings and filters are corpus-wide, as are narratives that name nobody; one that names a company becomes its lookup."""
    out = []
    for intent in (Intent.FINANCIAL_METRIC, Intent.FINANCIAL_RANKING, Intent.FINANCIAL_FILTER, Intent.STRATEGY, Intent.MARKET_RISK):
        for named in (True, False):
            t = Task("a", intent, company_mention="Apple" if named else " ", metric=Metric.NET_INCOME, comparison=Comparison.GT, threshold_text="$1", direction=Direction.LOWEST, question="?")
            out.append((intent.value, named, t.tool.value, t.corpus_wide, t.rewritten().intent.value))
    return s.createDataFrame(out, "intent string, named boolean, tool string, corpus_wide boolean, becomes string")


@expects(
    "i, answer, statuses",
    (0, "Why did Intel's margins fall? — The Business (Item 1) section of Intel's filing was not captured in this corpus, so this part can't be answered from the filing text.\n\nWhat was Tesla's net income? — I don't hold a filing for Tesla.\n\nApple Inc.'s net income for fiscal year 2021 was $94.68 billion.", "refused,refused,success"),
    (1, f"Why? — {render.MISSING_PART}", "failed"), (2, render.OUT_OF_SCOPE, ""), (3, "Which company?", ""),
    (4, "Growth. [1][2]\n\nMore. [2][3]\n\nSources:\n[1] <AAPL>, FY2021, Business (Item 1), chunk 4\n[2] <AAPL>, FY2021, Risk Factors (Item 1A), chunk 0\n[3] <INTC>, FY2022, Business (Item 1), chunk 4", "success,success"),
)
def s2_s3_p7_assembled(s, d):
    """Plan order whatever came first, a missing outcome is reported, sources are numbered over the whole answer by first citation."""
    why, what, sure = Task("a", Intent.STRATEGY, question="Why did Intel's margins fall?"), Task("b", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME, question="What was Tesla's net income?"), Task("c", Intent.FINANCIAL_METRIC, metric=Metric.NET_INCOME)
    refused = render.narrative_refusal("section_absent", "Intel", ("Item 1",))
    three = [executor.Outcome(sure, Status.SUCCESS, "Apple Inc.'s net income for fiscal year 2021 was $94.68 billion."), executor.Outcome(why, Status.REFUSED, refused, "section_absent"), executor.Outcome(what, Status.REFUSED, "I don't hold a filing for Tesla.", "non_corpus_company")]
    a, b, c = ("AAPL", 2021, "Item 1", 4), ("AAPL", 2021, "Item 1A", 0), ("INTC", 2022, "Item 1", 4)
    lone = QueryPlan(PlanType.SINGLE, (Task("x", Intent.STRATEGY, question="Why?"),))
    two = QueryPlan(PlanType.HYBRID, (Task("x", Intent.STRATEGY, question="Why?"), Task("y", Intent.STRATEGY, question="How?")))
    cited = [executor.Outcome(two.tasks[1], Status.SUCCESS, "", claims=[("More.", [b, c, b])]), executor.Outcome(two.tasks[0], Status.SUCCESS, "", claims=[("Growth.", [a, b])])]
    cases = [(QueryPlan(PlanType.HYBRID, (why, what, sure)), three), (lone, []), (QueryPlan(PlanType.OUT_OF_SCOPE), []), (QueryPlan(PlanType.CLARIFICATION, clarification_question="Which company?"), []), (two, cited)]
    out = []
    for i, (plan, outcomes) in enumerate(cases):
        text, statuses = executor.assemble(plan, outcomes, lambda t: f"<{t}>")
        out.append((i, text, ",".join(x.value for x in statuses)))
    return s.createDataFrame(out, "i int, answer string, statuses string")


@expects(
    "reason, said",
    ("section_absent", "The Business (Item 1) or Risk Factors (Item 1A) section of Intel's filing was not captured in this corpus, so this part can't be answered from the filing text."),
    ("not_addressed", "The Business (Item 1) or Risk Factors (Item 1A) passages retrieved for Intel do not address this question."),
    ("figure_requested", "Financial figures for Intel come from the structured data — ask for the metric directly, for example its total revenue or net income."),
    ("uncited", "I couldn't produce an answer about Intel that is supported by cited passages."), ("failed", "I couldn't retrieve or read the narrative text for Intel just now."),
)
def n3_refusals(s, d):
    reasons = ("section_absent", "not_addressed", "figure_requested", "uncited", "failed")
    return s.createDataFrame([(r, render.narrative_refusal(r, "Intel", ("Item 1A", "Item 1"))) for r in reasons], "reason string, said string")


@expects("i, said", (0, "hybrid:financial_ranking:highest,strategy:Its strategy?"), (1, "single:financial_filter:gt $1bn"), (2, "single:strategy:Why?"), (3, "LabelError: q: the label has no tasks"), (4, "LabelError: q: no threshold for the filter"), (5, "LabelError: q: no question for task t2"))
def s6_label_plans(s, d):
    """What a label stands for as a plan, and labels that stand for none."""
    from tessera.plans import labels

    ranking, own, over = {"intent": "financial_ranking", "metric": "net_income"}, {"intent": "strategy", "company": "AAPL"}, {"intent": "financial_filter", "metric": "net_income"}
    tries = [
        lambda: labels.plan_of_label("q1", "Why?", "hybrid", [ranking, own], task_questions={"q1": {"t2": "Its strategy?"}}), lambda: labels.plan_of_label("q2", "Which?", "single", [over], {"q2": ("gt", "$1bn")}), lambda: labels.plan_of_label("q3", "Why?", "single", [own]),
        lambda: labels.plan_of_label("q", "x", "single", []), lambda: labels.plan_of_label("q", "x", "single", [over]), lambda: labels.plan_of_label("q", "x", "hybrid", [ranking, own]),
    ]
    what = lambda t: f"{t.intent.value}:" + (t.direction.value if t.direction else f"{t.comparison.value} {t.threshold_text}" if t.comparison else t.question)
    out = []
    for i, f in enumerate(tries):
        said = _error(f)
        if said == "accepted":
            p = f()
            said = f"{p.plan_type.value}:{','.join(map(what, p.tasks))}"
        out.append((i, said))
    return s.createDataFrame(out, "i int, said string")


@expects("i, said", (0, "accepted"), (1, "LabelError: labels changed: ca978112ca1b is not 000"), (2, "accepted"), (3, "LabelError: 'm' is configured, 'n' answers"), (4, "LabelError: 'm' is configured, None answers"))
def q11_preconditions(s, d):
    """A run starts only with the labels frozen (line ends aside) and the model configured."""
    import hashlib

    from tessera.plans import labels

    frozen = hashlib.sha256(b"a\nb").hexdigest()
    tries = [lambda: labels.require_unchanged("a\r\nb", frozen), lambda: labels.require_unchanged("a", "000"), lambda: labels.require_served("m", lambda m: m), lambda: labels.require_served("m", lambda m: "n"), lambda: labels.require_served("m", lambda m: None)]
    return s.createDataFrame([(i, _error(f)) for i, f in enumerate(tries)], "i int, said string")


@expects("seconds, warmed, ready", (0.0, True, False), (5.0, False, False), (10.0, True, True), (11.0, False, True), (99.0, False, True))
def w4_retry_gate(s, d):
    """A failed warm-up is tried again after the gap at the earliest, a successful one never."""
    from tessera.plans import labels

    at, outcomes, out = [0.0, 5.0, 10.0, 11.0, 99.0], iter([False, True]), []
    clock = iter(at)
    gate, warmed = labels.RetryGate(10, lambda: next(clock)), []
    for t in at:
        n = len(warmed)
        ready = gate.attempt(lambda: warmed.append(1) or next(outcomes))
        out.append((t, len(warmed) > n, ready))
    return s.createDataFrame(out, "seconds double, warmed boolean, ready boolean")


@expects("a, b, near", ("rates may rise", "may rates rise", 1.0), ("rates may rise", "costs fell", 0.0), ("rates may rise", "", None), ("a a b", "a b b", 0.8))
def c9_embedded(s, d):
    """Texts through the embedding seam, a batch at a time; the stand-in counts words, so the cosine is that of counts."""
    rows = [("rates may rise", "may rates rise"), ("rates may rise", "costs fell"), ("rates may rise", ""), ("a a b", "a b b")]
    df = s.createDataFrame([(i, side, t) for i, r in enumerate(rows) for side, t in zip("ab", r, strict=True)], "i long, side string, text string")
    vectors = retrieval.embedded(df, retrieval.hashed_words, batch=3)
    both = vectors.where("side = 'a'").alias("x").join(vectors.where("side = 'b'").alias("y"), "i")
    zero = retrieval.dot(F.col("y.embedding"), F.col("y.embedding")) == 0
    return both.select(F.col("x.text").alias("a"), F.col("y.text").alias("b"), F.when(~zero, F.round(1 - retrieval.cosine_distance(F.col("x.embedding"), F.col("y.embedding")), 6)).alias("near"))

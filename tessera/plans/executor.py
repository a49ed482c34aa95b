"""Running a plan: rewrite, bind to the catalog, compile each task to DataFrames, render.

Tasks are independent, so their Spark jobs are submitted at once and answered in plan
order. A refusal is an answer; only a fault is a failure, and one task's does not sink the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_claim, display_name, parse_threshold
from ..operators import figures, guards, quality, reads, resolve, retrieval
from ..schemas import Intent, Status, Tool, Unresolved
from . import render
from .tasks import QueryPlan, Task

TOP_K, SURVEY_K, SURVEY_AT_ONCE = 5, 2, 5


@dataclass(frozen=True)
class Catalog:
    """The corpus: documents, attempts, chunks (source_ticker, source_section, chunk_index, source_year, text, embedding) and an embedding function of questions."""

    docs: DataFrame
    records: DataFrame
    chunks: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    #: From a question and numbered blocks to ("answered", [(sentence, block numbers)]) or (refusal, []).
    generate: Callable[[str, list[str]], tuple[str, list[tuple[str, list[int]]]]] | None = None


@dataclass(frozen=True)
class Outcome:
    task: Task
    status: Status
    text: str
    failure: str | None = None
    claims: list[tuple[str, list[tuple]]] = field(default_factory=list)
    note: str | None = None
    withheld: int = 0
    findings: list[dict] = field(default_factory=list)
    #: Figures withheld from what a model saw, and cited numbers that name no block.
    masked: int = 0
    invalid: int = 0
    #: An answer that is not collected: lines, and tables of lines (ticker, document_id, line).
    blocks: tuple[str | DataFrame, ...] = ()


def bind(task: Task, catalog: Catalog) -> tuple[dict | None, str | None, str | None]:
    """The document a task means, or a failure and its sentence; (None, None, None) for corpus-wide tasks."""
    if task.corpus_wide:
        return None, None, None
    spark = catalog.docs.sparkSession
    mention = (task.company_mention or "").strip()
    row = resolve.resolve_company(spark.createDataFrame([(0, mention)], "mention_id int, mention string"), catalog.docs.select("ticker", "company_name")).first()
    # The sentences.
    if row.ticker is None:
        said = {Unresolved.NO_MENTION: "I couldn't tell which company you mean — the question didn't name one.", Unresolved.NON_CORPUS: f"I don't hold a filing for {mention}."}
        several = f"{mention!r} matches several companies I hold." if row.candidates else f"{mention!r} isn't specific enough — several companies match."
        return None, row.failure, said.get(row.failure, several)
    docs = reads.with_derived_flag(catalog.docs, catalog.records).where(F.col("ticker") == row.ticker)
    doc = docs.select("id", "ticker", display_name(F.col("company_name"), F.col("ticker")).alias("name"), "filing_year", "is_embedded", "is_extracted").first().asDict()
    if task.year is not None and task.year != doc["filing_year"]:
        return None, Unresolved.YEAR_NOT_HELD.value, f"I hold one {doc['name']} filing, for fiscal year {doc['filing_year']}. I don't have {task.year}."
    if task.tool is Tool.RAG and not doc["is_embedded"]:
        return None, Unresolved.NOT_EMBEDDED.value, f"{doc['name']} has no indexed narrative text"
    if task.tool is Tool.SQL and not doc["is_extracted"]:
        return None, Unresolved.NOT_EXTRACTED.value, render.not_extracted(doc["name"], doc["filing_year"])
    return doc, None, None


def _in_places(block: str | DataFrame) -> bool:
    return not isinstance(block, str) and "place" in block.columns


def _text(blocks: Iterable[str | DataFrame]) -> str:
    """Blocks as one text, tables in order of place, or else of ticker."""
    order = lambda b: ["place"] if _in_places(b) else ["ticker", "document_id"]
    return "\n".join(x for b in blocks for x in ([b] if isinstance(b, str) else (r.line for r in b.orderBy(*order(b)).collect())))


def _figures(task: Task, doc: dict | None, catalog: Catalog, as_lines: bool = False) -> Outcome:
    threshold = None
    if task.intent is Intent.FINANCIAL_FILTER:
        threshold = catalog.docs.sparkSession.createDataFrame([(task.threshold_text,)], "t string").select(parse_threshold(F.col("t"))).first()[0]
        if threshold is None:
            return Outcome(task, Status.REFUSED, f"I couldn't read the threshold {task.threshold_text!r}.", "threshold_unparsed")
    r = figures.run(catalog.docs, catalog.records, task.metric, doc["id"] if doc else None, task.direction if doc is None else None, task.limit if threshold is None else None, task.comparison, threshold, keep=True)
    shown = r.rows.collect() if threshold is None else figures.placed(r.rows, f"{r.kept}/shown")  # a ranking has at most CAP rows, a filter as many as pass
    if doc and not shown:
        return Outcome(task, Status.REFUSED, render.not_extracted(doc["name"], doc["filing_year"]), Unresolved.NOT_EXTRACTED.value)
    blocks = render.figures(task, shown, r.excluded, r.flagged, threshold)  # the answer names all that are left out
    if as_lines:  # what the lines read stays in the shared folder
        return Outcome(task, Status.SUCCESS, "", blocks=tuple(blocks))
    text = _text(blocks)
    r.release()
    return Outcome(task, Status.SUCCESS, text)


def _stored(ticker: str, sections: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({s for x in sections for s in retrieval.SECTION_ALIASES.get((ticker, x), (x,))}))


def guard_targets(catalog: Catalog, tickers: DataFrame | None = None) -> DataFrame:
    """ticker and the figures (targets) that no text about it may show; of some tickers, or of all."""
    current = reads.current(catalog.docs, catalog.records)
    rows = quality.assessed(current if tickers is None else current.join(tickers, "ticker", "left_semi"))
    return quality.guard_values(rows).groupBy("ticker").agg(F.collect_set("target").alias("targets"))  # five figures, three readings each


def masked_blocks(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Retrieved blocks as a model may see them, with the number of figures withheld from each."""
    return guards.masked(found, targets.withColumnRenamed("ticker", "source_ticker"), "source_ticker")


def shown_claims(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims (ticker, claim) as they may be shown: without inline passage references and without the ticker's figures."""
    return guards.masked(claims.withColumn("claim", clean_claim(F.col("claim"))), targets, "ticker", "claim")


def _source(b) -> tuple:
    return b.source_ticker, b.source_year, b.source_section, b.chunk_index


def _cited(numbers, blocks: list) -> tuple[list, int]:
    """The blocks cited, in order of first mention, and how many numbers name none. Numbers are local to these blocks."""
    asked = list(dict.fromkeys(numbers))
    held = [blocks[n - 1] for n in asked if 1 <= n <= len(blocks)]
    return held, len(asked) - len(held)


def _answered(drafts: list[tuple[str, str, list]], targets: DataFrame, spark) -> tuple[list[tuple[str, str, list]], int]:
    """(ticker, claim, blocks) with the claims as they may be shown, and the number of figures withheld."""
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(drafts)], "n int, ticker string, claim string")
    shown = shown_claims(rows, targets).orderBy("n").collect()
    return [(r.ticker, r.claim, drafts[r.n][2]) for r in shown], sum(r.withheld for r in shown)


def _narrative(task: Task, doc: dict, catalog: Catalog, k: int = TOP_K) -> Outcome:
    spark = catalog.docs.sparkSession
    own = catalog.chunks.where(F.col("source_ticker") == doc["ticker"])
    targets = guard_targets(catalog, spark.createDataFrame([(doc["ticker"],)], "ticker string"))
    vector = catalog.embed(task.question)

    def found_in(sections: tuple[str, ...]) -> list:
        near = retrieval.nearest(own.where(F.col("source_section").isin(*sections)), vector, k, key="chunk_index")
        return masked_blocks(near, targets).orderBy("distance", "chunk_index").collect()  # k rows

    wanted = searched = _stored(doc["ticker"], retrieval.POLICY[task.intent.value])
    fallback = retrieval.FALLBACKS.get(task.intent.value)
    blocks = found_in(wanted)
    if not blocks and fallback:
        other = _stored(doc["ticker"], fallback)
        blocks = found_in(other)
        searched = other if blocks else wanted
    if not blocks:
        return Outcome(task, Status.REFUSED, render.narrative_refusal("section_absent", doc["name"], wanted), "section_absent")
    masked = sum(b.withheld for b in blocks)
    verdict, drafts = catalog.generate(task.question, [f"[{i}] {b.text}" for i, b in enumerate(blocks, 1)])
    answered = verdict == "answered" and bool(drafts)
    note = render.fallback_note(task.intent, doc["name"], wanted, searched, verdict == "answered") if searched != wanted else None
    cites = [(text, *_cited(numbers, blocks)) for text, numbers in drafts] if answered else []
    invalid = sum(n for _, _, n in cites)
    kept = [(doc["ticker"], text, held) for text, held, _ in cites if held]
    if not kept:
        reason = "uncited" if answered else verdict if verdict != "answered" else "not_addressed"
        said = render.narrative_refusal(reason, doc["name"], searched)
        return Outcome(task, Status.REFUSED, f"{note} {said}" if note and not answered else said, reason, masked=masked, invalid=invalid)
    shown, gone = _answered(kept, targets, spark)
    return Outcome(task, Status.SUCCESS, "", None, [(text, [_source(b) for b in held]) for _, text, held in shown], note, gone, masked=masked, invalid=invalid)


def _judged(question: str, blocks: list, generate) -> tuple[str, str, list, int]:
    """One company's verdict: status, claim, cited blocks, and numbers that name none. A claim without a source is not found; a fault is a finding."""
    try:
        verdict, drafts = generate(question, [f"[{i}] {b.text}" for i, b in enumerate(blocks, 1)])
    except Exception:  # noqa: BLE001  one company's failure is a finding, not the survey's end
        return "failed", "", [], 0
    if verdict != "answered" or not drafts or not drafts[0][0]:
        return "not_found", "", [], 0
    held, invalid = _cited(drafts[0][1], blocks)
    return ("supported", drafts[0][0], held, invalid) if held else ("not_found", "", [], invalid)


def _survey(task: Task, catalog: Catalog) -> Outcome:
    """One verdict for every embedded company from its own nearest blocks, so none can crowd another out; SURVEY_AT_ONCE verdicts at a time.

    The blocks a company is judged by are masked, and claims are cleaned and withheld from, as in an answer about one company.
    """
    spark = catalog.docs.sparkSession
    docs = catalog.docs.where("is_embedded").select("ticker", display_name(F.col("company_name"), F.col("ticker")).alias("name")).orderBy("ticker").collect()  # the answer names every company
    primary = F.col("source_section").isin(*retrieval.POLICY[task.intent.value])
    other = retrieval.FALLBACKS.get(task.intent.value, ())
    rows = retrieval.with_fallback(catalog.docs.where("is_embedded").select(F.col("ticker").alias("source_ticker")), catalog.chunks, primary, F.col("source_section").isin(*other) if other else F.lit(False), "source_ticker")
    near = retrieval.nearest_each(rows, catalog.embed(task.question), SURVEY_K, "source_ticker", key="chunk_index")
    targets = guard_targets(catalog)
    by: dict[str, list] = {}
    for b in masked_blocks(near, targets).select("source_ticker", "source_year", "source_section", "chunk_index", "text", "withheld", "rank", "fallback_used").orderBy("source_ticker", "rank").toLocalIterator():
        by.setdefault(b.source_ticker, []).append(b)  # SURVEY_K a company
    if not by:
        reason = "section_absent" if docs else "failed"
        return Outcome(task, Status.REFUSED if docs else Status.FAILED, render.narrative_refusal(reason, "the companies in this corpus", retrieval.POLICY[task.intent.value]), reason)
    with ThreadPoolExecutor(SURVEY_AT_ONCE) as pool:
        verdicts = dict(zip(by, pool.map(lambda blocks: _judged(task.question, blocks, catalog.generate), by.values()), strict=True))
    shown, gone = _answered([(t, claim, held) for t, (status, claim, held, _) in verdicts.items() if status == "supported"], targets, spark)
    claims = {t: (claim, [_source(b) for b in held]) for t, claim, held in shown}
    findings = []
    for d in docs:
        status = verdicts[d.ticker][0] if d.ticker in by else "not_searchable"
        claim, sources = claims.get(d.ticker, ("", []))
        f = {"ticker": d.ticker, "name": d.name, "status": status, "claim": claim, "sources": sources}
        if d.ticker in by and by[d.ticker][0].fallback_used:
            f |= {"fallback_from": retrieval.POLICY[task.intent.value], "searched": other}
        findings.append(f)
    masked, invalid = sum(b.withheld for blocks in by.values() for b in blocks), sum(v[3] for v in verdicts.values())
    return Outcome(task, Status.SUCCESS, "", None, findings=findings, withheld=gone, masked=masked, invalid=invalid)


def run_task(task: Task, catalog: Catalog, as_lines: bool = False) -> Outcome:
    task = task.rewritten()
    try:
        doc, failure, said = bind(task, catalog)
        if failure:
            return Outcome(task, Status.REFUSED, said, failure)
        if task.tool is Tool.SQL:
            return _figures(task, doc, catalog, as_lines)
        return _survey(task, catalog) if doc is None else _narrative(task, doc, catalog)
    except Exception as e:  # noqa: BLE001  a fault in one task leaves the others
        said = "I couldn't retrieve that figure from the structured store." if task.tool is Tool.SQL else render.narrative_refusal("failed", task.company_mention or "the companies in this corpus")
        return Outcome(task, Status.FAILED, said, type(e).__name__)


def execute(plan: QueryPlan, catalog: Catalog, as_lines: bool = False) -> list[Outcome]:
    """The outcomes in plan order. With as_lines, answers that name companies without bound are not collected; lines() has them as a table."""
    if not plan.tasks:
        return []
    with ThreadPoolExecutor(len(plan.tasks)) as pool:
        return list(pool.map(lambda t: run_task(t, catalog, as_lines), plan.tasks))


def _blocks(plan: QueryPlan, outcomes: list[Outcome], name: Callable[[str], str]) -> tuple[list[str | DataFrame], list[Status]]:
    """Lines and tables of lines of the whole answer in plan order, with an empty line between parts; a task without an outcome is reported, not dropped."""
    if not plan.tasks:
        return [render.plan_refusal(plan)], []
    by, citations, out, statuses = {o.task.task_id: o for o in outcomes}, render.Citations(), [], []
    for t in plan.tasks:
        o = by.get(t.task_id)
        statuses.append(o.status if o else Status.FAILED)
        if o and o.status is Status.SUCCESS:
            body = list(o.blocks) or [o.text]
            if o.claims:
                body = [" ".join(f"{c} {citations.marks(s)}" for c, s in o.claims)]
            elif o.findings:
                body = [render.survey(o.findings, citations)]
            body = [o.note] * bool(o.note) + body + [render.WITHHELD_NOTE] * bool(o.withheld)
        else:
            said = (o.text if o else "") or render.MISSING_PART
            body = [f"{t.question} — {said}" if t.question and (len(plan.tasks) > 1 or o is None) else said]
        out += ["", *body] if out else body
    return out + (["", "Sources:", *citations.listed(name)] if citations.numbers else []), statuses


def assemble(plan: QueryPlan, outcomes: list[Outcome], name: Callable[[str], str] = str) -> tuple[str, list[Status]]:
    """The whole answer as one text."""
    blocks, statuses = _blocks(plan, outcomes, name)
    return _text(blocks), statuses


def lines(spark: SparkSession, plan: QueryPlan, outcomes: list[Outcome], name: Callable[[str], str] = str) -> tuple[DataFrame, list[Status]]:
    """The whole answer as a table, a row for each line: block, ticker, document_id, line. In order of the first three (nulls first) they are the text of assemble().

    A table whose lines have a place takes a block for each place up to its last.
    """
    blocks, statuses = _blocks(plan, outcomes, name)
    blocks = [x for b in blocks for x in (b.split("\n") if isinstance(b, str) else [b])]
    places = lambda b: b.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
    at = list(accumulate((places(b) if _in_places(b) else 1 for b in blocks), initial=0))
    said = [(i, None, None, b) for i, b in zip(at, blocks, strict=False) if isinstance(b, str)]
    out = spark.createDataFrame(said, "block long, ticker string, document_id string, line string")
    for i, b in zip(at, blocks, strict=False):
        if not isinstance(b, str):
            out = out.unionByName(b.withColumn("block", F.lit(i) + (F.col("place") if _in_places(b) else F.lit(0).cast("long"))).select(*out.columns))
    return out, statuses


# The reasons a refusal may give.
REASONS = (
    "non_corpus_company", "company_not_embedded", "company_not_extracted", "year_not_held", "ambiguous_company", "no_company_mention",
    "section_absent", "not_addressed", "figure_requested", "uncited", "threshold_unparsed", "sql_not_runnable",
)


def refusal_reason(o: Outcome) -> str | None:
    """The one typed reason of a refused task; none for an answer, a failure, or a narrative refusal of no known kind."""
    if o.status is not Status.REFUSED:
        return None
    own = o.failure.value if isinstance(o.failure, Unresolved) else o.failure
    if own in REASONS:
        return own
    if o.task.tool is not Tool.SQL:
        return None
    return "threshold_unparsed" if o.task.intent is Intent.FINANCIAL_FILTER else "sql_not_runnable"


def nothing_answered(statuses: list[Status]) -> bool:
    return bool(statuses) and all(s is Status.FAILED for s in statuses)

"""Getting figures out of filings as a run: input assembly, strategies as data, a pluggable extractor, an attempt for every document.

One document's failure never stops the run. A call that did not complete is technical_failed, an answer that
cannot be used is extraction_failed, and both are attempts like a success, with their reason.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MULTIPLIERS
from ..operators import quality
from ..schemas import METRICS

SEPARATOR = "\n\n"
#: How a filing names each figure.
NAMES = {"total_revenue": r"(?:total )?(?:net )?(?:revenues?|sales)", "net_income": r"net income", "total_assets": r"total assets", "total_liabilities": r"total liabilities", "operating_cash_flow": r"(?:net )?cash (?:provided by|from|generated by) operating activities"}
UNITS = dict(zip(("thousands", "millions", "billions"), MULTIPLIERS[1:], strict=True))


@dataclass(frozen=True)
class Strategy:
    """What an extractor is asked to do: look at line starts alone, apply the stated unit, cite its lines."""

    name: str
    line_starts: bool
    units: bool
    evidence: bool = False


STRATEGIES = {
    "S0": Strategy("naive", False, False), "S1": Strategy("units", False, True), "S2": Strategy("line starts", True, False),
    "S3": Strategy("line starts and units with evidence", True, True, True), "S4": Strategy("line starts and units", True, True),
}


@dataclass(frozen=True)
class Answer:
    """An extractor's answer: figures and cited lines by metric, what it cost, and whether it was replayed from a cache."""

    figures: dict
    lines: dict
    input_tokens: int = 0
    output_tokens: int = 0
    from_cache: bool = False


#: From a text and a strategy to an answer; it may raise.
Extractor = Callable[[str, Strategy], Answer]


def assembled_input(cover: Column, statements: Column) -> Column:
    """Cover and statements as the extractor reads them."""
    return F.concat_ws(SEPARATOR, cover, statements)


def read_figures(text: str, strategy: Strategy) -> Answer:
    """The first line that names each figure, and the first number after its name, at the unit the filing states."""
    unit = re.search(r"(?i)\bin (thousands|millions|billions)\b", text) if strategy.units else None
    scale, found, lines = UNITS[unit.group(1).lower()] if unit else 1.0, {}, {}
    for metric, name in NAMES.items():
        lead = r"[^\S\n]*" if strategy.line_starts else r"[^\n]*?\b"
        m = re.search(rf"(?im)^({lead}{name}\b[^\n\d]*(\d[\d,]*\.?\d*)[^\n]*)$", text)
        found[metric] = float(m.group(2).replace(",", "").rstrip(".")) * scale if m else None
        lines[metric] = m.group(1).strip() if m and strategy.evidence else None
    return Answer(found, lines, len(text.split()), sum(v is not None for v in found.values()))


def why_unusable(answer: Answer) -> str | None:
    """Why an answer is no extraction, or nothing: figures must be numbers of known metrics, lines texts, and one figure must be there."""
    if set(answer.figures) - set(METRICS) or set(answer.lines) - set(METRICS):
        return "unknown field"
    for m, v in answer.figures.items():
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v)):
            return f"{m} is not a number"
    if not all(v is None or isinstance(v, str) for v in answer.lines.values()):
        return "a cited line is not a text"
    return None if any(v is not None for v in answer.figures.values()) else "no figure found"


_LINES = [f"{m}_source_line" for m in METRICS]
_RUN = "document_id long, text string, extraction_status string, failure_reason string, input_tokens long, output_tokens long, from_cache boolean, " + ", ".join([*(f"{m} double" for m in METRICS), *(f"{x} string" for x in _LINES)])


def _attempt(text: str | None, strategy: Strategy, extractor: Extractor) -> tuple:
    """Status, reason, tokens, cached, figures and lines of one document."""
    none = [None] * (2 * len(METRICS))
    try:
        if text is None:
            raise FileNotFoundError("the document has no text")
        a = extractor(text, strategy)
    except Exception as e:  # noqa: BLE001  an attempt that did not complete
        return ("technical_failed", f"{type(e).__name__}: {e}", 0, 0, False, *none)
    if reason := why_unusable(a):
        return ("extraction_failed", reason, a.input_tokens, a.output_tokens, a.from_cache, *none)
    figures = [None if a.figures.get(m) is None else float(a.figures[m]) for m in METRICS]
    return ("success", None, a.input_tokens, a.output_tokens, a.from_cache, *figures, *(a.lines.get(m) for m in METRICS))


def extracted(inputs: DataFrame, strategy: str = "S3", extractor: Extractor = read_figures) -> DataFrame:
    """An attempt for each document (document_id, text): status, figures, cited lines, checks of these against the source, tokens. An unknown strategy raises before any work."""
    chosen = STRATEGIES[strategy]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, t, *_attempt(t, chosen, extractor)) for i, t in zip(f["document_id"], f["text"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RUN.split(", ")])

    rows = inputs.select(F.col("document_id").cast("long").alias("document_id"), "text").mapInPandas(run, _RUN)
    checks = {}
    for m in METRICS:
        value, line = F.col(m), F.col(f"{m}_source_line")
        checks |= {f"{m}_evidence_present": quality.evidence_present(line, F.col("text")), f"{m}_evidence_consistent": quality.evidence_consistent(value, line)}
    cited = F.when(F.coalesce(*_LINES).isNotNull(), F.to_json(evidence_map()))
    return rows.withColumns({**checks, "evidence_json": cited, "extraction_strategy_used": F.lit(strategy)}).drop("text")


def run_summary(attempts: DataFrame) -> DataFrame:
    """One row: documents by outcome (they sum to all), cached answers, and tokens paid for now and earlier."""
    status, cached = F.col("extraction_status"), F.col("from_cache")
    counts = [F.count_if(status == s).alias(s) for s in ("success", "extraction_failed", "technical_failed")]
    tokens = [F.coalesce(F.sum(F.when(cached == replayed, F.col(f"{x}_tokens"))), F.lit(0)).alias(f"{name}_{x}_tokens") for replayed, name in ((False, "billed"), (True, "replayed")) for x in ("input", "output")]
    return attempts.agg(F.count("*").alias("processed"), *counts, F.count_if(cached).alias("cached_hits"), *tokens)


def evidence_map() -> Column:
    """Metric to value and cited line, from the wide columns."""
    return F.create_map(*(x for m in METRICS for x in (F.lit(m), F.struct(F.col(m).alias("value"), F.col(f"{m}_source_line").alias("source_line")))))


def plain_figures(evidence: Column) -> Column:
    """The evidence map's values alone."""
    return F.transform_values(evidence, lambda _, v: v["value"])

"""Evaluating plans: what a label would have planned, what must hold before a run, and when a failed warm-up may be tried again."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping

from ..schemas import Comparison, Direction, Intent, Metric, PlanType
from .tasks import FINANCIAL, QueryPlan, Task


class LabelError(ValueError):
    """A label that cannot be executed."""


def plan_of_label(question_id: str, question: str, plan_type: str, tasks: list[Mapping], filters: Mapping[str, tuple[str, str]] = {}, task_questions: Mapping[str, Mapping[str, str]] = {}) -> QueryPlan:
    """The plan a strict label stands for.

    Rankings without a direction are highest first; filters take comparison and threshold from `filters` by question; a lone
    narrative task asks the question itself, one of several its own text from `task_questions`.
    """
    if not tasks:
        raise LabelError(f"{question_id}: the label has no tasks")
    out = []
    for i, t in enumerate(tasks, 1):
        intent, own = Intent(t["intent"]), {}
        if t.get("metric"):
            own["metric"] = Metric(t["metric"])
        if intent is Intent.FINANCIAL_RANKING:
            own["direction"] = Direction(t.get("direction") or "highest")
        if intent is Intent.FINANCIAL_FILTER:
            if question_id not in filters:
                raise LabelError(f"{question_id}: no threshold for the filter")
            comparison, own["threshold_text"] = filters[question_id]
            own["comparison"] = Comparison(comparison)
        if intent not in FINANCIAL:
            own["question"] = question if len(tasks) == 1 else task_questions.get(question_id, {}).get(f"t{i}")
            if not own["question"]:
                raise LabelError(f"{question_id}: no question for task t{i}")
        out.append(Task(f"t{i}", intent, company_mention=t.get("company"), year=t.get("year"), **own))
    return QueryPlan(PlanType(plan_type), tuple(out), rationale="label")


def require_unchanged(text: str, expected: str) -> str:
    """The text, if its hash with Unix line ends is the one frozen; else a run must not start."""
    found = hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()
    if found != expected:
        raise LabelError(f"labels changed: {found[:12]} is not {expected[:12]}")
    return text


def require_served(configured: str, probe: Callable[[str], str | None]) -> str:
    """The configured model's name, if that is what answers."""
    served = probe(configured)
    if served != configured:
        raise LabelError(f"{configured!r} is configured, {served!r} answers")
    return served


class RetryGate:
    """Lets one attempt through at most every `gap` seconds until it succeeds."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.gap, self.clock, self.last, self.ready = gap, clock, None, False

    def attempt(self, warm: Callable[[], bool]) -> bool:
        now = self.clock()
        if not self.ready and (self.last is None or now - self.last >= self.gap):
            self.last = now
            self.ready = warm()
        return self.ready

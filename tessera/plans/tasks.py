"""The plan of a question: at most three independent tasks, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..schemas import Comparison, Direction, Intent, Metric, PlanType, Tool, Unsupported

MAX_TASKS = 3
FINANCIAL = frozenset({Intent.FINANCIAL_METRIC, Intent.FINANCIAL_RANKING, Intent.FINANCIAL_FILTER})
CORPUS_WIDE = frozenset({Intent.FINANCIAL_RANKING, Intent.FINANCIAL_FILTER})


def tool_for(intent: Intent) -> Tool:
    """Fixed by the intent; a plan never chooses its tool."""
    return Tool.SQL if intent in FINANCIAL else Tool.RAG


@dataclass(frozen=True)
class Task:
    task_id: str
    intent: Intent
    company_mention: str | None = None
    year: int | None = None
    metric: Metric | None = None
    comparison: Comparison | None = None
    threshold_text: str | None = None
    direction: Direction | None = None
    limit: int | None = None
    question: str | None = None

    def __post_init__(self) -> None:
        if self.year is not None and not 1990 <= self.year <= 2100:
            raise ValueError("the year must lie in 1990 to 2100")
        if self.limit is not None and not 1 <= self.limit <= 20:
            raise ValueError("the limit must lie in 1 to 20")
        needs = {
            Intent.FINANCIAL_METRIC: ("metric",),
            Intent.FINANCIAL_RANKING: ("metric", "direction"),
            Intent.FINANCIAL_FILTER: ("metric", "comparison", "threshold_text"),
        }.get(self.intent, ("question",))
        for name in needs:
            if not getattr(self, name):
                raise ValueError(f"{self.intent.value} needs {name}")

    @property
    def tool(self) -> Tool:
        return tool_for(self.intent)

    @property
    def names_company(self) -> bool:
        return bool((self.company_mention or "").strip())

    @property
    def corpus_wide(self) -> bool:
        """Rankings and filters always; a narrative that names nobody."""
        return self.intent in CORPUS_WIDE or (self.tool is Tool.RAG and not self.names_company)

    def rewritten(self) -> Task:
        """A ranking or filter that names a company is that company's lookup."""
        if self.intent in CORPUS_WIDE and self.names_company:
            return replace(self, intent=Intent.FINANCIAL_METRIC, comparison=None, threshold_text=None, direction=None, limit=None, question=None)
        return self


@dataclass(frozen=True)
class QueryPlan:
    plan_type: PlanType
    tasks: tuple[Task, ...] = ()
    unsupported_reason: Unsupported | None = None
    clarification_question: str | None = None
    rationale: str | None = None

    def __post_init__(self) -> None:
        n = len(self.tasks)
        low, high = {PlanType.SINGLE: (1, 1), PlanType.HYBRID: (2, MAX_TASKS)}.get(self.plan_type, (0, 0))
        if not low <= n <= high:
            raise ValueError(f"a {self.plan_type.value} plan has {low} to {high} tasks, not {n}")
        if self.plan_type is PlanType.UNSUPPORTED and self.unsupported_reason is None:
            raise ValueError("an unsupported plan names its reason")
        if self.plan_type is PlanType.CLARIFICATION and not self.clarification_question:
            raise ValueError("a clarification plan asks a question")
        if len({t.task_id for t in self.tasks}) != n:
            raise ValueError("task ids must differ")

"""Evaluation statistics over scored rows: extraction, routing, retrieval, judging, execution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import scoring_text, span_text

NUMERIC_TOLERANCE = 1e-5


def relative_error(value: Column, truth: Column) -> Column:
    return F.when(truth == 0, F.when(value == 0, F.lit(0.0))).otherwise(F.abs(value - truth) / F.abs(truth))


def numeric_outcome(value: Column, truth: Column, tolerance: float = NUMERIC_TOLERANCE) -> Column:
    """n_a where there is no truth, even if a value was asserted; a zero truth wants exactly zero."""
    return F.when(truth.isNull(), "n_a").when(value.isNull(), "missing").when(F.coalesce(relative_error(value, truth) <= tolerance, F.lit(False)), "correct").otherwise("wrong")


def string_outcome(value: Column, truth: Column) -> Column:
    v, t = scoring_text(value), scoring_text(truth)
    return F.when(t.isNull(), "n_a").when(v.isNull(), "missing").when(v == t, "correct").otherwise("wrong")


def _metrics(rows: DataFrame, *groups) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("missing").alias("missing"), n("n_a").alias("n_a"), F.avg("rel_error").alias("mean_rel_error"))


def _with_ratios(counts: DataFrame) -> DataFrame:
    c, w, m = F.col("correct"), F.col("wrong"), F.col("missing")
    out = counts.withColumn("n_scored", c + w + m).withColumn("precision", stats.precision(c, w)).withColumn("recall", stats.recall(c, w, m))
    return out.withColumn("f1", stats.f1(F.col("precision"), F.col("recall")))


def field_metrics(scores: DataFrame, provenance: bool = False) -> DataFrame:
    """Counts, precision, recall, F1 and mean relative error by field; with provenance also by (field, section_source), in one pass."""
    if not provenance:
        return _with_ratios(_metrics(scores.groupBy("field")))
    sets = scores.groupingSets([[F.col("field")], [F.col("field"), F.col("section_source")]], F.col("field"), F.col("section_source"))
    return _with_ratios(_metrics(sets))


def run_costs(results: DataFrame, rate_in: float, rate_out: float) -> DataFrame:
    """Status counts and token sums, billed and cached, with what the billed ones cost."""
    billed = ~F.col("cached")
    out = results.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(billed, F.col("input_tokens")).otherwise(0)).alias("billed_in"), F.sum(F.when(billed, F.col("output_tokens")).otherwise(0)).alias("billed_out"), F.sum(F.when(billed, 0).otherwise(F.col("input_tokens"))).alias("cached_in"))
    return out.withColumn("cost", stats.cost(F.col("billed_in"), F.col("billed_out"), rate_in, rate_out))


def group_summary(scores: DataFrame, group: str) -> DataFrame:
    """Strict and lenient means over runs with Wilson intervals over questions, and how many questions varied.

    scores: group, question, run, strict, lenient, signature.
    """
    per_question = scores.groupBy(group, "question").agg(F.avg(F.col("strict").cast("double")).alias("s"), F.avg(F.col("lenient").cast("double")).alias("l"), (F.countDistinct("signature") > 1).alias("plan_varied"), (F.countDistinct("strict") > 1).alias("score_varied"))
    out = per_question.groupBy(group).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("l").alias("l"), F.count_if("plan_varied").alias("plan_varied"), F.count_if("score_varied").alias("score_varied"))
    ci, lenient = stats.wilson(F.col("s"), F.col("n")), stats.wilson(F.col("l"), F.col("n"))
    intervals = ci["low"].alias("strict_low"), ci["high"].alias("strict_high"), lenient["low"].alias("lenient_low"), lenient["high"].alias("lenient_high")
    return out.select(group, "n", (F.col("s") / F.col("n")).alias("strict_mean"), (F.col("l") / F.col("n")).alias("lenient_mean"), *intervals, "plan_varied", "score_varied")


def run_counts(scores: DataFrame, group: str) -> DataFrame:
    """How many questions of a group each run got right, strictly and leniently: a row for each group and run."""
    return scores.groupBy(group, "run").agg(F.count_if("strict").alias("strict"), F.count_if("lenient").alias("lenient"))


def multisets(tasks: DataFrame, by: str, key: Column) -> DataFrame:
    """The sorted keys of each group: equal exactly for equal multisets."""
    return tasks.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def scored_alternatives(observed: DataFrame, alternatives: DataFrame) -> DataFrame:
    """strict, lenient and miss of each observed plan.

    observed: question, run, plan_type, reason, fallback, intents, companies, keys (sorted arrays).
    alternatives: question, alt_no (0 is strict), plan_type, reason, intents, companies, keys.
    """
    a = alternatives.select("question", "alt_no", *(F.col(c).alias(f"a_{c}") for c in ("plan_type", "reason", "intents", "companies", "keys")))
    same_type = F.col("plan_type") == F.col("a_plan_type")
    body = F.when(F.col("plan_type") == "unsupported", F.equal_null(F.col("reason"), F.col("a_reason"))).otherwise(F.col("keys") == F.col("a_keys"))
    j = observed.join(a, "question", "left").withColumn("hit", F.coalesce(~F.col("fallback") & same_type & body, F.lit(False)))
    level = (
        F.when(F.col("plan_type") == "unsupported", "unsupported_reason").when(F.size("keys") != F.size("a_keys"), "task_count")
        .when(F.col("intents") != F.col("a_intents"), "intent").when(F.col("companies") != F.col("a_companies"), "company").otherwise("parameter")
    )
    j = j.withColumn("level", F.when(same_type, level))
    out = j.groupBy("question", "run").agg(F.min(F.when(F.col("hit"), F.col("alt_no"))).alias("alt"), F.min_by("level", F.when(same_type, F.col("alt_no"))).alias("level"), F.first("fallback").alias("fallback"))
    miss = F.when(F.col("alt").isNotNull(), F.lit(None)).when(F.col("fallback"), "planner_fallback").otherwise(F.coalesce("level", F.lit("plan_type")))
    return out.select("question", "run", (F.coalesce(F.col("alt") == 0, F.lit(False))).alias("strict"), F.col("alt").isNotNull().alias("lenient"), miss.alias("miss"))


def common_keys(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """How many keys two multisets of a group share, counted with multiplicity."""
    x, y = (d.groupBy(group, key).agg(F.count("*").alias(n)) for d, n in ((a, "_x"), (b, "_y")))
    return x.join(y, [group, key]).groupBy(group).agg(F.sum(F.least("_x", "_y")).alias("common"))


def ranking_metrics(ranking: DataFrame, relevant: DataFrame, judged: DataFrame, k: int, query: str = "qid", key: str = "key") -> DataFrame:
    """hit, capped recall, precision, first relevant rank and unjudged in the top k, by query; none relevant gives null hit and recall.

    ranking: query, key, rank. relevant and judged: query, key.
    """
    totals = relevant.groupBy(query).agg(F.count("*").alias("relevant_total"))
    j = ranking.join(relevant.select(query, key, F.lit(True).alias("_rel")), [query, key], "left").join(judged.select(query, key, F.lit(True).alias("_read")), [query, key], "left")
    top, rel = F.col("rank") <= k, F.col("_rel").isNotNull()
    out = j.groupBy(query).agg(F.count_if(top & rel).alias("found"), F.count_if(top).alias("shown"), F.min(F.when(rel, F.col("rank"))).alias("first_rank"), F.count_if(top & F.col("_read").isNull()).alias("unjudged"))
    out = out.join(totals, query, "left").withColumn("relevant_total", F.coalesce("relevant_total", F.lit(0)))
    some = F.col("relevant_total") > 0
    return out.select(query, "relevant_total", "first_rank", F.when(some, F.col("found") > 0).alias("hit"), F.when(some, F.col("found") / F.least(F.lit(k), "relevant_total")).alias("recall"), F.when(F.col("shown") > 0, F.col("found") / F.col("shown")).otherwise(0.0).alias("precision"), "unjudged")


def unjudged_in_top(ranking: DataFrame, judged: DataFrame, k: int, query: str = "qid", key: str = "key") -> DataFrame:
    return ranking.where(F.col("rank") <= k).join(judged.select(query, key), [query, key], "left_anti")


def two_level_mean(rows: DataFrame, group: str, question: str, value: str) -> DataFrame:
    """Mean over a question's runs first, then over questions; what was not measured is left out."""
    inner = rows.groupBy(group, question).agg(F.avg(value).alias("_m"))
    return inner.groupBy(group).agg(F.avg("_m").alias("mean"), F.count("_m").alias("n_measured"))


def paired(rows: DataFrame, a: str, b: str, band: float = 1e-9) -> DataFrame:
    """How often b is better, worse or the same as a, where both were measured."""
    d = F.col(b) - F.col(a)
    return rows.where(d.isNotNull()).groupBy(F.when(F.abs(d) < band, "same").when(d > 0, "better").otherwise("worse").alias("verdict")).agg(F.count("*").alias("n"))


def majority(labels: DataFrame, item: str, supported: str) -> DataFrame:
    """The majority of non-null labels; a tie is not support, no label is null. With the flip flag: more than one distinct label."""
    yes, n = F.count_if(F.col(supported)), F.count(supported)
    return labels.groupBy(item).agg(F.when(n > 0, yes > n - yes).alias("majority"), (F.countDistinct(supported) > 1).alias("flipped"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts of two raters."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def seed_catch(rows: DataFrame) -> DataFrame:
    """Of seeded errors by type: how many there are, how many were caught, whether all were."""
    return rows.groupBy("seed_type").agg(F.count("*").alias("n"), F.count_if("caught").alias("caught"), F.every("caught").alias("passed"))


def support_rate(rows: DataFrame, *groups: str) -> DataFrame:
    out = rows.groupBy(*groups).agg(F.count_if("supported").alias("yes"), F.count("supported").alias("n"))
    ci = stats.wilson(F.col("yes"), F.col("n"))
    return out.select(*groups, "yes", "n", F.when(F.col("n") > 0, F.col("yes") / F.col("n")).alias("rate"), ci["low"].alias("low"), ci["high"].alias("high"))


def outcome_class() -> Column:
    """One label for an executed task, from resolution_failure, tool, status, disputed, refusal and fallback_used."""
    sql = F.when(F.col("status") == "failed", "failed").when(F.col("status") != "success", "sql_refused").when(F.col("disputed"), "answered_flagged").otherwise("answered")
    rag = F.when(F.col("has_result") == F.lit(False), "failed").when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("fallback_used"), "fallback_answered").otherwise("answered")
    return F.when(F.col("resolution_failure").isNotNull(), F.col("resolution_failure")).when(F.col("tool") == "sql", sql).otherwise(rag)


def question_correct(questions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Routed, and every task correct; a question without tasks needs routing alone."""
    all_right = tasks.groupBy("question").agg(F.every("correct").alias("_all"))
    return questions.join(all_right, "question", "left").withColumn("correct", F.col("routed") & F.coalesce("_all", F.lit(True))).drop("_all")


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each distinct value once, in order of its first place."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("_p"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda s: s[value]).alias("values"))


def planner_pick(runs: DataFrame, tasks: DataFrame, accepted: DataFrame) -> DataFrame:
    """For each run the question of its task with the first accepted intent; none is kept as null."""
    ok = tasks.where(F.coalesce("question_text", F.lit("")) != "").join(accepted, "intent")
    best = ok.groupBy("run").agg(F.min_by(F.struct("intent", "question_text"), F.struct("place", "task_no")).alias("_b"))
    return runs.join(best, "run", "left").select("run", F.col("_b.intent").alias("intent"), F.col("_b.question_text").alias("question_text"))


def tally(rows: DataFrame, group: str, flag: str) -> DataFrame:
    f = F.col(flag)
    return rows.groupBy(group).agg(F.count_if(f).alias("n_true"), F.count_if(~f).alias("n_false"), F.count_if(f.isNull()).alias("n_none"))


def claims(records: DataFrame) -> DataFrame:
    """Judged sentences of nested results: claims numbered within a task, findings by ticker.

    records: id, tasks array<struct<task_id, company, claims array<struct<text, sources>>, findings array<struct<ticker, claim struct<text, sources>>>>>.
    """
    t = records.select("id", F.explode("tasks").alias("t"))
    c = t.select("id", "t", F.posexplode("t.claims").alias("n", "c")).select(F.concat_ws("|", "id", "t.task_id", F.concat(F.lit("c"), (F.col("n") + 1).cast("string"))).alias("item"), F.col("t.company").alias("company"), F.col("c.text").alias("claim"), F.col("c.sources").alias("sources"), F.lit("claim").alias("kind"))
    f = t.select("id", "t", F.explode("t.findings").alias("f")).where("f.claim IS NOT NULL").select(F.concat_ws("|", "id", "t.task_id", "f.ticker").alias("item"), F.col("f.ticker").alias("company"), F.col("f.claim.text").alias("claim"), F.col("f.claim.sources").alias("sources"), F.lit("finding").alias("kind"))
    return c.unionByName(f)


def label_sheet(lines: DataFrame, sheet: str = "sheet", no: str = "line_no", text: str = "line") -> DataFrame:
    """item and label (S or N, or null where invalid) of a labelling sheet: headings carry forward to label lines."""
    heading = F.when(F.col(text).rlike(r"^##\s+\S+\s*$"), F.regexp_extract(F.col(text), r"^##\s+(\S+)\s*$", 1))
    w = Window.partitionBy(sheet).orderBy(no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("item", F.last(heading, ignorenulls=True).over(w)).withColumn("raw", F.upper(F.regexp_extract(F.col(text), r"(?i)^\s*Label:\s*(\S*)\s*$", 1)))
    rows = rows.where(F.col(text).rlike(r"(?i)^\s*Label:\s*\S*\s*$") & F.col("item").isNotNull())
    return rows.groupBy(sheet, "item").agg(F.max_by(F.when(F.col("raw").isin("S", "N"), F.col("raw")), no).alias("label"))


def span_found(verdict: Column, span: Column, excerpts: Column) -> Column:
    """For a supporting verdict whether its quoted span occurs in the excerpts, quotes and spaces aside; null for others."""
    inside = F.contains(span_text(excerpts), span_text(span))
    return F.when(verdict == "supported", F.coalesce((F.coalesce(span, F.lit("")) != "") & inside, F.lit(False)))


def judged_sources(claims_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each claim with the texts of its sources in order and the number that no chunk has: such a claim is not judged but failed.

    claims_: item, sources array<string>. chunks: key, text.
    """
    each = claims_.select("item", F.posexplode("sources").alias("pos", "key")).join(chunks.select("key", "text"), "key", "left")
    return each.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda x: x["text"]).alias("texts"), F.count_if(F.col("text").isNull()).alias("missing"))


def judgements(claims_: DataFrame, judge: Callable[[str, list[str], int], tuple[str, str]], runs: int) -> DataFrame:
    """Each claim judged `runs` times: item, run, verdict, span, span_found, error. A call that fails, or a claim with a missing source, has no verdict and an error.

    claims_: item, claim, texts, missing (as judged_sources gives them). judge: from claim, texts and run to a verdict and its quoted span.
    """
    rows = claims_.select("item", "claim", "texts", "missing", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))

    def one(claim: str, texts: list[str], missing: int, run: int) -> tuple[str | None, str | None, str | None]:
        try:
            if missing:
                raise LookupError(f"{missing} cited sources are missing")
            return (*judge(claim, list(texts), run), None)
        except Exception as e:  # noqa: BLE001  one call's failure is counted, not raised
            return None, None, f"{type(e).__name__}: {e}"

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [one(*x) for x in zip(f["claim"], f["texts"], f["missing"], f["run"], strict=True)]
            yield f[["item", "run", "excerpts"]].assign(verdict=[x[0] for x in said], span=[x[1] for x in said], error=[x[2] for x in said])

    out = rows.withColumn("excerpts", F.array_join("texts", "\n\n")).mapInPandas(call, "item string, run int, excerpts string, verdict string, span string, error string")
    return out.withColumn("span_found", span_found(F.col("verdict"), F.col("span"), F.col("excerpts"))).drop("excerpts")


def settled(judged: DataFrame) -> DataFrame:
    """The majority over a claim's runs, whether its verdict changed, and how many calls failed."""
    flags = judged.withColumn("yes", F.col("verdict") == "supported")
    return majority(flags, "item", "yes").join(judged.groupBy("item").agg(F.count_if(F.col("error").isNotNull()).alias("failed")), "item")


def against_key(records: DataFrame, truth: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A scored row for each record and field against the answer key (cik, fiscal_year); records the key lacks score n_a."""
    t = truth.select("cik", "fiscal_year", *(F.col(f).alias(f"_t_{f}") for f in fields))
    j = records.join(t, ["cik", "fiscal_year"], "left")
    rows = j.select("cik", "fiscal_year", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"_t_{f}").alias("truth")) for f in fields))).alias("x")).select("cik", "fiscal_year", "x.*")
    both = F.col("value").isNotNull() & F.col("truth").isNotNull()
    return rows.withColumn("outcome", numeric_outcome(F.col("value"), F.col("truth"))).withColumn("rel_error", F.when(both, relative_error(F.col("value"), F.col("truth"))))

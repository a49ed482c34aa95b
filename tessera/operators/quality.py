"""Data quality of figures from their own cited lines, and sentences that disclose it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MULTIPLIERS, flattened, literals, numbers_in_line
from ..schemas import METRICS

REL_TOLERANCE, ABS_TOLERANCE, MIN_CHECKABLE = 1e-3, 1e-6, 3
SCALE_REASONS = ("scale_ambiguous", "scale_disagreement", "scale_not_checkable")
SCALE_STEP = 1e3
# The sentence beside a figure by reason, and what follows where the right value can be told.
NOTES = {
    "null_field": "This figure was not extracted from the filing.",
    "evidence_mismatch": "Flagged: the line cited for this figure does not contain it, so the value may be derived or drawn from a neighbouring item.",
    "scale_disagreement": "Flagged: this figure's implied scale disagrees with the rest of the filing.",
    "scale_ambiguous": "Flagged: figures in this filing were extracted at two different scales and neither is in the majority, so which is authoritative cannot be determined from the filing alone.",
    "scale_not_checkable": "Flagged: the scale of this figure could not be checked.",
}
CORRECTABLE, LIKELY = "scale_disagreement", " The value is likely {}."


def evidence_present(line: Column, source: Column) -> Column:
    """Whether the cited line occurs in the source, white space and case aside; null without a line."""
    return F.contains(flattened(source), flattened(line))


def _matches(number: Column, scale: Column, value: Column) -> Column:
    target = F.abs(value)
    return F.abs(number * scale - target) <= F.greatest(target * REL_TOLERANCE, F.lit(ABS_TOLERANCE))


def evidence_consistent(value: Column, line: Column) -> Column:
    """Whether a number printed in the line is the value at some scale; null if either is missing."""
    found = F.exists(numbers_in_line(line), lambda n: F.exists(literals(MULTIPLIERS), lambda s: _matches(n, s, value)))
    return F.when(value.isNotNull() & line.isNotNull(), found)


def implied_multiplier(value: Column, line: Column) -> Column:
    """The scale of the first printed number that fits the value; null if none does."""
    hits = F.flatten(F.transform(numbers_in_line(line), lambda n: F.filter(literals(MULTIPLIERS), lambda s: _matches(n, s, value))))
    return F.when(value.isNotNull() & (F.coalesce(line, F.lit("")) != ""), F.get(hits, 0))


def document_scale(multipliers: Column) -> Column:
    """scale and ambiguous of an array of multipliers: the unique most frequent of at least three, else none; a tie is ambiguous."""
    known = F.filter(multipliers, lambda m: m.isNotNull())
    counts = F.transform(literals(MULTIPLIERS), lambda s: F.size(F.filter(known, lambda m: m == s)))
    most = F.array_max(counts)
    leaders = F.filter(literals(MULTIPLIERS), lambda s: F.size(F.filter(known, lambda m: m == s)) == most)
    enough = F.size(known) >= MIN_CHECKABLE
    return F.struct(F.when(enough & (F.size(leaders) == 1), F.get(leaders, 0)).alias("scale"), (enough & (F.size(leaders) > 1)).alias("ambiguous"))


def assessed(records: DataFrame, only: str | None = None) -> DataFrame:
    """A row for each record and metric (or the one metric `only`) with value, line, verdict, reason, multiplier, scale and suspected value.

    Five figures of a record are judged together inside its row, so nothing is shuffled.
    """
    names = [c for c in records.columns if c not in METRICS and not c.endswith("_source_line")]
    figures = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_source_line").alias("line"), implied_multiplier(F.col(m), F.col(f"{m}_source_line")).alias("multiplier")) for m in METRICS))
    rows = records.withColumn("_f", figures).withColumn("_s", document_scale(F.transform("_f", lambda f: f["multiplier"])))
    each = F.explode("_f" if only is None else F.slice("_f", METRICS.index(only) + 1, 1))
    rows = rows.select(*names, "_s", each.alias("f")).select(*names, "f.*", F.col("_s.scale").alias("document_scale"), F.col("_s.ambiguous").alias("_a"))
    v, m, s = F.col("value"), F.col("multiplier"), F.col("document_scale")
    reason = F.when(v.isNull(), "null_field").when(m.isNull(), "evidence_mismatch").when(F.col("_a"), "scale_ambiguous").when(s.isNull(), "scale_not_checkable").when(m != s, "scale_disagreement").otherwise("consistent")
    rows = rows.withColumn("reason", reason)
    r = F.col("reason")
    verdict = F.when(r == "consistent", "verified").when(r.isin("null_field", "scale_not_checkable"), "unverified").otherwise("disputed")
    return rows.withColumn("verdict", verdict).withColumn("suspected_value", F.when(r == "scale_disagreement", v * (s / m))).drop("_a")


def note(reason: Column, suspected: Column) -> Column:
    """The sentence shown beside a figure; null for a verified one."""
    sentence = F.element_at(F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv)), reason)
    before, after = LIKELY.split("{}")
    likely = F.when((reason == CORRECTABLE) & suspected.isNotNull(), F.concat(F.lit(before), F.format_number(suspected, 0), F.lit(after))).otherwise("")
    return F.concat(sentence, likely)


def plausible_values(value: Column, suspected: Column) -> Column:
    """What a scale-flagged figure could really be."""
    return F.when(suspected.isNotNull(), F.array(suspected)).otherwise(F.array(value * SCALE_STEP, value / SCALE_STEP))


def guard_values(assessed_rows: DataFrame) -> DataFrame:
    """Distinct magnitudes of each ticker's figures, with neighbours a thousand times off where the scale is suspect; null and zero dropped."""
    v = F.abs(F.col("value"))
    suspect = F.col("reason").isin("scale_ambiguous", "scale_disagreement")
    variants = F.when(suspect, F.array(v, v * 1e3, v / 1e3)).otherwise(F.array(v))
    return assessed_rows.where((F.col("value").isNotNull()) & (F.col("value") != 0)).select("ticker", F.explode(variants).alias("target")).distinct()


def section_health(sections: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Share of its document each section holds, and whether it collapsed below a share."""
    totals = sections.groupBy("doc_id").agg(F.sum("n_chars").alias("total"))
    share = F.when(F.col("total") > 0, F.col("n_chars") / F.col("total"))
    return sections.join(totals, "doc_id").withColumn("share", share).withColumn("collapsed", F.coalesce(share < least_share, F.lit(True)))

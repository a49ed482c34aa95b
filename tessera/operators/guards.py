"""Amounts printed in text, and withholding stored figures, as column expressions.

A text is cut into runs of digits and what stands between them. Whether a run is a number of its own, has a dollar sign or a
scale word, and so looks like money, is judged from the run and its neighbours; no pattern spans an amount. Pieces are put together
again, so every number has a predicate of its own and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MULTIPLIERS
from . import joins

# What stands for a withheld figure, the relative tolerance, and scale words of printed amounts.
PLACEHOLDER, TOLERANCE = "[figure withheld]", 5e-3
WORDS = {"thousand": 1e3, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12}

#: Digits, with groups of three behind commas and a fraction.
RUN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _scale(word: Column) -> Column:
    """What a scale word multiplies by, plural or not; null for other words."""
    known = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, word), F.when(F.endswith(word, F.lit("s")), F.try_element_at(known, F.left(word, F.length(word) - 1))))


def _numbers(run: Column, before: Column, after: Column, is_first: Column, is_last: Column) -> Column:
    """The numbers of one run of digits: text, dollar (characters of its sign in front), scale (characters of its word behind) and readings.

    A number may not begin right behind a letter, an underscore, a full stop or another run, nor have more than three digits before its first
    comma; what follows that comma is then a number by itself. A dollar sign counts if it could begin a number there.
    """
    sign = F.regexp_extract(before, r"\$[\s\x{A0}]?\z", 0)
    gap = F.regexp_extract(after, r"^[\s\x{A0}]?", 0)
    word = F.regexp_extract(F.substr(after, F.length(gap) + 1), r"^[\p{L}\p{M}_]+", 0)
    seen = F.struct(F.substring_index(run, ",", 1).alias("head"), F.contains(run, F.lit(",")).alias("grouped"), F.when(before == "", ~is_first).otherwise(before.rlike(r"[\p{L}\p{M}\p{N}_.]\z")).alias("blocked"), sign.alias("sign"), (F.length(gap)).alias("gap"), word.alias("word"))

    def scaled(x: Column) -> Column:
        ahead = F.left(before, F.length(before) - F.length(x["sign"]))
        signed = (x["sign"] != "") & F.when(ahead == "", is_first).otherwise(~ahead.rlike(r"[\p{L}\p{M}\p{N}_.]\z"))
        ends = is_last | (x["gap"] + F.length(x["word"]) < F.length(after))  # no digit right behind the word
        factor = F.when(ends & (x["word"] != ""), _bound(F.lower(x["word"]), _scale))
        return F.struct(x["head"].alias("head"), x["grouped"].alias("grouped"), x["blocked"].alias("blocked"), F.length(x["sign"]).alias("sign"), signed.alias("signed"), (x["gap"] + F.length(x["word"])).alias("behind"), factor.alias("factor"))

    return _bound(_bound(seen, scaled), lambda x: _told_apart(run, x))


def _told_apart(run: Column, x: Column) -> Column:
    """The numbers of a run by what has been seen of it."""
    head, grouped, blocked, factor = x["head"], x["grouped"], x["blocked"], x["factor"]
    whole = ~blocked & ~(grouped & (F.length(head) > 3))
    rest = F.substr(run, F.length(head) + 2)
    signed, sign = x["signed"], x["sign"]
    tail = F.when(factor.isNotNull(), x["behind"]).otherwise(0)

    def number(text: Column, dollar: Column, last: Column) -> Column:
        own = F.when(last, factor)
        money = dollar | F.contains(text, F.lit(",")) | own.isNotNull()
        readings = _bound(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), lambda v: F.when(own.isNotNull(), F.array(v * own)).otherwise(F.array(*(v * m for m in MULTIPLIERS))))
        return F.struct(text.alias("text"), F.when(dollar, sign).otherwise(0).alias("dollar"), F.when(last, tail).otherwise(0).alias("scale"), money.alias("money"), readings.alias("readings"))

    no, yes = F.lit(False), F.lit(True)
    apart = F.array(number(head, signed, ~grouped), number(rest, no, yes))
    return F.when(whole, F.array(number(run, signed, yes))).when(~grouped, F.filter(F.array(number(run, no, yes)), lambda _: no)).when(blocked, F.slice(apart, 2, 1)).otherwise(apart)


def _runs(text: Column) -> Column:
    """A struct of the runs of digits in a text and what stands between them."""
    return F.struct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"), F.split(text, RUN).alias("gaps"))


def _judged(cut: Column) -> Column:
    """Numbers of each run of a _runs() struct."""
    runs, gaps = cut["runs"], cut["gaps"]
    return F.transform(runs, lambda r, i: _numbers(r, F.get(gaps, i), F.get(gaps, i + 1), i == 0, i + 1 == F.size(runs)))


def amounts(text: Column) -> Column:
    """The numbers printed in a text, in order: text, whether it looks like money, and the values it can mean (at its scale word, or without
    one at every usual scale)."""
    found = _bound(_runs(text), lambda cut: F.flatten(_judged(cut)))
    return F.transform(found, lambda n: F.struct(n["text"].alias("text"), n["money"].alias("money"), n["readings"].alias("readings")))


def _denotes(number: Column, targets: Column, tolerance: float) -> Column:
    return number["money"] & F.exists(number["readings"], lambda v: F.exists(targets, lambda t: F.abs(v - t) <= t * tolerance))


def withheld(text: Column, targets: Column, tolerance: float = TOLERANCE) -> Column:
    """A struct of the text without amounts that denote a target at any reading, and the number of amounts withheld. Without targets the text stays."""
    wanted = F.coalesce(targets.cast("array<double>"), F.array().cast("array<double>"))

    def cut_out(cut: Column) -> Column:
        marked = F.transform(_judged(cut), lambda numbers: F.transform(numbers, lambda n: F.struct(n.alias("n"), F.coalesce(_denotes(n, wanted, tolerance), F.lit(False)).alias("hit"))))
        return _bound(marked, lambda judged: _rebuilt(cut["runs"], cut["gaps"], judged))

    return _bound(_runs(text), cut_out)


def _rebuilt(runs: Column, gaps: Column, judged: Column) -> Column:
    """The text again, with a placeholder for each number that is hit (its sign and scale word go with it)."""

    def lost(numbers: Column, part: str) -> Column:
        return F.coalesce(F.array_max(F.transform(numbers, lambda x: F.when(x["hit"], x["n"][part]).otherwise(0))), F.lit(0))

    def shown(run: Column, numbers: Column) -> Column:
        said = F.array_join(F.transform(numbers, lambda x: F.when(x["hit"], F.lit(PLACEHOLDER)).otherwise(x["n"]["text"])), ",")
        left = F.length(run) - F.length(F.array_join(F.transform(numbers, lambda x: x["n"]["text"]), ","))  # a head that is no number
        return F.when(F.size(numbers) == 0, run).otherwise(F.concat(F.left(run, left), said))

    def gap(g: Column, i: Column) -> Column:
        front = F.when(i > 0, lost(F.get(judged, i - 1), "scale")).otherwise(0)
        back = F.when(i < F.size(runs), lost(F.get(judged, i), "dollar")).otherwise(0)
        return F.substr(g, front + 1, F.length(g) - front - back)

    pieces = F.transform(gaps, lambda g, i: F.concat(gap(g, i), F.when(i < F.size(runs), shown(F.get(runs, i), F.get(judged, i))).otherwise("")))
    hits = F.aggregate(judged, F.lit(0), lambda n, numbers: n + F.size(F.filter(numbers, lambda x: x["hit"])))
    return F.struct(F.array_join(pieces, "").alias("text"), F.coalesce(hits, F.lit(0)).alias("withheld"))


def masked(rows: DataFrame, targets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """rows with their text masked by the figures of their key (targets: key, targets array) and the number withheld; a key without figures keeps its text."""
    joined = rows.join(targets.select(key, "targets"), key, "left").withColumn("_w", withheld(F.col(text), F.col("targets")))
    return joined.withColumn(text, F.col("_w.text")).withColumn("withheld", F.coalesce("_w.withheld", F.lit(0))).drop("_w", "targets")


def printed_figures(rows: DataFrame, targets: DataFrame, key: str, text: str = "text", tolerance: float = TOLERANCE, money: bool = True) -> DataFrame:
    """Each number of a text (place, from 0, and said) with each stored figure of its key (targets: key, target) that one of its readings is near to.

    Where masked() compares a text's numbers with a short list inside the row, this is a join for any number of figures a key: by
    buckets (joins.band_join). money: only numbers that look like money. A null text has no numbers; a repeated target counts once.
    """
    each = rows.select(*rows.columns, F.posexplode(amounts(F.col(text))).alias("place", "_a")).drop(text)
    if money:
        each = each.where("_a.money")
    read = each.select(*(c for c in each.columns if c != "_a"), F.col("_a.text").alias("said"), F.explode("_a.readings").alias("reading"))
    return joins.band_join(read, targets.select(key, "target").distinct(), [key], "reading", "target", tolerance)

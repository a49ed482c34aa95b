"""Sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, unspaced
from . import joins

COVER_CHARS, STATEMENT_FLOOR, TOKEN_BUDGET = 12_000, 26_136, 120_000
SECTION_ORDER = ("1A", "7", "1", "7A")
LEAST_TOKENS, LEAST_CHUNK = 200, 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def cover(text: Column, n: int = COVER_CHARS) -> Column:
    return F.substring(text, 1, n)


def statement_slice(statements: Column, full: Column, tokens: Column, floor: int = STATEMENT_FLOOR, budget: int = TOKEN_BUDGET) -> Column:
    """The statements if long enough and within budget, else the full text, with the gate that failed."""
    source = F.when(statements.isNull(), "full_text_no_statements").when(F.length(statements) < floor, "full_text_below_floor").when(tokens > budget, "full_text_over_budget").otherwise("statements")
    return F.struct(F.when(source == "statements", statements).otherwise(full).alias("text"), source.alias("section_source"))


def accepted_sections(sections: DataFrame, order: tuple[str, ...] = SECTION_ORDER, least_tokens: int = LEAST_TOKENS, probe: int = 400, least: int = 800) -> DataFrame:
    """Sections in order of priority, without those too short or overlapping one accepted before.

    sections: doc_id, section, text, n_tokens. Acceptance depends on earlier acceptances, but there are only as many
    steps as labels, so the rule is unrolled over one row a document.
    """
    pick = sections.groupBy("doc_id").agg(*(F.max(F.when(F.col("section") == s, F.struct("text", "n_tokens"))).alias(f"s{i}") for i, s in enumerate(order)))
    for i, _ in enumerate(order):
        own = F.col(f"s{i}")
        clash = F.lit(False)
        for j in range(i):
            clash = clash | (F.col(f"ok{j}") & joins.overlaps(F.col(f"u{j}"), unspaced(own["text"]), probe, least))
        pick = pick.withColumn(f"u{i}", unspaced(own["text"])).withColumn(f"ok{i}", F.coalesce(own.isNotNull() & (own["n_tokens"] >= least_tokens) & ~F.coalesce(clash, F.lit(False)), F.lit(False)))
    out = F.filter(F.array(*(F.when(F.col(f"ok{i}"), F.struct(F.lit(s).alias("section"), F.lit(i).alias("priority"))) for i, s in enumerate(order))), lambda x: x.isNotNull())
    return pick.select("doc_id", F.explode(out).alias("x")).select("doc_id", "x.section", "x.priority")


def line_chunks(docs: DataFrame, least: int = LEAST_CHUNK) -> DataFrame:
    """Line pieces with their number in the unfiltered order; short ones dropped, so numbers may have gaps."""
    pieces = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return pieces.where(F.length(F.trim("text")) >= least)


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def recursive_pieces(text: Column, size: int, overlap: int, length=word_count, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces of a text of at most `size`, cut at the coarsest separator that serves; neighbours share up to `overlap`.

    A text is cut before each of the first separator. What is shorter than `size` is gathered up to `size`, in a fold whose state is the piece in the
    making; a new piece begins with as much of the last one's end as fits the overlap. What is longer, or has no such separator, is cut at the next one; at the
    last one it stays whole. Pieces lose white space at their ends; empty ones are left out. A null text has null pieces.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is shorter than a piece")
    part = "array<struct<text: string, n: int>>"

    def stripped(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)\s+\z", "")

    def piece(window: Column) -> Column:
        return F.filter(F.array(stripped(F.array_join(F.transform(window, lambda w: w["text"]), ""))), lambda t: t != "")

    def end_of(window: Column, total: Column, most: Column) -> Column:
        """The longest end of a window of at most `most`, and its length."""

        def step(state: Column, w: Column) -> Column:
            long = state["total"] > most
            return F.struct(F.when(long, state["window"]).otherwise(F.array_append(state["window"], w)).alias("window"), F.when(long, state["total"] - w["n"]).otherwise(state["total"]).alias("total"))

        return F.aggregate(window, F.struct(F.array().cast(part).alias("window"), total.alias("total")), step)

    def cut(t: Column, separator: str) -> Column:
        if not separator:
            return F.split(t, "")
        quoted = "".join(f"\\x{{{ord(c):x}}}" for c in separator)
        return F.transform(F.split(t, quoted), lambda p, i: F.when(i > 0, F.concat(F.lit(separator), p)).otherwise(p))

    def level(t: Column, k: int) -> Column:
        parts = F.transform(F.filter(cut(t, separators[k]), lambda p: p != ""), lambda p: F.struct(p.alias("text"), length(p).cast("int").alias("n")))

        def state(out: Column, window: Column, total: Column) -> Column:
            return F.struct(out.alias("out"), window.alias("window"), total.cast("int").alias("total"))

        def step(s: Column, p: Column) -> Column:
            finer = level(p["text"], k + 1) if k + 1 < len(separators) else F.array(p["text"])
            done = F.concat(s["out"], piece(s["window"]))
            over = _bound(end_of(s["window"], s["total"], F.least(F.lit(overlap), size - p["n"])), lambda e: state(done, F.array_append(e["window"], p), e["total"] + p["n"]))
            long = p["n"] >= size if k + 1 == len(separators) or not separators[k] else (p["n"] >= size) | ~F.contains(t, F.lit(separators[k]))
            return F.when(long, state(F.concat(done, finer), F.array().cast(part), F.lit(0))).when(s["total"] + p["n"] > size, over).otherwise(state(s["out"], F.array_append(s["window"], p), s["total"] + p["n"]))

        return F.aggregate(parts, state(F.array().cast("array<string>"), F.array().cast(part), F.lit(0)), step, lambda s: F.concat(s["out"], piece(s["window"])))

    return level(text, 0)


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, words: bool = True, least: int = LEAST_CHUNK) -> DataFrame:
    """doc_id, chunk_index, text by recursive splitting; length in words unless told otherwise (no token data offline). Numbers count short pieces too, which are then dropped."""
    pieces = recursive_pieces(F.col("text"), size, overlap, word_count if words else F.length)
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_index", "text")).where(F.length(F.trim("text")) >= least)


def with_ids(chunks: DataFrame, cik: Column, year: Column, section: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(cik, year, section, F.col("chunk_index"), F.col("text")))


def inventory(chunks: DataFrame, policy: dict[str, tuple[str, ...]]) -> DataFrame:
    """Eligible chunks of each (ticker, intent), and whether it can be answered. The policy is a fixed table, so it is an expression."""
    wanted = F.array(*(F.struct(F.lit(i).alias("intent"), F.array(*map(F.lit, s)).alias("sections")) for i, s in sorted(policy.items())))
    n = chunks.groupBy("ticker", "section").agg(F.count("*").alias("n")).select("ticker", "section", "n", F.explode(wanted).alias("w"))
    counted = n.groupBy("ticker", F.col("w.intent").alias("intent")).agg(F.sum(F.when(F.array_contains("w.sections", F.col("section")), F.col("n")).otherwise(0)).alias("eligible"))
    return counted.withColumn("status", F.when(F.col("eligible") > 0, "answerable").otherwise("section_absent"))


def headings_carried(rows: DataFrame, group: str, order: str, heading: Column) -> DataFrame:
    """The heading in force at the start of each row: the last one before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("heading_before", F.last(heading, ignorenulls=True).over(w))


def size_distribution(rows: DataFrame, group: str, size: str, low: int, high: int) -> DataFrame:
    """Least, upper median, greatest size, and counts under and over limits. Sizes are first counted, so a group's values stay few."""
    counts = rows.groupBy(group, size).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(size)
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    half = F.floor(F.col("total") / 2) + 1
    return c.groupBy(group).agg(F.min(size).alias("least"), F.min(F.when(F.col("upto") >= half, F.col(size))).alias("upper_median"), F.max(size).alias("greatest"), F.sum(F.when(F.col(size) < low, F.col("n")).otherwise(0)).alias("n_under"), F.sum(F.when(F.col(size) > high, F.col("n")).otherwise(0)).alias("n_over"))

"""Joins by containment, tolerance and multiplicity, and comparisons that keep direction."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_matches(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, name) pairs where all tokens of the mention are among the name's.

    The set containment becomes an equi-join on one token (the mention's rarest among the names),
    then a check of the rest; a mention without tokens matches nothing.
    What grows with the names is shuffled: by the size of its files Spark would send it to every task by way of the driver.
    """
    tokens = names.select("name_id", F.explode("tokens").alias("token")).distinct()
    rarity = tokens.groupBy("token").agg(F.count("*").alias("n"))
    asked = mentions.where(F.size("tokens") > 0).select("mention_id", F.col("tokens").alias("wanted"), F.explode("tokens").alias("token"))
    probe = asked.join(rarity.hint("merge"), "token", "left").groupBy("mention_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("wanted").alias("wanted"))
    found = probe.join(tokens.hint("merge"), "token").join(names.select("name_id", "tokens").hint("merge"), "name_id")
    return found.where(F.size(F.array_except("wanted", "tokens")) == 0).select("mention_id", "name_id")


#: Inner words of a passage that must occur in a row, letters of a gram, the rarest grams of a passage that are looked up, and bits of a map at most.
RUN_WORDS, GRAM, RAREST, MOST_BITS = 3, 3, 2, 1 << 24

#: Short passages that every text is simply searched for: at most so many, of so many letters in all.
FEW, FEW_LETTERS = 2048, 1 << 16


def _mapped(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test whether a hashed key may be among these (about n of them): a bit map of sixteen bits a key, MOST_BITS at most.

    The bits are set by an aggregate; its rows (one for 64 bits) are what comes to the driver. More keys than fit make the test let
    more through, no less.
    """
    size = min(MOST_BITS, max(64, 1 << (16 * n - 1).bit_length()))
    at = F.pmod(F.col("_key"), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = [0] * (size // 64)
    for word, bits in keys.groupBy(F.floor(at / 64).cast("int")).agg(F.bit_or(bit)).collect():  # at most MOST_BITS / 64
        words[word] = bits
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")

    def let_through(h: Column) -> Column:
        own = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.get(held, F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int")).bitwiseAND(own) != 0

    return let_through


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def contained_passages(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, text_id) where a passage occurs in a text as it stands, case and white space included; its ends may cut words.

    All words of a passage but its first and last are whole words of a text that holds it, so up to RUN_WORDS of them in a row are its
    key: the longest such run, as the likeliest to be rare. A passage of fewer than three words has no word that must be whole; its
    keys are its rarest grams of three letters (short_passages). Texts keep the keys that a bit map of all the passages' lets through, an
    equi-join finds the candidates, and the exact test is left to them. A null passage or text matches nothing, an empty passage every text.
    While the plan is built, the passages are counted by length of their keys and their keys mapped.
    """
    run = lambda w, i, n: F.xxhash64(*(F.get(w, i + j) for j in range(n)), F.lit(n))
    p = passages.where(F.col("passage").isNotNull()).withColumn("_w", _words(F.col("passage"))).withColumn("_n", F.least(F.size("_w") - 2, F.lit(RUN_WORDS)))
    counts = {max(0, n): k for n, k in p.groupBy(F.greatest("_n", F.lit(0))).count().collect()}  # at most RUN_WORDS + 1 rows
    found = []
    if counts.get(0):
        found.append(short_passages(p.where("_n <= 0").select("passage_id", "passage"), texts))
    lengths = sorted(n for n in counts if n)
    if lengths:
        p = p.where("_n > 0")
        starts = F.sequence(F.lit(1), F.size("_w") - 1 - F.col("_n"))  # from the second word on
        longest = F.array_max(F.transform(starts, lambda i: F.struct(F.length(F.array_join(F.slice("_w", i + 1, F.col("_n")), "")).alias("size"), (-i).alias("i"))))
        p = p.withColumn("_i", -longest["i"])
        key = F.lit(None).cast("long")
        for n in range(1, RUN_WORDS + 1):
            key = F.when(F.col("_n") == n, run(F.col("_w"), F.col("_i"), n)).otherwise(key)
        p = p.select("passage_id", key.alias("_key"))
        may = _mapped(p, sum(counts[n] for n in lengths))
        runs_of = lambda n: F.transform("_w", lambda _, i: run(F.col("_w"), i, n))
        runs = F.filter(F.flatten(F.array(*map(runs_of, lengths))), may)
        keys = texts.withColumn("_w", _words(F.col("text"))).select("text_id", F.explode(F.array_distinct(runs)).alias("_key"))
        found.append(_tested(keys.join(p, "_key").select("passage_id", "text_id").distinct(), passages, texts))
    return reduce(DataFrame.unionByName, found) if found else passages.select("passage_id").join(texts.select("text_id"), F.lit(False))


def _tested(candidates: DataFrame, passages: DataFrame, texts: DataFrame) -> DataFrame:
    both = candidates.join(passages, "passage_id").join(texts, "text_id")
    return both.where(F.contains(F.col("text"), F.col("passage"))).select("passage_id", "text_id")


def grams(text: Column, n: int = GRAM) -> Column:
    """Hashes of the distinct stretches of n letters of a text."""
    letters = F.split(text, "")  # by place at no cost, as a text's letters are not
    letters = F.filter(letters, lambda c: c != "")
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(n)), F.lit(n)))
    return F.get(F.transform(F.array(letters), lambda c: F.when(F.size(c) >= n, F.array_distinct(each(c))).otherwise(F.array().cast("array<long>"))), 0)


def short_passages(passages: DataFrame, texts: DataFrame, rarest: int = RAREST, few: int = FEW) -> DataFrame:
    """contained_passages of few words: a few passages are looked for in each text as it is read, more go by postings of grams.

    A short passage is in a good part of the texts, so its postings and candidates are as many rows as there are pairs, and a candidate brings its text
    along; a text that meets a short list of passages gives nothing but its matches.
    """
    said = passages.where(F.col("passage").isNotNull())
    distinct = said.select("passage").distinct()
    n, letters = said.agg(F.count("*"), F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()
    if n > few or letters > FEW_LETTERS:
        return _by_grams(passages, texts, rarest)
    listed = [r.passage for r in distinct.collect()]  # at most FEW
    if not listed:
        return said.select("passage_id").join(texts.select("text_id"), F.lit(False))
    found = texts.select("text_id", F.explode(F.filter(F.array(*map(F.lit, listed)), lambda p: F.contains(F.col("text"), p))).alias("passage"))
    return found.join(F.broadcast(said), "passage").select("passage_id", "text_id")


def _by_grams(passages: DataFrame, texts: DataFrame, rarest: int) -> DataFrame:
    """short_passages by postings of grams: texts that hold the `rarest` grams of a passage that fewest texts hold are candidates.

    A passage of fewer than GRAM letters is one gram of its own length, the empty one a gram that every text has. Texts give their
    distinct grams that some passage has; how many texts hold each is counted from these postings.
    """
    n = F.least(F.length("passage"), F.lit(GRAM))
    own = F.when(n == 0, F.array(F.xxhash64(F.lit(0))))
    for k in range(1, GRAM + 1):
        own = own.when(n == k, grams(F.col("passage"), k))
    held = passages.select("passage_id", n.alias("_n"), F.explode(own).alias("_key"))
    lengths = {r[0]: r[1] for r in held.groupBy("_n").count().collect()}  # at most GRAM + 1 rows
    if not lengths:
        return passages.select("passage_id").join(texts.select("text_id"), F.lit(False))
    may = _mapped(held, sum(lengths.values()))
    given = F.flatten(F.array(*(grams(F.col("text"), k) if k else F.array(F.xxhash64(F.lit(0))) for k in sorted(lengths))))
    postings = texts.where(F.col("text").isNotNull()).select("text_id", F.explode(F.filter(given, may)).alias("_key"))
    spread = postings.groupBy("_key").agg(F.count("*").alias("_texts"))
    nth = F.row_number().over(Window.partitionBy("passage_id").orderBy(F.coalesce("_texts", F.lit(0)), "_key"))
    keys = held.select("passage_id", "_key").join(spread, "_key", "left").withColumn("_nth", nth).where(F.col("_nth") <= rarest)
    asked = keys.withColumn("_asked", F.count("*").over(Window.partitionBy("passage_id"))).select("passage_id", "_key", "_asked")
    both = asked.join(postings.distinct(), "_key").groupBy("passage_id", "text_id").agg(F.count("*").alias("_hits"), F.first("_asked").alias("_asked"))
    return _tested(both.where("_hits = _asked").select("passage_id", "text_id"), passages, texts)


def middle_slice(inner: Column, length: int) -> Column:
    """`length` characters from the middle of a text."""
    return F.substr(inner, F.floor(F.length(inner) / 2).cast("int") + 1, F.lit(length))


def overlaps(a: Column, b: Column, probe: int = 400, least: int = 800) -> Column:
    """Whether the middle of the shorter text occurs in the longer one; short texts never overlap."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(shorter) >= least) & F.contains(longer, middle_slice(shorter, probe))


def within(reading: Column, target: Column, tolerance: float) -> Column:
    return F.abs(reading - target) <= tolerance * target


def band_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, target: str, tolerance: float) -> DataFrame:
    """Rows of both sides with equal keys whose value lies within `tolerance` (relative) of the target: an equi-join by logarithmic buckets.

    A bucket is wider than the band on either side of a target, so a value near a target is in its bucket or in one beside it:
    the right side has a row for each of the three, the left side one, so that each pair meets once; then the exact test. A hot key is many
    buckets, and a bucket that is hot still is a join's skewed partition, which adaptive execution splits. Zero equals zero alone;
    null keys and values, and numbers below zero or not finite, match nothing, as within() has it.
    """
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance is between 0 and 1")
    width = -1.01 * math.log1p(-tolerance)

    def bucket(v: Column) -> Column:
        return F.when(v > 0, F.floor(F.ln(v) / width)).when(v == 0, F.lit(None).cast("long"))

    finite = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) < math.inf)
    zero = F.lit(-(1 << 62)).cast("long")
    l = left.where(finite(value)).withColumn("_bucket", F.coalesce(bucket(F.col(value)), zero))  # noqa: E741
    at = bucket(F.col(target))
    r = right.where(finite(target)).withColumn("_bucket", F.explode(F.when(at.isNull(), F.array(zero)).otherwise(F.array(at - 1, at, at + 1))))
    return l.join(r, [*keys, "_bucket"]).where(within(F.col(value), F.col(target), tolerance)).drop("_bucket")


def cited(claims: DataFrame, blocks: DataFrame, answer: tuple[str, ...] = ()) -> DataFrame:
    """Claims with their valid citations in order of first mention, and the number that name no block.

    claims: claim_id, cites array<int>, the columns of `answer`; blocks: those and rank. Ranks are local to an answer, so many answers are
    checked at once, each against its own blocks; without such columns all claims are of one answer. Claims without a valid citation are
    dropped by the caller; a claim that cites nothing has no row.
    """
    each = claims.select(*answer, "claim_id", F.posexplode(F.array_distinct("cites")).alias("pos", "rank"))
    joined = each.join(blocks.select(*answer, "rank").distinct().withColumn("_held", F.lit(True)), [*answer, "rank"], "left")
    return joined.groupBy(*answer, "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_held"), F.struct("pos", "rank")))), lambda s: s["rank"]).alias("valid"), F.count_if(F.col("_held").isNull()).alias("invalid"))


def aligned(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str, how: str = "left") -> DataFrame:
    """Multiset alignment: the nth row of a key on one side meets the nth on the other, each once."""
    l = left.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order_left)))  # noqa: E741
    r = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order_right)))
    return l.join(r, [key, "_n"], how).withColumnRenamed("_n", "nth")


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full comparison of a value by key: same (null equals null), different, only_left, only_right."""
    l = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))  # noqa: E741
    r = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.equal_null(F.col("left_value"), F.col("right_value")), "same").otherwise("different")
    return l.join(r, keys, "full").withColumn("status", status).drop("_l", "_r")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(key), key, "left_anti")


def outcomes_of(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every task with its outcome; a missing one is a failure, never dropped."""
    return tasks.join(outcomes, "task_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))

"""Band joins, passages, and comparisons, on rows with nulls, ties, repeats and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import guards, joins


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(rng, n):
    sizes = [0.0, 1e-9, 1.0, 3.5, 100.0, 1e6, 9.99e8, 1e9, 1e12]
    return [(rng.choice(["a", "b", None]), i, rng.choice([*sizes, None, -5.0, math.nan, math.inf]) if rng.random() < 0.4 else rng.choice(sizes) * rng.uniform(0.98, 1.02)) for i in range(n)]


@pytest.mark.parametrize("tolerance", [5e-3, 0.3, 0.9])
def test_band_join_equals_all_pairs(spark, tolerance):
    rng = random.Random(2)
    left, right = pairs(rng, 300), pairs(rng, 200)
    l = spark.createDataFrame(left, "key string, i int, value double")  # noqa: E741
    r = spark.createDataFrame(right, "key string, j int, target double")
    out = joins.band_join(l, r, ["key"], "value", "target", tolerance)
    got = sorted((x.i, x.j) for x in out.collect())
    ok = lambda v, t: v is not None and t is not None and math.isfinite(v) and math.isfinite(t) and abs(v - t) <= tolerance * t
    assert got == sorted((i, j) for a, i, v in left for b, j, t in right if a == b and a is not None and ok(v, t))
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    assert joins.band_join(l.limit(0), r, ["key"], "value", "target", tolerance).count() == 0
    with pytest.raises(ValueError):
        joins.band_join(l, r, ["key"], "value", "target", 0)


def test_numbers_are_judged_by_what_stands_around_them(spark):
    said = {
        "$5": [("5", True)], "a$5": [("5", False)], "FY2021": [], "x1,234": [("234", False)], "1,234.5 mn": [("1,234.5", True)], "5000,234": [("5000", False), ("234", False)],
        "3 millions and 4 millionaires": [("3", True), ("4", False)], "7 bn8": [("7", False)], "1.2.3": [("1.2", False)], "$ 1,2": [("1", True), ("2", False)], "": [], "no": [],
    }
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = rows.select("i", guards.amounts(F.col("t")).alias("a")).orderBy("i").collect()
    assert [[(x["text"], x["money"]) for x in r.a] for r in got] == list(said.values())
    assert rows.select(guards.amounts(F.lit(None).cast("string")).alias("a")).first().a is None
    one = rows.limit(1).select(guards.amounts(F.lit("$2 thousand, 3,000")).alias("a")).first().a
    assert [x["readings"] for x in one] == [[2000.0], [3e3, 3e6, 3e9, 3e12]]


def test_printed_figures_and_masks_agree(spark):
    rows = spark.createDataFrame([(1, "T", "Sales $5.0 billion, costs 4,999 and 5,000"), (2, "U", "Sales $5.0 billion"), (3, "T", None), (4, None, "$5.0 billion"), (5, "T", "none")], "id int, ticker string, text string")
    targets = spark.createDataFrame([("T", 5e9), ("T", 5e9), ("T", 1.0), (None, 5e9)], "ticker string, target double")
    found = sorted((r.id, r.place, r.said, r.target) for r in guards.printed_figures(rows, targets, "ticker").collect())
    assert found == [(1, 0, "5.0", 5e9), (1, 1, "4,999", 5e9), (1, 2, "5,000", 5e9)]
    masked = guards.masked(rows, targets.where("ticker IS NOT NULL").groupBy("ticker").agg(F.collect_list("target").alias("targets")), "ticker").orderBy("id").collect()
    w = guards.PLACEHOLDER
    assert [(r.text, r.withheld) for r in masked] == [(f"Sales {w}, costs {w} and {w}", 3), ("Sales $5.0 billion", 0), (None, 0), ("$5.0 billion", 0), ("none", 0)]


def contained(passages, texts):
    return sorted((i, j) for i, p in passages for j, t in texts if p is not None and t is not None and p in t)


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_passages_of_any_length_match_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(joins, "MOST_BITS", bits)  # a full map lets everything through
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    texts = [(i, "".join(word() + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (3, "abab abab"), (62, "é")]
    passages = [(i, t[a : a + rng.randint(0, 25)]) for i, (_, t) in enumerate(texts) if t for a in [rng.randint(0, len(t) - 1)]] + [(100, "zzz"), (101, None), (102, ""), (103, "ab"), (104, " "), (105, "a b c d e f"), (106, "ab"), (107, "  ")]
    p, t = spark.createDataFrame(passages, "passage_id int, passage string"), spark.createDataFrame(texts, "text_id int, text string")
    out = joins.contained_passages(p, t)
    assert sorted(set(map(tuple, out.collect()))) == sorted(set(contained(passages, texts)))
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    assert joins.contained_passages(p.limit(0), t).count() == 0 and joins.contained_passages(p, t.limit(0)).count() == 0


def test_name_matches_ask_for_every_token(spark):
    m = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, ["z"]), (5, ["a", "a"]), (6, None)], "mention_id int, tokens array<string>")
    n = spark.createDataFrame([(10, ["a", "b", "c"]), (11, ["b"]), (12, ["a"]), (13, [])], "name_id int, tokens array<string>")
    assert sorted(map(tuple, joins.name_matches(m, n).collect())) == [(1, 10), (1, 12), (2, 10), (5, 10), (5, 12)]


def test_alignment_comparison_and_orphans(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 1)], "k string, l int")
    b = spark.createDataFrame([("x", 7), ("z", 1)], "k string, r int")
    assert sorted(map(tuple, joins.aligned(a, b, "k", "l", "r").collect()), key=repr) == sorted([("x", 1, 1, 7), ("x", 2, 2, None), ("y", 1, 1, None), (None, 1, 1, None)], key=repr)
    one = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    two = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (5, "e")], "k int, v string")
    assert {r.k: r.status for r in joins.compared(one, two, ["k"], "v").collect()} == {1: "same", 2: "same", 3: "different", 4: "only_left", 5: "only_right"}
    assert [r.k for r in joins.orphans(one, two, "k").collect()] == [4]
    assert joins.compared(one.limit(0), two.limit(0), ["k"], "v").count() == 0


def test_claims_lose_references_alone(spark):
    said = ["Grew (passage 1, 2).", "In (2021)", "Cut [3] , and (block 4 and 5) more", "(sources 1-2)", "keep (10%) ( 1) (1 ) [passage 1] (1,,2)", None, "x (1)(2) y"]
    want = ["Grew.", "In (2021)", "Cut, and more", "", "keep (10%) ( 1) (1 ) [passage 1] (1,,2)", None, "x y"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", X.clean_claim(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == want


def test_short_passages_agree_by_both_ways(spark):
    passages = spark.createDataFrame([(1, "be"), (2, "be ta"), (3, ""), (4, None), (5, "be"), (6, "x%_"), (7, "A")], "passage_id int, passage string")
    texts = spark.createDataFrame([(1, "alpha be tango"), (2, None), (3, ""), (4, "x%_ A")], "text_id int, text string")
    by_grams, plain = (sorted(map(tuple, joins.short_passages(passages, texts, few=n).collect())) for n in (0, 100))
    assert by_grams == plain == [(1, 1), (2, 1), (3, 1), (3, 3), (3, 4), (5, 1), (6, 4), (7, 4)]

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic
from tests.llm.conftest import awkward_rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, min_exp=4, least=6):
    """Runs of a list of words by walking every lag; the words that no run repeats."""
    runs = {}
    for q in range(1, len(w) // min_exp + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, min_exp * q):
                runs.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    found = sorted((s, q, n) for (s, n), q in runs.items())
    dropped = {i for s, q, n in found for i in range(s + q, s + n)}
    return [(s, n, q) for s, q, n in found], " ".join(x for i, x in enumerate(w) if i not in dropped)


def periodic_rows():
    rng, rows = random.Random(3), []
    for i in range(60):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            q, at = rng.randint(1, 20), rng.randint(0, len(w))
            unit = [rng.choice(["x", "y", "zz"]) for _ in range(q)]
            w[at:at] = (unit * 7)[: int(q * rng.uniform(2, 7))]
        rows.append((i, " ".join(w)))
    rows += [(100, " ".join("ab" * 400)), (101, "same " * 700), (102, " ".join("aabaab" * 90)), (103, "one\ttwo\n" * 4), (None, "k " * 9), (None, "k " * 9), (104, None), (104, ""), (105, "é ß " * 8)]
    return rows


def found(df):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in df.collect()), key=repr)


def wanted(rows, **how):
    return sorted(((i, len(words_of(t)), *brute(words_of(t), **how)) for i, t in rows), key=repr)


@pytest.mark.parametrize("dealt", [{}, {"whole": 200, "lags": 7}])
def test_runs_match_brute_force(spark, dealt):
    rows = periodic_rows()
    assert found(periodic.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), **dealt)) == wanted(rows)


@pytest.mark.parametrize(("min_exp", "least"), [(2, 2), (3, 9)])
def test_other_exponents(spark, min_exp, least):
    rows = periodic_rows()
    assert found(periodic.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), min_exp=min_exp, least=least)) == wanted(rows, min_exp=min_exp, least=least)


def test_awkward_rows_and_empty_tables(spark, awkward, empty):
    assert found(periodic.periodic_runs(awkward)) == wanted([(r[0], r[1]) for r in awkward_rows()])
    assert periodic.periodic_runs(empty).count() == 0 and periodic.digests(periodic.periodic_runs(periodic.echoed(empty))).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(1)
    w = [str(rng.randint(0, 9)) for _ in range(40_000)] + ["a", "b", "c"] * 5000 + [str(rng.randint(0, 10**6)) for _ in range(30_000)] * 4
    (r,) = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string"), whole=100_000, lags=9_000).collect()
    top = max(r.runs, key=lambda x: x["length"])
    assert r.n_words == len(w) and (top["period"], top["length"]) == (30_000, 120_000) and any((x["period"], x["length"]) == (3, 15_000) for x in r.runs)


def test_echoed_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b"), (7, None)]
    got = {(r.doc_id, i): r.text for i, r in enumerate(periodic.echoed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect())}
    for k, (i, t) in enumerate(rows):
        w, h = words_of(t), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))])
        assert got[i, k] == t


def test_digest_of_no_runs(spark):
    r = periodic.digests(periodic.periodic_runs(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"))).orderBy("doc_id").collect()
    assert [tuple(x)[1:6] for x in r] == [(0, None, None, None, None)] * 2
    empty = spark.range(1).select(F.sha2(F.lit(""), 256).alias("h")).first().h
    assert r[1].collapsed_sha256 == empty and r[0].runs_sha256 == empty

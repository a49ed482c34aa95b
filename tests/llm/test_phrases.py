import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exchange, parts, phrases
from tessera.llm.arrowtext import Texts
from tests.llm.conftest import awkward_rows

SCHEMA = "doc_id bigint, text string, lang string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lower) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, top=2000, longest=5):
    """Collocations of (lang, text) rows by counting everything."""
    out = []
    for lang in sorted({k or "und" for k, _ in rows}):
        f, n = Counter(), 0
        for k, t in rows:
            if (k or "und") == lang:
                for w in pieces(t):
                    n += len(w)
                    f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least or any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in f.items() if b >= least):
                continue
            score, _, l, r = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


def some_rows(n=120, seed=5):
    rng, rows = random.Random(seed), []
    words = [f"{c}{d}" for c in "abcdé" for d in ("", "X", "yz")]
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 40)):
            t += rng.choice(words[: rng.randint(2, len(words))]) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "; "])
            if rng.random() < 0.1:
                t += "The quick Brown fox jumps over "
        rows.append((rng.choice([i, i, None, 3]), t, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(9, None, "en"), (10, "", "fr"), (11, "a b", "only"), *rows[:5]]


def found(spark, rows, **how):
    return [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), **how).orderBy("lang", "rank").collect()]


@pytest.mark.parametrize("how", [{"least": 2}, {"least": 10}, {"least": 6, "top": 3}, {"least": 4, "longest": 3}, {"least": 3, "salt_at": 5}])
def test_collocations_match_brute_force(spark, how):
    rows = some_rows()
    want = brute([(k, t) for _, t, k in rows], **{k: v for k, v in how.items() if k != "salt_at"})
    got = found(spark, rows, **how)
    assert got == want and len(got) > 5


def test_many_parts_and_salted_pivots(spark, monkeypatch):
    monkeypatch.setattr(parts, "LEAST_PART", 500)
    monkeypatch.setattr(phrases, "PART_BYTES", 600)
    rows = some_rows(80, 6)
    assert found(spark, rows, least=5, salt_at=7) == brute([(k, t) for _, t, k in rows], 5)


def test_rare_phrases_of_frequent_pivots_stay_in_their_bucket():
    """Every step in this process: what buckets hand on are frequent phrases alone, each once, also where one word's fragments go to many buckets."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(60)) for _ in range(9)]
    tables = [pa.table({"text": texts[p::3], "carry_0": ["en"] * 3}) for p in range(3)]
    key = lambda p: (pa.scalar(p),)

    def grouped(found):
        rows = [r for t in found for r in t.to_pylist()]
        return {to: exchange.table([tuple(r.values()) for r in rows if r["to"] == to]) for to in {r["to"] for r in rows}}

    words = grouped(phrases._counts(4)(key(p), t) for p, t in enumerate(tables))
    answers = grouped(phrases._frequent(3, 4, 5)(t) for t in words.values())
    sent = grouped(phrases._put(16, 5, 7)(key(p), t, answers[p]) for p, t in enumerate(tables))
    mined = pa.concat_tables([phrases._mined(5, 5)(t) for t in sent.values()])
    f = Counter(tuple(w[i : i + m]) for w in map(str.split, texts) for m in range(2, 6) for i in range(len(w) - m + 1))
    assert len(sent) > 8 and len(set(mined["key"].to_pylist())) == mined.num_rows
    assert sorted(mined["n"].to_pylist()) == sorted(n for n in f.values() if n >= 5)


def test_awkward_rows_and_empty_tables(spark, awkward, empty):
    want = brute([(r[2], r[1]) for r in awkward_rows()], 3)
    assert [tuple(r) for r in phrases.collocations(awkward, least=3).orderBy("lang", "rank").collect()] == want
    assert phrases.collocations(empty).count() == 0


def test_every_occurrence_has_one_fragment():
    rng = np.random.default_rng(2)
    for _ in range(50):
        place = rng.integers(-1, 6, 60)
        rank, fresh = rng.permutation(6), rng.random(60) < 0.15
        fresh[0] = True
        piece = np.cumsum(fresh)
        want = Counter((i, i + m) for m in range(2, 6) for i in range(61 - m) if (place[i : i + m] >= 0).all() and piece[i] == piece[i + m - 1])
        at, left, right = phrases.fragments(place, rank, fresh, 5)
        got = Counter((s, e) for a, l, r in zip(at, left, right, strict=True) for s in range(a - l, a + 1) for e in range(a + 1, a + r + 2) if 2 <= e - s <= 5)
        assert got == want


def test_words_with_one_first_hash_stay_apart():
    h1, h2 = np.array([5, 5, 5, 9], np.uint64), np.array([1, 7, 3, 2], np.uint32)
    body = np.vstack([exchange.planes(h1, 8), exchange.planes(h2.astype(np.uint64), 4), *(exchange.planes(np.arange(4, dtype=np.uint64) + 1, k) for k in (6, 6, 1))])
    v = phrases.Vocabulary(exchange.table(exchange.packed(phrases.FREQUENT, np.zeros(4, np.int64), 0, body, 1, 0)))
    assert v.id[v.places(np.array([5, 5, 5, 9], np.uint64), np.array([7, 3, 1, 2], np.uint32))].tolist() == [2, 3, 1, 4]
    assert v.places(np.array([5, 9], np.uint64), np.array([2, 3], np.uint32)).tolist() == [-1, -1]


def test_the_same_word_of_two_languages_is_two_words():
    t, lang = Texts.of(pa.array(["a b a", "a"])), np.array([1, 2], np.uint64)
    s = phrases.Slice(t, lang)
    assert s.h1[0] == s.h1[2] != s.h1[3] and s.h2[0] == s.h2[2] != s.h2[3]

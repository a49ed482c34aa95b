import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tests.llm.conftest import awkward_rows

TEXTS = {
    "en": ["the cat and the dog went to the house", "this is the way that they went there", "and then with the other one"],
    "fr": ["le chat et le chien sont dans la maison", "elle est la avec les autres", "ou sont les enfants de la ville"],
    "xx": ["zzz qqq zqz qzq", "zq qz zz"],
}


def grams(text):
    out, s = Counter(), " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            g = s[i : i + k]
            if g.strip() and " " not in g[1 : k - 1]:
                out[g] += 1
    return out


def ranked(counts, size):
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def brute(learn, texts, size):
    total = {}
    for lang, t in learn:
        if lang is not None and t is not None:
            total.setdefault(lang, Counter()).update(grams(t))
    profile = {k: ranked(v, size) for k, v in total.items() if v}
    out = []
    for t in texts:
        own = ranked(grams(t or ""), size)
        if not own or not profile:
            out.append(("und", 0.0))
            continue
        away, lang = min((sum(abs(i - p[g]) if g in p else size for g, i in own.items()), k) for k, p in profile.items())
        out.append((lang, 1 - away / (len(own) * size)))
    return out


@pytest.mark.parametrize("size", [5, 50, 400])
def test_predictions_match_brute_force(spark, size):
    learn = [(k, t) for k, v in TEXTS.items() for t in v] + [(None, "the the the"), ("en", None), ("yy", "123 .")]
    asked = [t for v in TEXTS.values() for t in v] + [r[1] for r in awkward_rows()] + ["", None, "12 !?", "Ça alors", "a", "ΣΑΣ ﬁ", "a b a b"]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    got = langid.identify(rows, langid.profiles(spark.createDataFrame(learn, "lang string, text string"), size=size), size=size).orderBy("doc_id").collect()
    assert [(r.lang_pred, pytest.approx(r.score)) for r in got] == brute(learn, asked, size)


def test_awkward_and_empty_tables(spark, awkward, empty):
    out = langid.learned_and_judged(awkward).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out is False for r in out if r.doc_id is None)
    assert langid.learned_and_judged(empty).count() == 0
    nothing = langid.identify(awkward, langid.profiles(empty), carry=("lang", "carry_0")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and "carry_1" in nothing[0]


def test_held_out_texts_and_their_labels_teach_nothing(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for _ in range(8) for k, v in TEXTS.items() for t in v)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    wrong = docs.withColumn("lang", F.when(langid.fold(F.col("doc_id")) == 0, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.learned_and_judged(d).collect())) for d in (docs, wrong))
    assert a == b and all(p == k for (_, _, p, _), (_, k, _) in zip(a, rows, strict=True))


def test_too_many_languages_is_an_error(spark):
    learn = spark.createDataFrame([(f"l{i}", "abc") for i in range(5)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        langid.identify(learn.selectExpr("1L AS doc_id", "text"), langid.profiles(learn), most_languages=4)


def test_portions_and_varied_alphabets_count_alike():
    text = "abc déf " * 50 + "".join(map(chr, range(0x4E00, 0x5600))) + " x"
    points, owner = langid.spelled([text, "", text, "ab"])
    whole = langid.counted(points, owner)
    for portion in (7, 1500):
        assert all(np.array_equal(x, y) for x, y in zip(whole, langid.counted(points, owner, portion), strict=True))
    assert int(whole[2][whole[0] == 3].sum()) == sum(grams("ab").values()) and dict(Counter(whole[0].tolist()))[0] == len(grams(text))

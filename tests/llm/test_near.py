import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint, minhash, ranges
from tessera.llm.arrowtext import Texts
from tessera.llm.components import components
from tests.llm.conftest import SCHEMA, awkward_rows


def shingle_counts(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    i = sum((a & b).values())
    u = sum(a.values()) + sum(b.values()) - i
    return i / u if u else 0.0


def brute_classes(rows):
    texts = list(dict.fromkeys(r[1] or "" for r in rows))
    c = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(c[i], c[j]) >= 0.8:
                root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for r in rows:
        if r[0] is not None:
            g = group[r[1] or ""]
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted([(r[0], least.get(group[r[1] or ""])) for r in rows], key=repr)


def family_rows(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for f in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(n // 6):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(80)] = rng.choice(words)
            rows.append((len(rows), " ".join(own), *[None] * 10))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = family_rows()
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "class_id").collect()), key=repr)
    assert got == brute_classes(rows)
    assert 6 < len({c for _, c in got}) < len(rows)


def test_least_text_that_is_a_stranger_loses_no_links(spark, monkeypatch):
    """One row shares every band with all others but is like none: their links are found in the open buckets."""
    rows = family_rows(3)
    whole = minhash.band_hashes(minhash.signatures(pa.array([r[1] for r in rows]), minhash.BANDS * minhash.ROWS), minhash.BANDS, minhash.ROWS)
    rows = [(-1, "a stranger to all of them", *[None] * 10), *rows]
    fingers = [(-1, hashlib.md5(rows[0][1].encode()).hexdigest(), list(range(8)))]
    fingers += [(r[0], hashlib.md5(r[1].encode()).hexdigest(), [*range(8), *h.tolist()[:1]]) for r, h in zip(rows[1:], whole, strict=True)]
    monkeypatch.setattr(minhash, "_fingers", lambda bands, n: _table(fingers))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("doc_id", "class_id").collect()), key=repr)
    assert got == brute_classes(rows)


def _table(fingers):
    def run(batches):
        for b in batches:
            own = {i: (h, x) for i, h, x in fingers}
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array([own[i][1] for i in ids], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "bands"])

    return run


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_recall_on_documents(spark):
    """Every pair of different texts at 0.8 or more, by brute force over shared shingles, against the classes; and no class joins texts that no chain of such pairs does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    counts = {i: shingle_counts(t) for t, i in first.items()}
    by, pairs = {}, Counter()
    for i, c in counts.items():
        for k in c:
            by.setdefault(k, []).append(i)
    near = set()
    for own in by.values():
        pairs.update((a, b) for n, b in enumerate(own) for a in own[:n])
    for a, b in pairs:
        if jaccard(counts[a], counts[b]) >= 0.8:
            near.add((a, b))
    found = sum(got[a] == got[b] for a, b in near)
    assert near and found / len(near) >= 0.9
    root = {i: i for i in counts}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in near:
        root[find(a)] = find(b)
    assert all(find(first[texts[i]]) == find(first[texts[c]]) for i, c in got.items())


def test_awkward_rows_and_keepers(spark, awkward):
    out = minhash.near_duplicates(awkward)
    got = sorted(map(tuple, out.select("doc_id", "class_id").collect()), key=repr)
    assert got == brute_classes(awkward_rows())
    kept = minhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({(r[0], r[1]) for r in out.where("keeper").select("doc_id", "text_hash").collect()}) == out.select("class_id", F.when(F.col("class_id").isNull(), F.col("text_hash")).alias("t")).distinct().count()


def test_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize(("a", "b"), [({1: 3, 2: 5, 3: 1}, {1: 1, 2: 9, 4: 2}), ({1: 1000, 2: 7}, {1: 700, 2: 300}), ({i: 1 for i in range(50)}, {i: 1 for i in range(20, 60)})])
def test_signatures_estimate_weighted_jaccard(a, b):
    m, agree, runs = 256, 0, 12
    for r in range(runs):
        key = lambda x: np.array([hash((k, r)) % (1 << 62) for k in x], np.uint64)
        doc = np.repeat([0, 1], [len(a), len(b)])
        sig = minhash.bag_min_hash(doc, np.concatenate([key(a), key(b)]), np.array([*a.values(), *b.values()]), 2, m)
        agree += (sig[0] == sig[1]).mean() / runs
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs(agree - want) < 4 * (want * (1 - want) / (m * runs)) ** 0.5 + 0.005


def test_signature_of_nothing_is_infinite():
    s = minhash.signatures(pa.array(["", None, "a b"]), 32)
    assert np.isinf(s[:2]).all() and np.isfinite(s[2]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_shingles_of_short_texts_are_the_whole():
    doc, h = minhash.shingles(Texts.of(pa.array(["a b c", "a b c d e f", ""])))
    assert doc.tolist() == [0, 1, 1] and len(set(h.tolist())) == 3


# fingerprints

def test_edits_and_likeness(spark, awkward):
    rows = [r for r in awkward_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fingerprint.compared(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert 0 <= g.near_next <= 1 and (g.near_edited == 1) == (g.fingerprint == g.edited_fingerprint) or edit == t
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[17].near_edited > 0.4


def test_ranges_give_the_same_as_one(spark, monkeypatch):
    rows = family_rows(2, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, fingerprint.compared(df).collect()))
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    assert sorted(map(tuple, fingerprint.compared(df).collect())) == one


def test_every_row_once_with_null_and_repeated_ids(awkward, empty):
    assert fingerprint.compared(awkward).count() == len(awkward_rows())
    assert fingerprint.compared(empty).count() == 0


def test_root_tells_separators_apart(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a\nb", "a b", "a\n\nb", "a\n\n\nb", "a\n \nb", "a b ", " a b", "a  b"])], "doc_id long, text string")
    assert len({r.fingerprint.split(":")[0] for r in fingerprint.fingerprints(df).collect()}) == 8


def plain_tree(text):
    """The fingerprint by plain recursion: children's hashes make the parent's."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    run = re.compile(fingerprint.RUN)
    sections = [[[sha(r) for r in run.findall(p)] for p in s.split("\n")] for s in text.split("\n\n")]
    assert all("".join(run.findall(p)) == p for s in text.split("\n\n") for p in s.split("\n"))
    out, above = [], []
    for s in sections:
        hashes = [sha("".join(p)) for p in s]
        above.append(sha("".join(hashes)))
        out.append(f"{above[-1][:16]}[" + ",".join(f"{h[:16]}({' '.join(r[:8] for r in p)})" for h, p in zip(hashes, s, strict=True)) + "]")
    return sha("".join(above)) + ":" + "/".join(out)


def test_tree_equals_plain_recursion(spark, awkward):
    texts = {r[0]: r[1] or "" for r in awkward_rows() if r[0] is not None} | {90: "x" * 300_000, 91: " " * 5000 + "\n\n" + "y" * 9000 + "."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in fingerprint.fingerprints(df).collect():
        assert r.fingerprint == plain_tree(texts[r.doc_id])


def test_differing_branches_locate_edits_and_give_the_likeness(spark):
    words = [f"w{i}" for i in range(400)]
    para = lambda a, b: " ".join(words[a:b])
    old = f"{para(0, 80)}\n{para(80, 160)}\n\n{para(160, 240)}\n\n{para(240, 320)}\n{para(320, 400)}"
    new = f"{para(0, 80)}\n{para(80, 160)}\n\n{para(160, 240)}\n\n{para(240, 320)}\n{para(320, 350)} changed {para(351, 400)}"
    moved = "\n\n".join(reversed(old.split("\n\n")))
    rows = [(old, new), (old, old), (old, moved), (old, "other words only"), ("", ""), ("", "\n"), ("", "a")]
    out = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string").select("i", fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    got = {r.i: r for r in out.select("i", fingerprint.changed(F.col("a"), F.col("b")).alias("where"), fingerprint.likeness(F.col("a"), F.col("b")).alias("near"), fingerprint.likeness(F.col("b"), F.col("a")).alias("back")).collect()}
    assert [(w.section, w.paragraph, len(w.runs)) for w in got[0]["where"]] == [(2, 1, 1)]
    assert got[0].near == 2 * 49 / 100 and all(r.near == r.back for r in got.values())
    assert [got[i].near for i in range(1, 7)] == [1, 1, 0, 1, 0, 0] and not got[1]["where"] and not got[2]["where"]
    assert [(w.section, w.paragraph) for w in got[3]["where"]] == [(0, 0)]


def test_ranges_follow_the_input(spark):
    """Any number of ranges, ascending with id; an id with a third of all rows, and rows without one, are split by a hash."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(77)).when(F.col("id") % 3 == 1, F.col("id") * 10 - 20_000).alias("doc_id"), F.xxhash64("id").alias("h"))
    for most in (1024, 8):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ranges, "MOST", most)
            r = ranges.id_ranges(df, "doc_id", 60)
            rows = df.select("doc_id", "h", r.of(F.col("doc_id"), F.col("h")).alias("at")).collect()
        n = Counter(x["at"] for x in rows)
        assert len(n) > 40 and max(n) < r.n and max(n.values()) < 6000 / 60 * 4
        order = sorted(rows, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.h))
        assert [x["at"] for x in order] == sorted(x["at"] for x in rows)
        assert len({x["at"] for x in rows if x.doc_id == 77}) > 5 < len({x["at"] for x in rows if x.doc_id is None})

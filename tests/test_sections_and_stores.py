"""Recursive splitting, versions of a table, parsed JSON and search for many, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn, sections
from tessera.sources import corpus, snapshots


def pieces(text, size, overlap, length, separators):
    """The rule in plain steps: cut before the first separator that occurs, gather, carry over an end, recurse into what is long."""
    k = next(i for i, s in enumerate(separators) if s in text)
    s, rest = separators[k], separators[k + 1 :]
    cut = text.split(s) if s else list(text)
    parts = [p for p in [cut[0], *(s + x for x in cut[1:])] if p]
    out, window = [], []

    def close():
        t = "".join(window).strip()
        if t:
            out.append(t)

    for p in parts:
        n = length(p)
        if n >= size:
            close()
            window = []
            out += pieces(p, size, overlap, length, rest) if rest else [p]
            continue
        total = sum(map(length, window))
        if total + n > size:
            close()
            while sum(map(length, window)) > min(overlap, size - n):
                window.pop(0)
        window.append(p)
    close()
    return out


@pytest.mark.parametrize(("size", "overlap", "words"), [(4, 1, True), (7, 3, True), (12, 0, False), (25, 10, False), (1, 0, True)])
def test_recursive_pieces_match_the_rule(spark, size, overlap, words):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcé.") for _ in range(rng.randint(1, 9)))
    texts = ["".join(word() + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["x" * 90, "", "   ", "\n\n\n", "one", "a. b. c. d. e. f", "é" * 30 + " " + "y" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", sections.recursive_pieces(F.col("t"), size, overlap, sections.word_count if words else F.length).alias("p")).orderBy("i").collect()
    length = (lambda t: len(t.split())) if words else len
    for r, t in zip(got, texts, strict=True):
        assert r.p == (pieces(t, size, overlap, length, sections.SEPARATORS) if t else []), t


def test_recursive_chunks_of_nulls_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, None), (2, "ww " * 60_000), (2, ""), (None, "xx " * 80)], "doc_id long, text string")
    out = sections.recursive_chunks(docs, 50, 5).collect()
    assert {r.doc_id for r in out} == {2, None} and sum(r.doc_id == 2 for r in out) == 1333  # the rest is too short
    assert "Python" not in sections.recursive_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sections.recursive_chunks(docs, 5, 5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_stay_as_they_were(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), "k string, n int, v string")
    store = snapshots.Snapshots(spark, f"{tmp_path}/t", ["k"], "p1", buckets=4)
    assert store.versions() == [] and store.manifest()["params"] is None
    with pytest.raises(ValueError):
        store.read()
    first = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 1, "n")]
    assert store.upsert(make(*first)) == 1
    assert store.upsert(make(("a", 3, "z"), ("c", 1, "w"))) == 2
    assert store.delete(make(("b", 0, ""), (None, 0, ""), ("nobody", 0, ""))) == 3
    assert rows_of(store.read(1)) == sorted(first, key=repr)
    assert rows_of(store.read(2)) == sorted([("a", 3, "z"), ("b", 1, None), (None, 1, "n"), ("c", 1, "w")], key=repr)
    assert rows_of(store.read()) == [("a", 3, "z"), ("c", 1, "w")]
    held = store.read(2)  # a reader that has begun
    assert store.upsert(make()) == 4 and rows_of(store.read()) == [("a", 3, "z"), ("c", 1, "w")]
    assert store.clear() == 5 and store.read().count() == 0 and held.count() == 4
    store.expire(keep=1)
    assert store.versions() == [5]
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("a", 1)], "k string, other int"))


def test_one_of_two_changes_is_refused(spark, tmp_path):
    make = lambda k: spark.createDataFrame([(k, 1)], "k string, n int")
    one, two = (snapshots.Snapshots(spark, f"{tmp_path}/t", ["k"], "p") for _ in range(2))
    one.upsert(make("a"))
    before = two.manifest()
    one.upsert(make("b"))
    two.manifest = lambda version=None: before  # it has read the table before the other's change
    with pytest.raises(snapshots.Conflict):
        two.upsert(make("c"))
    assert rows_of(one.read()) == [("a", 1), ("b", 1)] and one.versions() == [1, 2]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=8)
    store.upsert(spark.range(100).select(F.col("id").alias("k")))
    store.upsert(spark.createDataFrame([(5,)], "k long"))
    a, b = store.manifest(1)["folders"], store.manifest(2)["folders"]
    assert sum(a[x] != b[x] for x in b) == 1 and store.read().count() == 100


def test_each_json_text_is_read_by_itself(spark):
    texts = ['{"k": 1, "s": "a"}', '{"k": 1', None, " ", "[1]", "1", "null", '{"s": "b", "x": 2}', '{"k": "no"}', '{}', '{"k": 7} ']
    rows = corpus.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, raw string"), "raw", "k int, s string").orderBy("i").collect()
    m = ("malformed", None, None)
    assert [(r.status, r.k, r.s) for r in rows] == [("read", 1, "a"), m, ("missing", None, None), ("missing", None, None), m, m, m, ("read", None, "b"), m, ("read", None, None), ("read", 7, None)]


def clustered(rng, n, dim=12, centres=20):
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, dim))


def brute_nearest(ids, v, q_ids, q, k, allowed):
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, q))
    d = np.round(1 - w @ u.T, 9)
    out = []
    for i, name in enumerate(q_ids):
        order = [j for j in np.lexsort((ids, d[i])) if allowed(i, j)][:k]
        out += [(name, n, int(ids[j]), round(float(d[i, j]), 6)) for n, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 50])
def test_nearest_many_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = clustered(rng, 600)
    v[100:110] = v[7]  # ties
    label = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(i, x.tolist(), int(g)) for i, (x, g) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    bad = spark.createDataFrame([(900, None, 0), (901, [0.0] * 12, 0), (902, [1.0], 0), (903, [float("nan")] * 12, 0), (904, [], 1)], df.schema)
    q = df.where("vec_id % 30 = 7").withColumnRenamed("vec_id", "query_id").withColumn("cited", F.array(F.col("query_id"), F.lit(100).cast("long")))
    same = lambda a, b: a["label"].to_numpy()[:, None] == b["label"].to_numpy()
    out = knn.nearest_many(df.unionByName(bad), q, 7, columns=("label",), query_columns=("label",), match=same, excluded="cited", block=block)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.distance, 6)) for r in out.collect())
    at = np.arange(7, 600, 30)
    assert got == brute_nearest(np.arange(600), v, at.tolist(), v[at], 7, lambda i, j: label[at[i]] == label[j] and j not in (at[i], 100))


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "query_id")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in knn.nearest_many(df, q, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert knn.nearest_many(df.limit(0), q, 5).count() == 0 and knn.nearest_many(df, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn.nearest_many(df, q, 0)


def test_fewer_distances_than_a_full_product(spark):
    """By the bounds alone: cells that a query must meet hold a small part of the vectors."""
    rng = np.random.default_rng(4)
    v = clustered(rng, 4000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    pivots = knn.chosen_pivots(df, "vec_id", "embedding")
    placed = knn.placed(df, "embedding", pivots)
    cells = knn.Cells(placed, len(pivots))
    near = np.array([r._near for r in placed.where("vec_id % 50 = 0").orderBy("vec_id").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = np.sqrt(np.maximum(0, 2 - 2 * u[::50] @ u.T))
    kth = np.sort(true, 1)[:, 9]
    read = ((cells.bounds(near) <= kth[:, None]) * cells.n).sum()
    assert read < 0.35 * len(near) * len(v)
    where = {(r["_cell"], r["_ring"]): i for i, r in enumerate(placed.select("_cell", "_ring").distinct().orderBy("_cell", "_ring").collect())}
    own = [where[r["_cell"], r["_ring"]] for r in placed.select("vec_id", "_cell", "_ring").orderBy("vec_id").collect()]
    assert (cells.bounds(near)[:, own] <= true + 1e-9).all()  # a bound is never above a distance


def test_sparse_vectors_match_brute_force(spark):
    import math
    from collections import Counter

    from tessera.operators import sparse

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("alpha beta Gamma delta eps zeta eta".split()) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(50, None), (51, "alpha"), (52, "Alpha  alpha"), (53, "\n")]
    got = sorted(map(tuple, sparse.nearest_texts(sparse.weighed(spark.createDataFrame(texts, "doc_id long, text string")), F.col("doc_id") % 5 == 1, 4).collect()))
    counts = {i: Counter(t.lower().split()) for i, t in texts if t is not None}
    held = Counter(w for c in counts.values() for w in c)
    raw = {i: {w: n * math.log(len(texts) / held[w]) for w, n in c.items()} for i, c in counts.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in raw.items()}
    want = []
    for i in sorted(raw):
        if i % 5 == 1:
            near = sorted((-round(sum(x * raw[j].get(w, 0) for w, x in raw[i].items()) / norm[i] / norm[j], 9), j) for j in raw if j != i and raw[i].keys() & raw[j].keys())
            want += [(i, n, j, -c) for n, (c, j) in enumerate(near[:4], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))
    assert sparse.weighed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nearest_texts_by_blocks_make_no_rows_of_pairs(spark):
    from tessera.operators import sparse

    texts = [(i, None if i == 7 else " ".join(f"w{(i * j) % 11}" for j in range(1, 9))) for i in range(1, 24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    terms, is_query = sparse.counted(docs), F.col("doc_id") % 5 == 1
    one = sparse.nearest(terms, is_query, 4, rare=sparse.rarity(terms, docs.count()))
    split = sparse.nearest(terms, is_query, 4, rare=sparse.rarity(terms, docs.count()), block=3)
    plain = sparse.nearest_texts(sparse.weighed(docs), is_query, 4)
    got = [sorted((r.query, r["rank"], r.doc_id, round(r.cosine, 8)) for r in df.collect()) for df in (one, split, plain)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 17  # one query shares words with one text alone
    assert "Join" not in split._jdf.queryExecution().optimizedPlan().toString()  # a join would have a row for each pair


def test_nearest_texts_compare_equal_vectors_once(spark):
    """Copies are one vector of a block, by their least keys, and every query among them gets its own answer; also where a block has several lots and a matrix."""
    from tessera.operators import sparse

    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(("a b c d e f g h", "a b")[j % 2].split()) + str(rng.randint(0, 3)) for j in range(12)) for i in range(30)}
    texts |= {i: "copy of one text" for i in range(100, 160)} | {i: "text one of copy" for i in range(160, 170)} | {i: texts[i - 200] for i in range(200, 230)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    terms, is_query = sparse.counted(docs), F.col("doc_id") % 10 == 0
    vectors = sparse._distinct(terms, is_query, 4, "doc_id").collect()
    assert len(vectors) == 31 and sum(len(v.askers) for v in vectors) == 13
    assert [v.members for v in vectors if 100 in v.members] == [[100, 101, 102, 103, 104]]
    rare, names = sparse.rarity(terms, len(texts)), {r.doc_id: dict(zip(r.features, r.times, strict=True)) for r in terms.collect()}
    unit = {}
    for i, v in names.items():
        w = {f: n * rare[f] for f, n in v.items()}
        unit[i] = {f: x / np.sqrt(sum(y * y for y in w.values())) for f, x in w.items()}
    want = []
    for i in sorted(x for x in unit if x % 10 == 0):
        near = sorted((-round(sum(x * unit[j].get(f, 0) for f, x in unit[i].items()), 9), j) for j in unit if j != i and unit[i].keys() & unit[j].keys())
        want += [(i, n, j, -c) for n, (c, j) in enumerate(near[:4], 1)]
    for block in (sparse.BLOCK, 7):
        got = sorted(map(tuple, sparse.nearest(terms, is_query, 4, rare=rare, block=block).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize(("share", "first"), [(1 / 16, 0), (0.3, 0), (2.0, 1 << 40), (0.3, 1 << 40)])
def test_a_block_leaves_out_no_near_text(share, first, monkeypatch):
    """The comparison in single precision keeps all that may be among the k best, whatever part of it is a matrix or postings, and by numbers of features or their places."""
    from tessera.operators import sparse

    monkeypatch.setattr(sparse, "SHARE", share)
    rng = np.random.default_rng(5)
    v = np.where(rng.random((900, 60)) < np.linspace(0.01, 0.7, 60), rng.integers(1, 4, (900, 60)), 0).astype(float)
    v[300:340] = v[300]  # ties beyond the kth
    v[:, 0] += v.sum(1) == 0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    row, f = np.nonzero(v)
    block = sparse._Block(row, f + first, v[row, f], len(v))
    assert block.table.shape[1] == (np.count_nonzero(v, axis=0) > len(v) * share).sum()
    exact, some = np.round(v @ v.T, sparse.DIGITS), [0, 300, 301, 899]
    at, g = np.nonzero(v[some])
    for i, (rows, cosine) in zip(some, block.nearest(at, g + first, v[some][at, g], len(some), 5), strict=True):
        kth = np.sort(exact[i])[-5]
        assert set(np.flatnonzero((exact[i] >= kth) & (exact[i] > 0))) <= set(rows.tolist()) and np.abs(cosine - exact[i][rows]).max() <= 2e-9
        assert len(rows) < 100


def test_numbers_by_answer_go_by_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    from tessera.queries import stored

    lines = [(a, a % 3, "A", a % 5, n) for a in range(40) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(a,) for a in range(40)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(stored, "_ROWS", 10)
    out = stored.QUERIES["s3_numbers_by_answer"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM, [plan_id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 8)" in plan
    assert sorted((r.answer, r.number) for r in out.collect()) == [(a, 1) for a in range(40)]

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding, topk
from tests.llm.conftest import awkward_rows


def brute_top(ids, v, queries, k):
    s = v @ v.T
    out = []
    for i in queries:
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[i, j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 64, 100_000])
def test_top_k_equals_brute_force_with_ties(spark, scale):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 16)), 1)
    v[50:90] = v[10]
    df = spark.createDataFrame([(int(i), x.tolist(), "x") for i, x in enumerate(v)], "vec_id long, embedding array<double>, shard string").repartition(5)
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(df, scale=scale), F.col("vec_id") % 20 == 0, 20, inner=32, block=70).collect()))
    ints = np.floor(v * scale).astype(np.int64)
    assert got == brute_top(np.arange(300), ints, range(0, 300, 20), 20)


def test_unusable_vectors_take_no_part_and_few_candidates_give_all(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 20).collect()))
    assert [r[2] for r in got if r[0] == 0] == [8, 7, 20]
    assert [r[3] for r in got if r[0] == 0] == [64 * 192, 0, 64 * 32 - 128 * 64]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_never_drop_a_winner():
    rng = np.random.default_rng(9)
    q, c = rng.integers(-60, 60, (7, 24)).astype(np.int32), rng.integers(-60, 60, (5000, 24)).astype(np.int32)
    ids = rng.permutation(5000)
    best, order, _ = topk.max_score(q, np.full(7, -1), c, ids, 20)
    for where, score, x in zip(best.where, best.scores, q, strict=True):
        s = c.astype(int) @ x.astype(int)
        want = np.lexsort((ids, -s))[:20]
        assert order[where].tolist() == want.tolist() and score.tolist() == s[want].tolist()


def clusters(rng, n, dim, centres):
    v = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] * rng.exponential(size=dim) + 0.3 * rng.normal(size=(n, dim))
    return np.floor(64 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int32)


@pytest.mark.parametrize("kind", ["clusters", "sparse"])
def test_fewer_postings_are_read_than_a_full_product_has(kind):
    rng = np.random.default_rng(4)
    c = clusters(rng, 16_000, 64, 50) if kind == "clusters" else np.where(rng.random((16_000, 200)) < 0.03, rng.integers(1, 40, (16_000, 200)), 0).astype(np.int32)
    q = c[::80]
    best, order, read = topk.max_score(q, np.arange(0, 16_000, 80), c, np.arange(16_000), 20)
    scores = q.astype(int) @ c.T.astype(int)
    for i in range(len(q)):
        scores[i, i * 80] = -1 << 40
        want = np.lexsort((np.arange(16_000), -scores[i]))[:20]
        assert order[best.where[i]].tolist() == want.tolist()
    assert read < 0.6 * scores.size * c.shape[1]


def test_components_of_any_size_and_repeated_ids(spark):
    rows = [(20, [1e12, 1.0]), (20, [1.0, 2.0]), (1, [1e12, -3.0]), (2, [-1e200, 5.0]), (3, [3e7, 3e7]), (4, [0.5, 0.25]), (5, [1e200, 1e200]), (40, [2e9, -2e9])] + [(100 + 20 * i + 1, [i / 8, 1.0]) for i in range(30)]
    df = spark.createDataFrame([(i, x, 7, "z") for i, x in rows], "vec_id long, embedding array<double>, query_row int, rank string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 20).collect())
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ints = [[int(np.floor(max(-topk.MOST, min(topk.MOST, 64 * x)))) for x in v] for _, v in rows]
    want = []
    for (i, _), v in zip(rows, ints, strict=True):
        if i % 20 == 0:
            scored = sorted((-ends(v[0] * w[0] + v[1] * w[1]), j) for (j, _), w in zip(rows, ints, strict=True) if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert got == sorted(want) and sum(r[0] == 20 for r in got) == 40


# shards

def test_places_sizes_and_balance(awkward):
    placed, m = sharding.shard(awkward, 8)
    rows = placed.collect()
    texts = [r[1] or "" for r in awkward_rows()]
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert m.version == 1 and all(a != b for _, _, a, b in m.history)


def test_rebalancing_narrows_and_edits_only(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    placed, m = sharding.shard(df, 8)
    total = [r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(total) == 8 and max(total) - min(total) <= 0.001 * max(total)
    first = sharding.SlotMap.initial(8)
    assert sum(a != b for a, b in zip(first.owner, m.owner, strict=True)) == len(m.history) < 500
    again, _ = sharding.shard(df, 8, slot_map=m)
    assert again.count() == 20_000


def test_key_law_grows_into_the_new_shard_only(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.shard(df, 8, law="key")[0].collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert moved and {r.grown_shard for r in moved} == {8} and 0.08 < len(moved) / 5000 < 0.14
    with pytest.raises(ValueError):
        sharding.shard(df, 8, law="other")


def test_maps_are_stored_by_version(spark, tmp_path):
    m = sharding.SlotMap.initial(3, 30).rebalanced({0: 100, 3: 90, 1: 5}).grown()
    m.save(spark, str(tmp_path))
    back = sharding.SlotMap.load(spark, str(tmp_path), m.version)
    assert back == m and back.history == m.history != ()
    bare = sharding.SlotMap(8, (0, 1, 2) * 10, 7)  # shards 3 to 7 own no slot
    bare.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 7).n_shards == 8
    assert sharding.SlotMap.load(spark, str(tmp_path), m.version) == m


def test_shards_are_those_of_the_stored_map(spark, awkward, tmp_path):
    """Each row's shard is recomputed from the map as stored: its virtual slot's owner."""
    placed, m = sharding.shard(awkward, 8, store=str(tmp_path))
    owner = {r.vslot: r.shard for r in spark.read.parquet(f"{tmp_path}/map/version={m.version}").collect()}
    rows = placed.collect()
    assert len(owner) == sharding.SLOTS and {r.map_version for r in rows} == {m.version} and all(owner[r.virtual_slot] == r.shard for r in rows)


@pytest.mark.parametrize("key", [7, None])
def test_equal_rows_are_spread(spark, key):
    df = spark.range(20_000).select(F.lit(key).cast("long").alias("doc_id"), F.lit("one text").alias("text")).unionByName(spark.range(100, 140).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    rows = sharding.shard(df, 8)[0].collect()
    n = [sum(r.shard == k for r in rows) for k in range(8)]
    assert len(rows) == 20_040 and max(n) - min(n) <= 40
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n[k]))
    kept = sharding.shard(df, 8, law="key")[0].where("size = 9").collect()
    assert len(kept) == 20_000 and len({r.shard for r in kept}) == 1 and len({r.slot for r in kept}) == 20_000


def test_many_equal_rows_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    monkeypatch.setattr(sharding, "SHARES", 3)
    df = spark.range(1000).select((F.col("id") % 4).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = sharding.shard(df, 2, n_slots=16)[0].collect()
    for k in range(2):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len(rows) == 1000 and {r.doc_id for r in rows} == {0, 1, 2, 3}


def test_rows_of_one_id_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    placed, _ = sharding.shard(df, 8)
    assert placed.select("virtual_slot").distinct().count() > 1500
    n = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(n) == 8 and max(n) < 1.2 * min(n)


def test_no_rows(empty):
    assert sharding.shard(empty)[0].count() == 0

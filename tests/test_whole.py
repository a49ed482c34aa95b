"""Queries and operators that must do the whole job, on rows that a cut would lose."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import joins, retrieval


def test_seed_swap_takes_both_branches_in_the_cited_section(spark):
    v = lambda a: [1.0, a]
    rows = [(0, "A", "s", v(0.0)), (3, "A", "s", v(0.1)), (6, "A", "s", v(0.2)), (4, "A", "s", v(0.3)), (1, "A", "t", v(0.0)), (2, "B", "t", v(0.0)), (5, "B", "s", v(0.5)), (9, "B", "s", v(0.4)), (8, "C", "u", v(0.0))]
    chunks = spark.createDataFrame(rows, "vec_id long, company string, section string, embedding array<float>")
    same, other = retrieval.SAME_COMPANY, retrieval.OTHER_COMPANY
    seeds = spark.createDataFrame([("a", same, "A", "s", v(0.0), [0]), ("b", other, "A", "s", v(0.0), [0, 9]), ("c", same, "C", "u", v(0.0), [8]), ("d", other, "C", "u", v(0.0), [8])], "seed_id string, kind string, company string, section string, claim array<float>, cited array<long>")
    picked = lambda rank: {r.seed_id: (r.vec_id, r.status) for r in retrieval.seed_swap(seeds, chunks, rank).collect()}
    none = (None, "no_candidate")
    assert picked(2) == {"a": (6, "swapped"), "b": (9, "swapped"), "c": none, "d": none}
    assert picked(10)["a"] == (4, "swapped")
    assert picked(1)["a"] == (3, "swapped")


def test_seed_swap_query_searches_every_vector(spark, tmp_path):
    from tessera.queries import evaluation

    rows = [(i, 0, [1.0] * 63 + [i / 100]) for i in range(0, 52, 4)] + [(53, 1, [1.0] * 64), (48 + 8, 1, [1.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = evaluation.QUERIES["c21_seed_swap"](spark, str(tmp_path)).where((F.col("label") == 0) & (F.col("section") == 0))
    # 0 and 4 are cited, so the tenth nearest is 44; ids divisible by three are candidates as any other
    assert {r.kind: r.vec_id for r in out.collect()} == {retrieval.SAME_COMPANY: 44, retrieval.OTHER_COMPANY: 56}


def test_assembled_input_reaches_the_end_of_every_text(spark, tmp_path):
    from tessera.queries import corpus

    body = "x" * 30_000
    spark.createDataFrame([(1, body + "a"), (2, body + "b"), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.assembled for r in corpus.QUERIES["e3_assembled_input"](spark, str(tmp_path)).collect()}
    whole = lambda t: hashlib.sha256(f"{t[:12_000]}\n\n{t}".encode()).hexdigest()
    assert found == {1: whole(body + "a"), 2: whole(body + "b"), 3: whole("short")} and found[1] != found[2]


def test_inventory_statuses_and_rankings_read_every_row(spark, tmp_path):
    from tessera.queries import evaluation

    docs = [(5, "p", "de", 9), (10, "p", "de", 8), (1, "q", "en", 7), (2, "q", "en", 6), (3, "r", "en", 5)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (1, 1), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: evaluation.QUERIES[name](spark, str(tmp_path)).collect()
    inventory = {(r.ticker, r.intent): (r.eligible, r.status) for r in run("c18_inventory")}
    assert inventory["p", "risk_factors"] == (2, "answerable") and inventory["q", "company_overview"] == (2, "answerable")
    assert inventory["q", "risk_factors"] == (0, "section_absent")
    found = {r.qid: (r.relevant_total, r.first_rank, r.hit, r.unjudged) for r in run("a13_ranking_metrics")}
    assert found == {"p": (1, 1, True, 1), "q": (1, 1, True, 1), "r": (0, None, None, 0)}
    assert {(r.qid, r.key, r["rank"]) for r in run("a14_unjudged")} == {("p", 10, 2), ("q", 2, 2)}
    assert {r.label: r.n_blocks for r in run("c16_all_groups")} == {1: 2, 2: 1}


def test_a_group_without_blocks_keeps_its_status(spark):
    groups, blocks = spark.createDataFrame([("a",), ("b",)], "g string"), spark.createDataFrame([("a",)], "g string")
    assert {(r.g, r.n_blocks, r.status) for r in retrieval.with_status(groups, blocks, "g").collect()} == {("a", 1, "searched"), ("b", 0, "no_matching_chunks")}


def test_short_passages_are_found_by_the_exact_test(spark):
    passages = {1: "cat", 2: "at sa", 3: "", 4: "the cat sat", 5: "The Cat", 6: "dog", 7: " ", 8: None}
    texts = {1: "the cat sat down", 2: "concatenate", 3: "", 4: "The  Cat", 5: None}
    p = spark.createDataFrame(list(passages.items()), "passage_id long, passage string")
    t = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    whole = sorted((i, j) for i, a in passages.items() for j, b in texts.items() if a is not None and b is not None and a in b)
    assert sorted(map(tuple, joins.contained_passages(p, t).collect())) == whole
    short = joins.contained_passages(p.where("passage_id = 1"), t)
    assert sorted(map(tuple, short.collect())) == [(1, 1), (1, 2)]


def test_write_status_has_every_status_over_all_rows(spark):
    from tessera.queries.corpus import io8_write_status

    seen = {r.status: r["count"] for r in io8_write_status(spark, "/root/testdata/sf0.01").groupBy("status").count().collect()}
    assert set(seen) == {"kept", "new", "changed", "unchanged"}


def test_parity_compares_all_customers_on_both_sides(spark):
    from tessera.queries.corpus import j15_j16_parity

    sf_dir = "/root/testdata/sf0.01"
    customers, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "supplier"))
    seen = {r.status: r["count"] for r in j15_j16_parity(spark, sf_dir).groupBy("status").count().collect()}
    assert seen.keys() == {"same", "different", "only_left", "only_right"}
    assert seen["only_left"] == 100 and seen["only_right"] == 100 + suppliers and seen["same"] + seen["different"] == customers - 100

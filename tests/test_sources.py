"""Stores, artifacts, extraction and scopes on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality, sections
from tessera.schemas import METRICS
from tessera.sources import chunk_store, corpus, extraction

CHUNK = "source_cik string, source_year int, source_section string, chunk_index int, text string"


def test_chunk_store_replaces_filings(spark, tmp_path):
    store = chunk_store.ChunkStore(spark, f"{tmp_path}/store", chunk_store.params_hash(size=500, overlap=50))
    assert store.count() == -1 and store.matches() is None
    store.add(spark.createDataFrame([("1", 2021, "Item 1", i, f"old {i}") for i in range(3)] + [("2", 2022, "Item 7", 0, "other")], CHUNK))
    store.add(spark.createDataFrame([("1", 2021, "Item 1", 0, "new")], CHUNK))
    assert sorted(r.text for r in store.read().collect()) == ["new", "other"] and store.count() == 2 and store.matches()
    assert chunk_store.ChunkStore(spark, f"{tmp_path}/store", "other").matches() is False
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("1", 2021, None, 0, "x")], CHUNK))
    assert not store.reset(spark.createDataFrame([(1, True)], "id int, is_embedded boolean")).first().is_embedded and store.count() == -1


def test_params_hash_follows_every_parameter():
    a = chunk_store.params_hash(size=500, overlap=50)
    assert len(a) == 12 and a == chunk_store.params_hash(overlap=50, size=500) != chunk_store.params_hash(size=500, overlap=51)


def test_narrative_artifacts_and_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cik": "1", "year": 2021, "sections": [{"name": "Item 1", "text": "x", "token_count": 1}]}))
    (tmp_path / "b.json").write_text("{not json")
    rows = corpus.read_narrative(spark, str(tmp_path)).collect()
    assert sorted((r.cik or "", r._corrupt is not None) for r in rows) == [("", True), ("1", False)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("line\nline")
    assert corpus.read_text_files(spark, f"{tmp_path}/t").first().text == "line\nline"


def test_extraction_keeps_evidence(spark):
    text = "COVER\n(in millions)\nTotal net sales $365,817 274,515\nNet income $94,680\nTotal assets 351,002\n"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "document_id int, text string")
    got = {r.document_id: r for r in extraction.extracted(docs).collect()}
    one = got[1]
    assert (one.total_revenue, one.net_income, one.total_assets, one.total_liabilities) == (365817e6, 94680e6, 351002e6, None)
    assert one.net_income_source_line == "Net income $94,680" and one.net_income_evidence_present and one.net_income_evidence_consistent and one.total_liabilities_evidence_present is None
    assert [got[i].extraction_status for i in (1, 2, 3)] == ["success", "extraction_failed", "technical_failed"] and json.loads(one.evidence_json)["net_income"]["value"] == 94680e6
    with pytest.raises(KeyError):
        extraction.extracted(docs, "S9")
    values = extraction.extracted(docs).where("document_id = 1").select("document_id", extraction.plain_figures(extraction.evidence_map()).alias("v"))
    assert set(values.first().v) == set(METRICS)


def test_scopes_and_upserts(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, ticker string")
    known = docs.where("id = 2")
    assert [[r.id for r in corpus.in_scope(docs, s, known, ["id"]).orderBy("id").collect()] for s in ("all", "eval", "held_out")] == [[1, 2, 3], [2], [1, 3]]
    old, new = (spark.createDataFrame(r, "k string, seq int, v string") for r in ([("a", 1, "old"), ("b", 1, "keep")], [("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")]))
    assert {r.k: r.v for r in corpus.upsert(old, new, ["k"], F.col("k").isNotNull()).collect()} == {"a": "y", "b": "keep"}


def test_first_concept_is_strict(spark):
    rows = [("f", "us-gaap_ProfitLoss", 5.0, False, False, 1), ("f", "us-gaap_NetIncomeLoss", None, False, False, 2), ("f", "us-gaap_Assets", 9.0, True, False, 3), ("f", "us-gaap_Assets", 7.0, False, False, 4)]
    got = {r.field: r.value for r in corpus.first_concept(spark.createDataFrame(rows, "filing string, concept string, value double, dimension boolean, abstract boolean, line_no int")).collect()}
    assert got == {"net_income": 5.0, "total_assets": 7.0}


def test_sections_are_accepted_in_order(spark):
    body = "".join(f"{i}word" for i in range(400))
    rows = [(1, "Item 1A", body, 300), (1, "Item 7", body, 300), (1, "Item 1", body[::-1], 300), (1, "Item 7A", "tiny", 5), (2, "Item 7", body, 300)]
    got = {(r.doc_id, r.section) for r in sections.accepted_sections(spark.createDataFrame(rows, "doc_id int, section string, text string, n_tokens int"), ("Item 1A", "Item 7", "Item 1", "Item 7A")).collect()}
    assert got == {(1, "Item 1A"), (1, "Item 1"), (2, "Item 7")}


def test_evidence_is_tri_state(spark):
    df = spark.createDataFrame([("Net  Income $5", "x netincome5 y"), (None, "z"), ("absent", "z")], "line string, source string")
    assert [r[0] for r in df.select(quality.evidence_present(F.col("line"), F.col("source"))).collect()] == [True, None, False]

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import brute_classes
from tests.llm.test_quality import corpus


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus: junk, copies, near copies, a shared passage, empty and null texts."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, q) for i, t, q in corpus(240)]
    good = [t for _, t, q in rows if q]
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [good[0], good[0], good[1] + " tail", f"{good[2]} {passage}", f"{good[3]} {passage} {good[4][:40]}"]
    rows += [(1000 + i, t, 1) for i, t in enumerate(extra)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(2000, "", "en", "s", 0), (2001, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 240], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, sf):
    docs, frames = spark.read.parquet(f"{sf}/documents.parquet"), []
    from tessera.llm.store import written

    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test")
        frames.append(docs)
    source, clean, single, cut, packed = spark.read.parquet(f"{sf}/documents.parquet"), *frames
    assert clean.columns == single.columns == cut.columns == source.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    bad = {i for i in range(240) if i % 3 == 0}
    assert not ids(clean) & bad and {i for i in range(240) if i % 3} <= ids(clean)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(ids(single)) == sorted({c for _, c in brute_classes(rows)})
    assert single.count() == len(ids(single))
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, r.text) for r in single.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone, new = np.zeros(len(w), bool), []
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if k in seen:
                gone[j : j + 50] = True
            new.append(k)
        seen.update(new)
        want[i] = " ".join(np.array(w, object)[~gone]) if gone.any() else (t or "")
    assert {r.doc_id: r.text for r in cut.collect()} == want and any(len(want[i]) < 100_000 for i in want)
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert any(i >= 1003 and "p30" not in t for i, t in want.items())
    assert {r.doc_id for r in packed.collect()} == set(want)


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 2048 for r in full) and len(full) <= -(-sum(r.n for r in full) // 2048) + 1
    assert zlib.crc32(b"") == 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_awkward_and_empty_tables(spark, awkward, empty, sf):
    """Nulls, repeated rows, odd columns and no rows: each stage keeps the columns, and only duplicates and junk go."""
    for docs in (awkward, empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= n, name
        assert corpus_pipeline.best_fit_packing(spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    cut = corpus_pipeline.shared_passages(spark, awkward, sf)
    assert cut.count() == awkward.count()

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality
from tests.llm.conftest import awkward_rows


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        if i % 3 == 0:
            w = [x + rng.choice(["$$$", "%%%", "***"]) if rng.random() < 0.8 else x for x in w]
        rows.append((i, " ".join(w), 0 if i % 3 == 0 else 1))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (10**6, 0, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= out[i].score <= 1 and out[i].predicted == int(out[i].score >= 0.7) for i, _, _ in rows)
    assert np.mean([out[i].predicted == q for i, _, q in held]) >= 0.95


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q
    a, b = (spark.createDataFrame([(i, f(i, q)) for i, _, q in rows], "doc_id long, quality int") for f in (lambda i, q: q, flip))
    x, y = (sorted(map(tuple, quality.classify(docs, lab).collect())) for lab in (a, b))
    assert x == y


def test_awkward_rows_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(awkward, none).collect()
    assert len(rows) == len(awkward_rows()) and {r.score for r in rows} == {0.5} and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.classify(empty, none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    kept = quality.kept(awkward, one)
    assert kept.schema == awkward.schema and kept.count() == len(awkward_rows())


def test_forest_walk_equals_rules():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    f = quality.fit(x, y)
    assert ((f.scores(x) > 0.5) == (y > 0)).mean() > 0.97
    assert len(f.roots) == 120 and (f.left[f.feature >= 0] > 0).all()


def test_splits_and_leaves_equal_a_search_over_all():
    """Every node's split has the highest gain of all features and cuts, leaves have the regularised step, and the flat walk is the recursive one."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=150) > 0).astype(float)
    rate, bins, l2, least = 0.1, 16, 1.0, 8
    f = quality.fit(x, y, trees=3, depth=3, rate=rate, bins=bins, l2=l2, least=least)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(3)]
    raw = np.full(len(y), f.base)
    for root in f.roots:
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        out = np.zeros(len(y))

        def grow(node, rows, depth):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: E731, B023
            gains = {}
            for k in range(3):
                for c in cuts[k]:
                    left, right = rows[x[rows, k] <= c], rows[x[rows, k] > c]
                    if min(len(left), len(right)) >= least:
                        gains[k, float(c)] = score(left) + score(right) - score(rows)
            if f.feature[node] < 0:
                assert depth == 3 or not gains or max(gains.values()) <= 1e-6 + 1e-9
                assert np.isclose(f.value[node], -rate * g[rows].sum() / (h[rows].sum() + l2))  # noqa: B023
                out[rows] = f.value[node]  # noqa: B023
                return
            assert np.isclose(gains[int(f.feature[node]), float(f.limit[node])], max(gains.values()))
            goes = x[rows, f.feature[node]] > f.limit[node]
            grow(f.left[node], rows[~goes], depth + 1)
            grow(f.left[node] + 1, rows[goes], depth + 1)

        grow(root, np.arange(len(y)), 0)
        raw += out
    assert np.allclose(f.scores(x), 1 / (1 + np.exp(-raw)))


def test_repeated_labelled_ids_stay_within_the_bound(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i % 4, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    sizes, whole = [], quality.fit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "fit", lambda x, y: sizes.append(len(x)) or whole(x, y))
        quality.train(docs, labels, max_rows=10)
    assert sizes == [10]


def test_statistics_do_not_depend_on_the_batch():
    texts = [r[1] for r in awkward_rows()]
    whole = quality.batch_statistics(pa.array(texts, pa.string()))
    each = np.concatenate([quality.batch_statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (len(texts), quality.N_STATISTICS) and np.isfinite(whole).all()
    assert np.allclose(whole, each)

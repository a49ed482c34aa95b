import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exchange, parts, substring_dedup, suffix_dedup
from tessera.llm.arrowtext import Texts
from tests.llm.conftest import SCHEMA, awkward_rows

BIG = 1 << 62


def brute(rows, split, window):
    """kept units and removed mask of each row, by comparing windows with those of smaller ids."""
    order = sorted(range(len(rows)), key=lambda i: BIG if rows[i][0] is None else rows[i][0])
    seen, out, at = set(), [None] * len(rows), 0
    while at < len(order):
        same = [i for i in order[at:] if rows[i][0] == rows[order[at]][0]]
        new = set()
        for i in same:
            u = split(rows[i][1] or "")
            gone = np.zeros(len(u), bool)
            for j in range(len(u) - window + 1):
                k = tuple(u[j : j + window])
                if k in seen:
                    gone[j : j + window] = True
                new.add(k)
            out[i] = (u, gone)
        seen |= new
        at += len(same)
    return out


@pytest.mark.parametrize("small_parts", [False, True])
def test_words_match_brute_force(spark, awkward, monkeypatch, small_parts):
    if small_parts:
        monkeypatch.setattr(parts, "PART_BYTES", 4000)
    got = sorted(map(tuple, substring_dedup.substring_dedup(awkward, carry=("lang",)).select("doc_id", "n_words", "n_removed", "kept_text", "carry_0").collect()), key=repr)
    rows = awkward_rows()
    want = [(r[0], len(u), int(g.sum()), " ".join(np.array(u, object)[~g]), r[2]) for r, (u, g) in zip(rows, brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 50), strict=True)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("small_parts", [False, True])
def test_bytes_match_brute_force(spark, awkward, monkeypatch, small_parts):
    if small_parts:
        monkeypatch.setattr(parts, "PART_BYTES", 4000)
        monkeypatch.setattr(parts, "LEAST_BUCKETS", 5)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(awkward).collect()], key=repr)
    rows, want = awkward_rows(), []
    for r, (u, g) in zip(rows, brute(rows, lambda t: list(t.encode()), 50), strict=True):
        spans = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        want.append((r[0], len(u), int(g.sum()), spans, bytes(np.array(u, np.uint8)[~g]) if len(u) else b""))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_small_alphabet(spark, monkeypatch, seed):
    """Few letters make shared and overlapping windows, runs and ties of grams common."""
    monkeypatch.setattr(parts, "PART_BYTES", 600)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4))), *[None] * 10) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, window=20).collect()}
    for r, (u, g) in zip(rows, brute(rows, lambda t: list(t.encode()), 20), strict=True):
        assert got[r[0]] == (int(g.sum()), bytes(np.array(u, np.uint8)[~g]) if len(u) else b"")
    spaced = df.withColumn("text", F.trim(F.regexp_replace("text", "(.)", "$1 ")))
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spaced, window=15).collect()}
    for r, (_, g) in zip(rows, brute([(i, " ".join(t)) for i, t, *_ in rows], str.split, 15), strict=True):
        assert got[r[0]] == int(g.sum())


def test_empty_tables(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize(("period", "cover"), substring_dedup.COVERS.items())
def test_covers_align_any_two_positions(period, cover):
    for shift in range(period):
        assert any((c + shift) % period in cover for c in cover)


def test_anchor_density_and_reach():
    period, mask = substring_dedup.cover_for(50)
    assert period == 31 and mask.sum() == 6
    assert substring_dedup.cover_for(5)[0] == 3


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 24), np.uint8)
    rows[::7] = rows[0]
    order = suffix_dedup.multikey_order(suffix_dedup.big_endian(rows))
    ranked = [bytes(rows[i]) for i in order]
    assert ranked == sorted(ranked)


def test_spans_hash_content_not_place():
    t = Texts(np.frombuffer(b"one two one", np.uint8), np.array([0, 11]))
    h, first = t.word_hashes()
    assert h[0] == h[2] != h[1] and first.tolist() == [0, 3]


def test_anchors_are_hashed_at_cover_positions_alone():
    t = Texts.of(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 81, 200)] + ["", None]))
    period, mask = substring_dedup.cover_for(50)
    start, doc, _ = substring_dedup.Words(t, 0).anchors(50)
    first = t.words()[2]
    want = [(d, p) for d, n in enumerate((49, 50, 81, 200)) if n >= 50 for p in range(n - 19) if mask[p % period]]
    assert list(zip(doc.tolist(), (start - first[doc]).tolist(), strict=True)) == want


def test_equal_hashes_of_different_words_are_an_error(spark):
    """With hashes that tell nothing apart, the comparison of words stops the job: nothing is removed on a hash alone."""
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join([shared, *(f"d{i}x{j}" for j in range(60))]), *[None] * 10) for i in range(4)]
    with pytest.raises(Exception, match="two different passages"):
        substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA), bits=1).collect()


def test_one_gram_with_many_surroundings_is_settled_in_portions(monkeypatch):
    rng = np.random.default_rng(3)
    g = suffix_dedup.Grams(20)
    data = np.frombuffer(b"".join(bytes(rng.integers(97, 99, 12, np.uint8)) + b"QQQQQQQQQQQQ" + bytes(rng.integers(97, 99, 12, np.uint8)) for _ in range(300)), np.uint8)
    gram = np.arange(300) * 36 + 12
    rows = g.rows(data, gram, gram - g.reach, gram)
    ids = rng.permutation(300)
    want = suffix_dedup.settle_range(g, rows, ids)
    monkeypatch.setattr(suffix_dedup, "PORTION", 40)
    assert (suffix_dedup.settle_range(g, rows, ids) == want).all() and want.any()
    for i in range(300):
        for j in range(g.reach + 1):
            w = data[gram[i] - g.reach + j : gram[i] - g.reach + j + 20].tobytes()
            smaller = any(ids[k] < ids[i] and w == data[gram[k] - g.reach + j : gram[k] - g.reach + j + 20].tobytes() for k in range(300))
            assert smaller == bool(want[i] >> j & 1)


def test_packets_stay_in_proportion_to_senders():
    for n in (300, 1200):
        sent = sum(len(list(exchange.packed(0, np.arange(n), 0, np.zeros((4, n), np.uint8), exchange.spans(n)[0], 0))) for _ in range(n))
        assert sent <= n * exchange.FAN


@pytest.mark.parametrize("n_places", [3, 10, 100])
def test_packets_reach_their_places_in_several_steps(monkeypatch, n_places):
    """Every step in this process, with three spans a step: a packet for a span of places is split again, FAN senders at a time."""
    monkeypatch.setattr(exchange, "FAN", 3)
    rng = np.random.default_rng(n_places)
    steps, sent, want = exchange.spans(n_places), [], []
    assert len(steps) == {3: 1, 10: 3, 100: 5}[n_places]
    for sender in range(40):
        to, rows = rng.integers(0, n_places, 30), rng.integers(0, 256, (5, 30)).astype(np.uint8)
        for kind in (0, 2):
            sent += exchange.packed(kind, to, sender, rows, steps[0], sender // 3, by_row=kind == 2)
            want += [(kind, int(t), sender, bytes(r)) for t, r in zip(to, rows.T, strict=True)]
    for span in steps[1:]:
        groups = {}
        for p in sent:
            groups.setdefault(p[:2], []).append(p)
        sent = [tuple(r.values()) for g in groups.values() for r in exchange._split(span)(exchange.table(g)).to_pylist()]
    got = []
    for place, _, kind, blob in sent:
        to, source, rows = exchange.opened([pa.scalar(blob, pa.binary())])
        assert set(to.tolist()) == {place}
        got += [(kind, place, int(i), bytes(r)) for i, r in zip(source, rows.T, strict=True)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("n_places", "fan"), [(605, 256), (605, 4096), (2500, 50)])
def test_a_task_on_the_way_holds_what_a_few_senders_sent(monkeypatch, n_places, fan):
    """Of 600 senders with a row for each place. Few spans must not bring together many senders, and few places need no step on the way."""
    monkeypatch.setattr(exchange, "FAN", fan)
    held, sent = {}, 0
    for sender in range(600):
        span, via = exchange.route(n_places, sender)
        sent = max(sent, -(-n_places // span))
        for to in range(-(-n_places // span)):
            held[to, via] = held.get((to, via), 0) + min(span, n_places - to * span)
    assert sent <= fan
    assert len(exchange.spans(n_places)) == (1 if n_places <= fan else 2)
    if n_places > fan:
        assert max(held.values()) <= 1.1 * n_places


def test_long_texts_in_slices_of_one_part(spark, monkeypatch):
    """Texts of hundreds of kilobytes that share most of their words, in one part of several slices, and short ones beside them."""
    monkeypatch.setattr(parts, "LEAST_PART", 1 << 30)
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(62_000)]
    rows = []
    for i in range(6):
        w = list(base)
        for _ in range(20):
            w[rng.randint(0, len(w) - 1)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(10 + i, " ".join(base[1000 * i : 1000 * i + rng.randint(30, 90)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert parts.deal(df, "doc_id", "text", ())[1] == 1 and sum(len(t) for _, t in rows) > 2 * substring_dedup.SLICE
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df).collect()}
    for (i, _), (u, g) in zip(rows, brute(rows, str.split, 50), strict=True):
        assert got[i] == (int(g.sum()), " ".join(np.array(u, object)[~g])), i
    short = [r for r in rows if r[0] >= 10] + [(100, rows[0][1][:120_000]), (101, rows[1][1][:120_000])]
    out = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    for (i, _), (u, g) in zip(short, brute(short, lambda t: list(t.encode()), 50), strict=True):
        assert out[i] == (int(g.sum()), bytes(np.array(u, np.uint8)[~g])), i


def test_splitters_come_from_a_sample(spark):
    df = spark.createDataFrame([(i, f"document {i} " * 30) for i in range(50)], "doc_id long, text string")
    cuts = suffix_dedup.splitters(df, "text", suffix_dedup.Grams(50), 8, 20_000)
    assert len(cuts) == 7 and (np.diff(cuts.astype(float)) > 0).all()


def test_keys_of_small_hashes_are_dealt_evenly():
    """Hashes of least grams are small numbers; their buckets must not be the first few."""
    n = [0] * 16
    for to, _, _, blob in parts.asked(np.arange(40_000, dtype=np.uint64) << np.uint64(20), np.zeros(40_000, np.int64), 0, 16):
        n[to] = len(exchange.opened([pa.scalar(blob, pa.binary())])[0])
    assert sum(n) == 40_000 and max(n) < 1.1 * min(n)

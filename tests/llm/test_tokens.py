import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import bpe, packing, token_files
from tessera.llm.tokenizer import word_tokenizer
from tests.llm.conftest import awkward_rows

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [r[1] for r in awkward_rows()] + ["Don't stop -- it's 3.14!!", "ÀÉÎ straße Ǆ ǅ ℌ 中文字 한국어 ü", "a  b   \n\n c\t", "\x85x\x1cy", "’quoted’ “text”  thin", "£5²½ ªº"]


def ids_by_library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORD).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_are_the_librarys():
    codes = word_tokenizer(WORD).encode(pa.array(TEXTS, pa.string()))
    assert word_tokenizer(WORD).by_word
    assert [codes[i].tolist() for i in range(len(codes))] == ids_by_library(TEXTS)


def test_other_tokenizers_encode_whole_texts():
    t = word_tokenizer(P.path("byte_bpe_50k.json"))
    codes = t.encode(pa.array(["a b", None, " c"], pa.string()))
    assert not t.by_word and len(codes) == 3 and len(codes[1]) == 0


def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_ids_are_tiktokens_and_round_trip():
    pairs, enc = bpe.byte_pairs(RANKS, P.PATTERN), tiktoken_encoding()
    codes = pairs.encode(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert codes[i].tolist() == enc.encode_ordinary(t or ""), repr(t)
        assert pairs.decode(codes[i]) == (t or "").encode()


def test_random_unicode_matches_tiktoken():
    rng, pairs, enc = np.random.default_rng(1), bpe.byte_pairs(RANKS, P.PATTERN), tiktoken_encoding()
    alphabet = list("ab cde  \n\t.'sé中  \x1c12") + ["'re", "  ", "\r\n"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(400)]
    codes = pairs.encode(pa.array(texts))
    assert [codes[i].tolist() for i in range(len(texts))] == [enc.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert h.candidates(keys).tolist() == list(range(2000))
    assert sorted(h.slot_key.tolist()) == list(range(2000))


def test_merges_pick_leftmost_of_equals():
    pairs, enc = bpe.byte_pairs(RANKS, P.PATTERN), tiktoken_encoding()
    for piece in (b"aaaaaaa", b"zqzqzqzqzq", "ééééé".encode(), b"x" * 3001):
        assert pairs.merged(piece) == enc._encode_single_piece(piece) or piece in pairs.ranks


@pytest.mark.parametrize("file_bytes", [1 << 24, 6000])
def test_token_files_hold_everything_in_order(spark, awkward, tmp_path, monkeypatch, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(awkward, folder, WORD, end_id=2)
    assert len(manifest) == 2 if file_bytes > 1 << 20 else len(manifest) > 3  # rows without an id have files of their own
    got = token_files.read_token_files(spark, folder).collect()
    text_hash = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63) & (1 << 64) - 1  # noqa: E731  in order as signed
    rows = [(r[0], [*ids, 2], text_hash(r[1])) for r, ids in zip(awkward_rows(), ids_by_library([r[1] for r in awkward_rows()]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], np.array(r[1], "<u2").tobytes())
    base, want = 0, []
    for i, ids, _ in sorted(rows, key=key):
        want.append((i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        base += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert not list(tmp_path.glob("files/.0*"))


def test_files_in_another_store_are_read_by_ranges(tmp_path):
    from pyarrow import fs

    values = np.arange(1000, dtype="<u2")
    (tmp_path / "x.bin").write_bytes(values.tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    for store, root in ((fs.LocalFileSystem(), tmp_path), (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "")):
        m = token_files.Mapped(store, f"{root}/x.bin".lstrip("/") if root == "" else f"{root}/x.bin", "<u2")
        assert len(m) == 1000 and (m[10:20] == values[10:20]).all() and (m[:] == values).all() and len(m[990:2000]) == 10
        assert len(token_files.Mapped(store, "none.bin" if root == "" else f"{root}/none.bin", "<u2")[:]) == 0


def test_no_rows_no_files(spark, empty, tmp_path):
    assert token_files.write_token_files(empty, f"file://{tmp_path}/none", WORD, 2) == []
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


# packing

def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(spark, awkward):
    rows = packing.best_fit_packing(awkward, WORD, capacity=64, end_id=0).collect()
    want = []
    for r, ids in zip(awkward_rows(), ids_by_library([r[1] for r in awkward_rows()]), strict=True):
        own = np.array([*ids, 0], "<u4")
        want += [(r[0], p, p * 64, len(own[p * 64 : p * 64 + 64]), zlib.crc32(own[p * 64 : p * 64 + 64].tobytes())) for p in range(-(-len(own) // 64))]
    assert sorted(map(tuple, (r[:5] for r in rows)), key=repr) == sorted(want, key=repr)
    n = np.array([r.length for r in rows])
    assert {(r.sequences, r.lower_bound) for r in rows} == {(check_packing(rows, 64), packing.lower_bound(n, 64))}
    assert packing.lower_bound(n, 64) <= check_packing(rows, 64) <= packing.lower_bound(n, 64) + 1


def stored(spark, tmp_path, n):
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "row long, length long").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_groups_exchange_until_near_the_bound(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(1, 101, 3000), np.full(500, 67), np.full(400, 34)])
    t = stored(spark, tmp_path, n)
    monkeypatch.setattr(packing, "FAN_IN", 8)
    places, sequences = packing.pack(t, 100, group=400)
    rows = places.join(t, "row").collect()
    assert len(rows) == len(n)
    bins, bound = check_packing(rows, 100), packing.lower_bound(n, 100)
    _, _, alone = packing.best_fit_decreasing(n, 100)
    assert bound <= bins == sequences <= len(alone) * 1.01


@pytest.mark.parametrize("length", [700, 431, 1040])
def test_lengths_that_never_fill_a_sequence_are_certified(spark, tmp_path, monkeypatch, length):
    """Pieces of one length, or about it, over many groups: the bound is met, little is given up, and no group outgrows its size."""
    rng = np.random.default_rng(length)
    n = length + rng.integers(-8, 9, 6000)
    sizes, whole = [], packing.written
    monkeypatch.setattr(packing, "FAN_IN", 8)
    monkeypatch.setattr(packing, "written", lambda df, name: sizes.append(whole(df, name)) or sizes[-1])
    t = stored(spark, tmp_path, n)
    places, sequences = packing.pack(t, 2048, group=400)
    bins = check_packing(places.join(t, "row").collect(), 2048)
    assert bins == sequences <= len(packing.best_fit_decreasing(n, 2048)[2]) * 1.01
    bound = packing.lower_bound(n, 2048)
    assert bound <= bins <= bound * 1.01 + 1
    for out in sizes:
        groups = out.groupBy((out.sequence_id / (1 << 24)).cast("long")).count().collect()
        assert max(r["count"] for r in groups) <= 400 * 1.4
    assert sizes[1].count() < len(n) / 8


def test_bounds_hold_for_every_packing():
    """No bound exceeds what an exhaustive search needs."""
    rng = np.random.default_rng(0)

    def fewest(left, rooms, best):
        if len(rooms) >= best or not left:
            return min(best, len(rooms)) if not left else best
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in rooms[:i]:
                best = fewest(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]], best)
        return fewest(left[1:], [*rooms, 24 - left[0]], best)

    for _ in range(60):
        n = rng.integers(1, 25, 8)
        assert packing.lower_bound(n, 24) <= fewest(sorted(n.tolist(), reverse=True), [], 9)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, filled = packing.best_fit_decreasing(np.array([70, 60, 30, 40]), 100)
    assert bins.tolist() == [0, 1, 0, 1] and filled.tolist() == [100, 100] and offsets.tolist() == [0, 0, 70, 60]


def test_bound_is_valid_and_beats_the_sum():
    n = np.array([51] * 10 + [10] * 3)
    assert packing.lower_bound(n, 100) == 10
    assert packing.lower_bound(np.array([100, 1]), 100) == 2


def test_a_lone_group_is_held_against_its_bound(spark):
    for lengths, used, bound in (([6, 5, 4, 3, 2], 2, 2), ([6, 6, 6, 3], 3, 3), ([4, 4, 4], 2, 2), ([4, 4, 3, 3, 3, 3], 3, 2)):
        places, sequences = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "row long, length long"), 10)
        assert (sequences, places.select("sequence_id").distinct().count(), packing.lower_bound(np.array(lengths), 10)) == (used, used, bound)


def test_packing_nothing(empty):
    assert packing.best_fit_packing(empty, WORD).count() == 0


def test_round_trip_of_awkward_rows(spark, awkward, empty):
    import hashlib

    enc, want = tiktoken_encoding(), []
    for r in awkward_rows():
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(awkward, RANKS, P.PATTERN).collect()), key=repr) == sorted(want, key=repr)
    assert all(bytes(r.decoded) in {(x[1] or "").encode() for x in awkward_rows()} for r in bpe.encode_decode(awkward, RANKS, P.PATTERN).collect())
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0

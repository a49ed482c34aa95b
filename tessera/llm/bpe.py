"""Byte-level BPE from a ranks file: whole pre-tokens by minimal perfect hash, the rest by merges.

First tier: every token of the vocabulary sits in a minimal perfect hash, so a
pre-token that is a token costs one lookup and one comparison of bytes. Second tier:
other pre-tokens are linked bytes, and a heap of mergeable neighbours gives the
lowest rank (leftmost first) until none is left.

Texts are cut into units (white space and the run that follows), within which the
split pattern cannot see the neighbours; distinct units are split and encoded once a
batch. Where a text holds white space outside ASCII, the whole text is one unit.
What a worker keeps between batches is bounded: a number of units and pre-tokens of bounded length.
Null texts are empty and have no tokens; no text is cut and none is changed. Each row is encoded for
itself, so null and repeated ids and repeated rows are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BYTE_POWERS, BYTE_TABLE, SPACES, Texts, mix, prefix, spans
from .exchange import release
from .units import PORTION, Codes, coded, gathered, portions, ranges

CACHED, SHORT, DECODE = 400_000, 32, 1 << 17


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: a displacement for each small bucket of keys.

    Buckets are placed from the largest; a bucket of one key stores its slot directly.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.n_buckets = len(keys), max(1, len(keys) // 3)
        h = self.hashes(keys)
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have one hash")
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        sizes = np.diff(at)
        free = np.ones(self.n, bool)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.slot_key = np.zeros(self.n, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[at[b] : at[b + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = self._slots(h[own][None, :], tries[:, None])
                good = free[slots].all(1)
                s = np.sort(slots, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    break
                d += 64
            self.shift[b], self.slot_key[slots[k]] = d + k, own
            free[slots[k]] = False
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - left
        self.slot_key[left] = order[at[:-1][single]]

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        n = np.fromiter(map(len, keys), np.int64, len(keys))
        end = np.cumsum(n)
        data = np.frombuffer(b"".join(keys), np.uint8)
        return spans(prefix(BYTE_TABLE[data], BYTE_POWERS), end - n, end, BYTE_POWERS)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The only key each string can be equal to, by number."""
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        return self.slot_key[np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0).astype(np.uint64)))]


def white_space_property(pattern: str) -> str:
    """The pattern with \\s and \\S spelt as the property, which leaves out four control characters that Python counts in."""
    return pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")


class BytePairs:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = list(self.ranks)
        self.token_ids = np.fromiter(self.ranks.values(), np.int64, len(self.tokens))
        self.whole, self.split = PerfectHash(self.tokens), regex.compile(white_space_property(pattern))
        by_id: list[bytes] = [b""] * (int(self.token_ids.max()) + 1)
        for t, i in self.ranks.items():
            by_id[i] = t
        n = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.bytes, self.byte_n, self.byte_at = np.frombuffer(b"".join(by_id), np.uint8), n, np.cumsum(n) - n
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the lowest-ranked neighbours merge first, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; parts are linked by their ends
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: those that are tokens in one sweep, the others by merging."""
        raw, out = [p.encode() for p in parts], {}
        for part, piece, k in zip(parts, raw, self.whole.candidates(raw).tolist() if raw else [], strict=True):
            ids = [self.token_ids[k]] if self.tokens[k] == piece else self.merged(piece)
            out[part] = np.array(ids, np.uint32).tobytes()
        return out

    @staticmethod
    def _keep(cache: dict[str, bytes], new: dict[str, bytes]) -> None:
        """Adds what is short, as long as there is room."""
        for k, v in new.items():
            if len(cache) >= CACHED:
                return
            if len(k) <= SHORT:
                cache[k] = v

    def encode(self, column: pa.Array) -> Codes:
        texts = Texts.of(column)
        starts, before = unit_starts(texts)
        if not len(starts):
            return Codes(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        bounds = np.append(starts, len(texts.data))
        distinct, which = coded(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts.data))))
        new = {u: self.split.findall(u) for u in distinct if u not in self.units}
        known = self.parts
        fresh = self._encode_parts(list(dict.fromkeys(p for ps in new.values() for p in ps if p not in known)))
        own = {u: b"".join([known[p] if p in known else fresh[p] for p in ps]) for u, ps in new.items()}
        del new
        ids = [own[u] if u in own else self.units[u] for u in distinct]
        self._keep(known, fresh)
        self._keep(self.units, own)
        del fresh, own
        return gathered(ids, which, before)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), DECODE):
            own = ids[a : a + DECODE]
            out.append(self.bytes[ranges(self.byte_at[own], self.byte_n[own])].tobytes())
        return b"".join(out)


def unit_starts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each unit, and the number of units before each document."""
    space = SPACES[texts.data]
    start = np.zeros(len(texts.data), bool)
    start[1:] = space[1:] & ~space[:-1]
    d = texts.data
    if len(d) > 2:
        wide = np.zeros(len(d), bool)
        for a in (0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(d[:-2] == a)
            b, c = d[at + 1], d[at + 2]
            if a == 0xC2:
                hit = (b == 0x85) | (b == 0xA0)
            elif a == 0xE1:
                hit = (b == 0x9A) & (c == 0x80)
            elif a == 0xE2:
                hit = ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))
            else:
                hit = (b == 0x80) & (c == 0x80)
            wide[at[hit]] = True
        wide[-2:] |= d[-2:] == 0xC2  # too near the end to look at: taken as wide
        for i in np.unique(np.searchsorted(texts.offsets, np.flatnonzero(wide), "right") - 1):
            start[texts.offsets[i] : texts.offsets[i + 1]] = False
    elif len(d):
        start[:] = False
    start[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, texts.offsets)


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (bytes of little-endian unsigned 32-bit integers), decoded (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks, pattern)
        for b in (p for whole in batches for p in portions(whole, "text")):
            codes = pairs.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codes[i].astype("<u4").tobytes() for i in range(len(codes))], pa.binary()), pa.array([pairs.decode(codes[i]) for i in range(len(codes))], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same round trip, with hashes in place of the ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks, pattern)
        for b in (p for whole in batches for p in portions(whole, "text", PORTION)):
            codes = pairs.encode(b.column("text"))
            each = [codes[i].astype("<u4", copy=False) for i in range(len(codes))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(codes.offsets)), pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()), pa.array([hashlib.sha256(pairs.decode(x)).hexdigest() for x in each], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

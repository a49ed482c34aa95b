"""Looking up what documents share, without pairs and without a hot group in one task.

Documents are dealt into parts by a hash of id and text (about PART_BYTES of text each; rows
without an id and rows that repeat one are spread like others). Within a part they are in
order of id, then text, so a place in a part's text means the same in every pass. A part
reduces what it asks to distinct rows before anything is shuffled, so a passage held by
a third of all documents is sent once by each part. What parts send goes to buckets by packets (see exchange):

  part -> keys of anchors -> bucket -> which are shared -> part -> entries -> bucket -> answers -> part

The passes over the texts read one exchange, which Spark plans once. Nothing is
collected, so an executor that is lost costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .arrowtext import mix
from .exchange import integers, planes

PART_BYTES, LEAST_PART = 4 << 20, 256 << 10
LEAST_BUCKETS, PARTS_A_BUCKET = 48, 4
KEY_BYTES = 6
#: Kinds of packets.
KEYS, ENTRIES, NOTES = 0, 1, 2


def deal(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], part_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """The documents with their part (of about `part_bytes`), the number of parts, and the bytes of text. One aggregate over the texts gives the bytes."""
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-size // (part_bytes or PART_BYTES)), min(wanted, size // LEAST_PART))  # small inputs still use the cluster's tasks
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *kept, F.xxhash64(text).alias("text_hash"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int")), n, size


def buckets(n_parts: int) -> int:
    return max(LEAST_BUCKETS, -(-n_parts // PARTS_A_BUCKET))


def ordered(t: pa.Table) -> pa.Table:
    """A part in the order that every pass sees: by id (none last), then text."""
    return t.sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("text", "ascending")]) if t.num_rows else t


def _key(hashes: np.ndarray) -> np.ndarray:
    """47 bits of hashes, mixed again: those of least grams are small numbers, and buckets are ranges of keys."""
    return mix(hashes) >> np.uint64(17)


def asked(hashes: np.ndarray, docs: np.ndarray, part: int, n_buckets: int) -> Iterator[tuple]:
    """The part's distinct keys (47 bits of the hashes); the lowest bit tells that two of its documents hold one."""
    key = _key(hashes)
    order = np.argsort(key, kind="stable")
    k, d = key[order], docs[order]
    first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0) if len(k) else np.zeros(0, np.int64)
    two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else np.zeros(0, bool)
    k = k[first]
    to = (((k >> np.uint64(15)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
    return exchange.packed(KEYS, to, part, planes((k << np.uint64(1)) | two.astype(np.uint64), KEY_BYTES), *exchange.route(n_buckets, part))


def shared_keys(t: pa.Table, n_parts: int) -> pa.Table:
    """For each part those of its keys that another document holds."""
    to, part, rows = exchange.of_kind(t, KEYS)
    if not len(to):
        return exchange.table([])
    bucket, key = int(to[0]), integers(rows, 0, KEY_BYTES)
    order = np.argsort(key >> np.uint64(1), kind="stable")
    key, part = key[order], part[order]
    del order, rows
    at = np.flatnonzero(np.diff(key >> np.uint64(1), prepend=np.uint64(1 << 63)))
    n = np.diff(np.append(at, len(key)))
    shared = np.flatnonzero(np.repeat((n > 1) | (np.maximum.reduceat(key & np.uint64(1), at) == 1), n))
    return exchange.table(exchange.packed(KEYS, part[shared], bucket, planes(key[shared] >> np.uint64(1), KEY_BYTES), *exchange.route(n_parts, bucket)))


class Shared:
    """Membership of hashes in the answers of shared_keys."""

    def __init__(self, answers: pa.Table) -> None:
        _, _, rows = exchange.of_kind(answers, KEYS)
        self.keys = np.sort(integers(rows, 0, KEY_BYTES)) if rows.size else np.zeros(0, np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        own = _key(hashes)
        return self.keys[np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)] == own


def answered(dealt: DataFrame, n_parts: int, n_ranges: int, keys: Callable, entries: Callable, settle: Callable) -> DataFrame:
    """Packets for the parts, by the plan described above.

    keys(table) gives hashes and documents' ids; entries(table, shared, part) gives packets for buckets 0 to n_ranges - 1;
    settle(table) gives packets for the parts. Tables of documents are ordered.
    """
    n_buckets = buckets(n_parts)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        hashes, docs = keys(ordered(t))
        out = exchange.table(asked(hashes, docs, key[0].as_py(), n_buckets))
        exchange.release()
        return out

    def tell_shared(t: pa.Table) -> pa.Table:
        out = shared_keys(t, n_parts)
        exchange.release()
        return out

    def put(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return exchange.table([])
        out = exchange.table(entries(ordered(t), Shared(answers), key[0].as_py()))
        exchange.release()
        return out

    def tell(t: pa.Table) -> pa.Table:
        out = exchange.table(settle(t))
        exchange.release()
        return out

    asked_for = exchange.delivered(dealt.groupBy("part").applyInArrow(ask, exchange.PACKET), n_buckets)
    shared = exchange.delivered(asked_for.groupBy("to").applyInArrow(tell_shared, exchange.PACKET), n_parts)
    offered = exchange.delivered(dealt.groupBy("part").cogroup(shared.groupBy("to")).applyInArrow(put, exchange.PACKET), n_ranges)
    return exchange.delivered(offered.groupBy("to").applyInArrow(tell, exchange.PACKET), n_parts)

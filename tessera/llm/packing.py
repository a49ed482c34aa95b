"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt
into groups; each group packs its own by best-fit decreasing and computes the best of three
families of dual-feasible-function bounds, which no packing of it can beat. A group whose
count meets its bound is certified and keeps all but its emptiest bin; one with a gap gives up
its emptiest bins, as long as these hold no more than a sixty-fourth of a group's pieces. What is given up is
dealt to a sixty-fourth as many groups and packed again, so groups exchange documents and a group never
holds much more than GROUP pieces. Rounds end when one group is left or when a round needs as many
sequences as it was given.

The whole packing is certified too: its number of sequences and the bound over all pieces, from the
number of pieces of each length, stand beside every place.

Null texts are empty documents of one end id; repeated rows are pieces of their own; an
empty table gives no rows. Texts whose pieces tie in length are packed in order of row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import doc_ids, id_column
from .exchange import release
from .store import written
from .tokenizer import word_tokenizer
from .units import portions

GROUP, FAN_IN, MOST_PARTS = 20_000, 64, 64


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """bound_of_counts() for a list of lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing can beat, from the number of pieces of each length up to the capacity.

    Each function f below has sum f(x) <= f(capacity) over any pieces that fit one sequence:
    - f_e: capacity over capacity - e, 0 under e, x between;
    - u_k after f_e: k parts of a sequence, floor((k + 1) x / capacity) of them, or (k + 1) x / capacity * k / (k + 1) where that is whole;
    - c_w: twice floor(x / w) up to half the capacity, floor(capacity / w) at half, what the rest of a sequence leaves above.
    """
    x = np.arange(capacity + 1)
    n, whole = np.cumsum(count), int((count * x).sum())
    e = np.arange(1, capacity // 2 + 1)
    large = n[capacity] - n[capacity - e]
    best = -(-whole // capacity)

    def after_e(value: np.ndarray, full: int) -> int:
        s = np.cumsum(count * value)
        return int((-(-(large * full + s[capacity - e] - s[e - 1]) // full)).max(initial=0))

    best = max(best, after_e(x, capacity))
    for k in range(1, MOST_PARTS + 1):
        parts, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, parts * k, parts * (k + 1))  # in k (k + 1)ths of a sequence
        best = max(best, -(-int((count * value).sum()) // (k * (k + 1))), after_e(value, k * (k + 1)))
    some = np.flatnonzero(count)
    low, middle, high = some[2 * some < capacity], some[2 * some == capacity], some[2 * some > capacity]
    for w in range(1, capacity // 2 + 1):
        full = capacity // w
        total = 2 * int((low // w * count[low]).sum()) + full * int(count[middle].sum()) + 2 * int(((full - (capacity - high) // w) * count[high]).sum())
        best = max(best, -(-total // (2 * full)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds. Bins are found by the bits of a mask of the rooms left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, filled = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = mask >> n
        if fit:
            room = (fit & -fit).bit_length() - 1 + n
            k = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            k, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = k, filled[k]
        filled[k] += n
        by_room[room - n].append(k)
        mask |= 1 << (room - n)
    return bins, offsets, np.array(filled, np.int64)


def given_up(filled: np.ndarray, n_pieces: np.ndarray, bound: int, capacity: int, most: int) -> np.ndarray:
    """Which bins a group gives up: its emptiest, and with a gap more of the emptiest, of at most `most` pieces together."""
    out = np.zeros(len(filled), bool)
    order = np.argsort(filled, kind="stable")
    order = order[filled[order] < capacity]
    if len(filled) > bound:
        out[order[np.cumsum(n_pieces[order]) <= most]] = True
    out[order[:1]] = True
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_tokenizer(tokenizer), np.array([end_id], np.uint32)
        for b in (p for whole in batches for p in portions(whole, "text")):
            codes, ids = encoder.encode(b.column("text")), doc_ids(b.column("doc_id"))
            n = np.diff(codes.offsets) + 1
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            crc = []
            for i in range(len(n)):
                own = np.concatenate([codes[i], end])
                crc += [zlib.crc32(own[a : a + capacity]) for a in range(0, len(own), capacity)]
            yield pa.RecordBatch.from_arrays([id_column(ids[doc]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: DataFrame, capacity: int, group: int = GROUP) -> tuple[DataFrame, int]:
    """sequence_id and offset for each row of lengths (row long, length long), which must be a stored table, and the number of sequences."""

    most = group // FAN_IN

    def packed(round_no: int, last: bool):
        def one(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("row", "ascending")])
            n = t["length"].to_numpy()
            bins, offsets, filled = best_fit_decreasing(n, capacity)
            up = np.zeros(len(filled), bool) if last else given_up(filled, np.bincount(bins, minlength=len(filled)), lower_bound(n, capacity), capacity, most)
            number = (round_no << 56) + (key[0].as_py() << 24) + bins
            release()
            return pa.table({"row": t["row"], "length": t["length"], "sequence_id": pa.array(number), "offset": pa.array(offsets), "open": pa.array(up[bins])})

        return one

    n_groups, round_no, settled, rows, sequences, given = max(1, -(-lengths.count() // group)), 0, None, lengths, 0, None
    while True:
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(n_groups)))
        out = written(dealt.groupBy("g").applyInArrow(packed(round_no, n_groups == 1), "row long, length long, sequence_id long, offset long, open boolean"), "packing")
        first = F.col("offset") == 0  # one piece of each sequence
        made, passed = out.agg(F.count_if(first), F.count_if(first & F.col("open"))).first()
        done = not passed or (given is not None and made >= given)
        sequences += made if done else made - passed
        closed = (out if done else out.where(~F.col("open"))).select("row", "sequence_id", "offset")
        settled = closed if settled is None else settled.unionByName(closed)
        if done:
            return settled, sequences
        rows, n_groups, round_no, given = out.where("open").select("row", "length"), -(-n_groups // FAN_IN), round_no + 1, passed


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place; and, the same in every row, sequences and lower_bound."""
    rows = written(pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # a row a length
        count[length] = n
    places, sequences = pack(rows.select("row", "length"), capacity)
    out = rows.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return out.withColumns({"sequences": F.lit(sequences).cast("long"), "lower_bound": F.lit(bound_of_counts(count, capacity)).cast("long")})

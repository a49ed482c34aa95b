"""Repeated pieces of text encoded once: dictionary of distinct pieces, then a gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GATHER, PORTION = 1 << 19, 10 << 20


def portions(batch: pa.RecordBatch, column: str | int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text (one row at least), so that working arrays stay small."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Codes:
    """Token ids of documents, flat, with offsets."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.offsets = ids, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after another."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def gathered(distinct: list[bytes], which: np.ndarray, pieces_before: np.ndarray) -> Codes:
    """Ids of documents whose pieces are which[pieces_before[i]:pieces_before[i + 1]]; distinct: each piece's ids as uint32 bytes."""
    flat = np.frombuffer(b"".join(distinct), np.uint32)
    n = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
    start = np.cumsum(n) - n
    own = n[which]
    before = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(int(before[-1]), np.uint32)
    for a in range(0, len(which), GATHER):
        w = which[a : a + GATHER]
        out[before[a] : before[a + len(w)]] = flat[ranges(start[w], own[a : a + GATHER])]
    return Codes(out, before[pieces_before])


def coded(pieces: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct pieces and each piece's place among them."""
    d = pieces.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)

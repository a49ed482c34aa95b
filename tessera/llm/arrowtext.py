"""Texts of an Arrow batch as flat numpy arrays: bytes, word spans, rolling hashes.

All hashing is vectorised: a prefix sum of ``table[byte] * base**i`` (mod 2**64)
gives the hash of any span by one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents without an id sort after all others.
NO_ID = np.iinfo(np.int64).max
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that sums of hashes lose their structure."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = np.uint64(pow(self.base, len(self.up), 1 << 64)), np.uint64(pow(self.inverse, len(self.up), 1 << 64))
            self.up, self.down = (np.concatenate([x, x * y]) for x, y in zip((self.up, self.down), k, strict=True))


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values * base**i, with a leading zero."""
    powers.reach(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents and lengths."""
    return mix((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


class Texts:
    """Documents in row order: flat bytes and their offsets. Null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = column.cast(pa.large_binary()).fill_null(b"")
        n, (_, offsets, data) = len(column), column.buffers()
        if not n:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def slices(self, most: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
        """Runs of whole documents of about `most` bytes (one document at least), with the first row of each."""
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + most, "right")) - 1)
            yield at, Texts(self.data[self.offsets[at] : self.offsets[to]], self.offsets[at : to + 1] - self.offsets[at])
            at = to

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word (a run of bytes that are no ASCII space), and the first word of each document."""
        solid = ~SPACES[self.data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        before[inner], after[inner - 1] = False, False
        start = np.flatnonzero(solid & ~before)
        return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and the first word of each document."""
        start, end, first = self.words()
        return spans(prefix(BYTE_TABLE[self.data], BYTE_POWERS), start, end, BYTE_POWERS), first


def doc_ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; nulls become NO_ID."""
    return np.asarray(column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(), np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    """The reverse of doc_ids."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)

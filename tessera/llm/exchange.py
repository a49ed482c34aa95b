"""Rows of a fixed width on their way between numbered places, in few packets.

A packet holds many rows, each with the place it goes to and the one it comes from, as
planes of bytes (all first bytes, then all second ones, ...) or row by row, compressed. A
place sends at most FAN packets, so the number of packets is in proportion to the number of
senders at every size. Up to FAN places get their packets at once, as every further step writes all rows anew.
Where there are more, packets go to spans of places first and are split again on the way. There as many senders come
together as each has spans to send to, so a task on the way holds about as much as one sender sent.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN, HEAD = 4096, 13
_CODEC = pa.Codec("zstd", 1)
PACKET = "to int, via int, kind int, blob binary"
_SCHEMA = pa.schema([("to", pa.int32()), ("via", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def release() -> None:
    """Gives freed memory back to the system, so that a worker that lives on does not keep its largest task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def fan(n_places: int) -> int:
    """How many spans a packet is split into at each step, and how many senders come together there: no more than the fewest steps need."""
    steps, out = 1, 1
    while FAN**steps < n_places:
        steps += 1
    while out**steps < n_places:
        out += 1
    return max(out, 2)


def spans(n_places: int) -> list[int]:
    """How many places a packet is for at each step, the last one first step's finest: ..., fan, 1."""
    out = [1]
    while out[0] * fan(n_places) < n_places:
        out.insert(0, out[0] * fan(n_places))
    return out


def route(n_places: int, sender: int) -> tuple[int, int]:
    """The span of a sender's packets, and with which senders they come together."""
    return spans(n_places)[0], sender // fan(n_places)


def planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of each integer, as n planes."""
    return np.ascontiguousarray(x).astype("<i8" if x.dtype.kind == "i" else "<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :n].T


def integers(rows: np.ndarray, at: int, n: int) -> np.ndarray:
    """The unsigned integers of n planes from the given one on."""
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :n] = rows[at : at + n].T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def packed(kind: int, to: np.ndarray, source: np.ndarray | int, rows: np.ndarray, span: int, via: int, by_row: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
    """Packets of rows (planes) for each span of places that gets some. Neighbouring rows that are much alike are smaller row by row."""
    n = len(to)
    if not n:
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    whole = np.vstack([planes(to.astype(np.int64), 4), planes(np.broadcast_to(np.asarray(source, np.int64), n)[order if np.ndim(source) else slice(None)], 4), rows[:, order]])
    coarse = to // span
    at = np.flatnonzero(np.diff(coarse, prepend=-1))
    for a, b in zip(at, np.append(at[1:], n), strict=True):
        own = np.ascontiguousarray(whole[:, a:b].T if by_row else whole[:, a:b])
        head = len(whole).to_bytes(4, "little") + own.nbytes.to_bytes(8, "little") + bytes([by_row])
        yield int(coarse[a]), via, kind, head + _CODEC.compress(own, asbytes=True)


def opened(blobs: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where to, where from, and planes of all rows of some packets of one kind."""
    found = []
    for b in blobs:
        raw = b.as_buffer()
        head = raw[:HEAD].to_pybytes()
        width, size, by_row = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:12], "little"), head[12]
        rows = np.frombuffer(_CODEC.decompress(raw[HEAD:], size), np.uint8)
        found.append(rows.reshape(-1, width).T if by_row else rows.reshape(width, -1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.uint8)
    whole = np.concatenate(found, 1)
    return integers(whole, 0, 4).astype(np.int64), integers(whole, 4, 4).astype(np.int64), whole[8:]


def of_kind(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """opened() for a table's packets of one kind."""
    kinds = t["kind"].to_numpy()
    return opened(b for b, k in zip(t["blob"], kinds, strict=True) if k == kind)


def table(rows: Iterable[tuple]) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, _SCHEMA, strict=True)], schema=_SCHEMA)


def _split(span: int, together: int | None = None):
    def split(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        via = int(t["via"][0].as_py()) // (together or FAN)
        for kind in np.unique(t["kind"].to_numpy()).tolist():
            to, source, rows = of_kind(t, kind)
            out += packed(kind, to, source, rows, span, via, not rows.flags.c_contiguous)
        release()
        return table(out)

    return split


def delivered(packets: DataFrame, n_places: int) -> DataFrame:
    """The packets with `to` as the place itself: split again as long as they are for spans of places."""
    for span in spans(n_places)[1:]:
        packets = packets.groupBy("to", "via").applyInArrow(_split(span, fan(n_places)), PACKET)
    return packets

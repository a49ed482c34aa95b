"""Exact byte-level deduplication by a range-partitioned, sampled suffix array.

Sorting every suffix of the corpus would shuffle many times its size. Every
`window`-byte string holds exactly one leftmost least k-byte gram by a fixed hash
order; it depends on the string alone, so equal strings, wherever they start, own
the same gram at the same offset. Only the suffixes at such grams are sorted, each
with the bytes before it that its windows reach; grams no other document holds are
left out first. Splitters, from a sample of all documents, deal the suffixes by their leading
bytes to ranges; each range sorts locally by multikey quicksort, eight bytes a step.
Equal grams share their leading bytes, so no group of equal strings crosses a
boundary; what does cross, the documents themselves, is settled by the answers each
range sends back to the parts.

Hashes only choose grams and find what may be equal: a part compares the bytes of its own
repeats, and a range compares the bytes of all it is sent. A suffix is named by its place
in its part, so answers go by places. A gram with very many different surroundings is settled
by offset and, within that, in portions by content.

A byte goes if a `window`-byte string that covers it also starts in a document with a
smaller id. Null texts are empty; texts shorter than the window keep all; rows without
an id come after all others; rows that repeat an id do not remove each other's bytes;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, parts
from .arrowtext import BYTE_POWERS, BYTE_TABLE, Texts, doc_ids, id_column, mix, prefix, spans
from .exchange import integers, planes

SLICE, CHUNK, PORTION = 1 << 18, 1 << 14, 1 << 17
#: Sampled suffixes a range, and the bytes of text of which one document in SAMPLED is looked at.
SAMPLES, SAMPLED, SMALL = 64, 16, 64 << 20


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian words: three-way by one word, and only ties go on to the next."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(order), bool)
    if len(order) > 1:
        tied[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for j in range(1, words.shape[1]):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        sub = order[at]
        again = np.lexsort((words[sub, j], group))
        order[at] = sub[again]
        eq = np.zeros(len(at), bool)
        eq[1:] = (words[order[at[1:]], j] == words[order[at[:-1]], j]) & (group[1:] == group[:-1])
        tied[at] = eq
    return order


class Grams:
    """Where the windows' least grams lie: for runs of windows with one gram the gram's place, first and last window."""

    def __init__(self, window: int) -> None:
        if not 8 <= window <= 78:
            raise ValueError("the window must be of 8 to 78 bytes")
        self.window, self.k = window, max(4, window * 2 // 5)
        self.reach = min(window - self.k, 31)  # gram places before a window's last
        self.k = window - self.reach
        self.row = -(-(window + self.reach + 2) // 8) * 8

    def runs(self, t: Texts) -> tuple[np.ndarray, ...]:
        """gram, first, last (places in t), document, gram hash, run hash."""
        n = len(t.data) - self.k + 1
        counts = np.maximum(np.diff(t.offsets) - self.window + 1, 0)
        doc = np.repeat(np.arange(len(t)), counts)
        if n <= 0 or not len(doc):
            return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        start = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc] + t.offsets[doc]
        sums = prefix(BYTE_TABLE[t.data], BYTE_POWERS)
        place = np.arange(n)
        h = spans(sums, place, place + self.k, BYTE_POWERS)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
        width, most = 1, self.reach + 1
        while 2 * width <= most:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < most:
            least = np.minimum(least[: len(least) - (most - width)], least[most - width :])
        gram = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.diff(gram, prepend=-1))
        first, last = start[at], start[np.append(at[1:], len(gram)) - 1]
        gram = gram[at]
        run = spans(sums, first, last + self.window, BYTE_POWERS)
        return gram, first, last, doc[at], h[gram], mix(run + (gram - first).astype(np.uint64))

    def rows(self, data: np.ndarray, gram: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The suffix at each gram, the bytes before it in reverse, their number and the run's length."""
        out = np.zeros((len(gram), self.row), np.uint8)
        ahead, back = np.arange(self.window), np.arange(1, self.reach + 1)
        for a in range(0, len(gram), CHUNK):
            g, f, e = gram[a : a + CHUNK, None], first[a : a + CHUNK, None], last[a : a + CHUNK, None] + self.window
            at = g + ahead
            out[a : a + CHUNK, : self.window] = np.where(at < e, data[np.minimum(at, e - 1)], 0)
            at = g - back
            out[a : a + CHUNK, self.window : self.window + self.reach] = np.where(at >= f, data[np.maximum(at, f)], 0)
        out[:, -2], out[:, -1] = gram - first, last + self.window - first
        return out

    def contents(self, rows: np.ndarray) -> np.ndarray:
        """The runs' bytes from their first window on, padded with zeros."""
        j, left = np.arange(self.window + self.reach), rows[:, -2:-1].astype(np.int64)
        at = np.where(j < left, self.window + left - 1 - j, j - left)
        return np.where(j < rows[:, -1:], np.take_along_axis(rows, np.clip(at, 0, self.row - 3), 1), 0).astype(np.uint8)


def big_endian(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    rows = np.pad(rows, ((0, 0), (0, pad))) if pad else rows
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def windows_of(g: Grams, segs: np.ndarray, which: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The bytes of some windows of some runs."""
    out = np.empty((len(which), g.window), np.uint8)
    for a in range(0, len(which), CHUNK):
        w, k = which[a : a + CHUNK], nth[a : a + CHUNK]
        own, inverse = np.unique(w, return_inverse=True)
        out[a : a + CHUNK] = np.lib.stride_tricks.sliding_window_view(g.contents(segs[own]), g.window, axis=1)[inverse, k]
    return out


def windows_share(g: Grams, segs: np.ndarray, which: np.ndarray, nth: np.ndarray, shares: int) -> np.ndarray:
    """A number below `shares` for each window, by its content."""
    if shares < 2:
        return np.zeros(len(which), np.int64)
    out = np.empty(len(which), np.int64)
    for a in range(0, len(which), CHUNK):
        h = np.zeros(len(which[a : a + CHUNK]), np.uint64)
        for column in big_endian(windows_of(g, segs, which[a : a + CHUNK], nth[a : a + CHUNK])).T:
            h = mix(h ^ column)
        out[a : a + CHUNK] = (h % np.uint64(shares)).astype(np.int64)
    return out


def settle_windows(g: Grams, segs: np.ndarray, which: np.ndarray, nth: np.ndarray, seg_min: np.ndarray, least: np.ndarray) -> None:
    """Sets the least id of each of these windows, which hold all that can be equal to one another."""
    if not len(which):
        return
    w = big_endian(windows_of(g, segs, which, nth))
    o = multikey_order(w)
    fresh = np.ones(len(o), bool)
    fresh[1:] = (w[o[1:]] != w[o[:-1]]).any(1)
    at = np.flatnonzero(fresh)
    low = np.minimum.reduceat(seg_min[which[o]], at)
    least[which[o], nth[o]] = np.repeat(low, np.diff(np.append(at, len(o))))


def settle_range(g: Grams, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row a bit mask of its windows that also start in a document with a smaller id."""
    words = big_endian(rows)
    order = multikey_order(words)
    ids_s, new = ids[order], np.zeros(len(rows), bool)
    new[:1] = True
    for column in words.T:
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    del words
    seg_at = np.flatnonzero(new)
    seg = np.cumsum(new) - 1
    seg_min = np.minimum.reduceat(ids_s, seg_at)
    segs = rows[order[seg_at]]
    gram_new = np.ones(len(segs), bool)
    gram_new[1:] = (segs[1:, : g.k] != segs[:-1, : g.k]).any(1)
    group_at = np.flatnonzero(gram_new)
    size = np.diff(np.append(group_at, len(segs)))
    several = np.repeat(size > 1, size)
    n_windows = segs[:, -1].astype(np.int64) - g.window + 1
    least = np.repeat(seg_min[:, None], g.reach + 1, 1)  # least id by run and window
    todo = np.flatnonzero(several)
    total = np.concatenate([[0], np.cumsum(n_windows[todo])])
    ends, at = np.cumsum(size[size > 1]), 0  # groups among those to do
    while at < len(todo):
        last = max(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(total[ends], total[at] + PORTION, "right")) - 1)
        end = int(ends[last])
        own = todo[at:end]
        if total[end] - total[at] <= PORTION:
            n = n_windows[own]
            settle_windows(g, segs, np.repeat(own, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), seg_min, least)
        else:  # one gram, many surroundings: equal windows hold it at one offset and have one content
            left = segs[own, -2].astype(np.int64)
            for offset in range(g.reach + 1):
                nth = left - offset
                held = (nth >= 0) & (nth < n_windows[own])
                of, nth = own[held], nth[held]
                shares = -(-len(of) // PORTION)
                share = windows_share(g, segs, of, nth, shares)
                for k in range(shares):
                    settle_windows(g, segs, of[share == k], nth[share == k], seg_min, least)
        at = end
    bits = np.zeros(len(rows), np.uint32)
    for j in range(g.reach + 1):
        bits |= ((least[seg, j] < ids_s) & (j < n_windows[seg])).astype(np.uint32) << np.uint32(j)
    out = np.zeros(len(rows), np.uint32)
    out[order] = bits
    return out


def splitters(docs: DataFrame, text_col: str, g: Grams, n: int, size: int) -> np.ndarray:
    """At most n - 1 leading words that part a sample of suffixes evenly; they set the balance, not the result.

    Documents are chosen by a hash of their text from all partitions, and suffixes by their grams' hash, so that about
    SAMPLES * n leading words of eight bytes reach the driver at every size of input.
    """
    text = F.col(text_col).cast("string")
    some = docs.where(text.isNotNull()).select(text.alias("text"))
    one_in = SAMPLED if size > SMALL else 1
    some = some.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(one_in)) == 0)
    step = max(1, size // 16 // one_in // (SAMPLES * n))  # about one suffix in 16 bytes

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in Texts.of(b.column("text")).slices(SLICE):
                gram, _, _, _, h, _ = g.runs(t)
                keys = leading(t.data, gram[(h >> np.uint64(20)) % np.uint64(step) == 0])
                yield pa.RecordBatch.from_arrays([pa.array([np.unique(keys).astype("<u8").tobytes()], pa.binary())], names=["keys"])

    found = [np.frombuffer(r[0], "<u8") for r in some.mapInArrow(sample, "keys binary").collect()]
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)  # what many batches hold, many parts will send
    return np.unique(keys[np.arange(1, n) * len(keys) // n]) if len(keys) else keys


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[np.minimum(at + j, max(0, len(data) - 1))].astype(np.uint64)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and carry_0, ... for the carried columns."""
    g = Grams(window)
    dealt, n_parts, size = parts.deal(docs, id_col, text_col, carry)
    cuts = splitters(docs, text_col, g, max(parts.LEAST_BUCKETS, n_parts), size)
    n_ranges = len(cuts) + 1

    def keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, hashes, docs_of = doc_ids(t["doc_id"]), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, s in Texts.of(t["text"]).slices(SLICE):
            _, _, _, doc, h, _ = g.runs(s)
            hashes.append(h)
            docs_of.append(ids[doc + at])
        return np.concatenate(hashes), np.concatenate(docs_of)

    def entries(t: pa.Table, shared: parts.Shared, part: int) -> Iterator[tuple]:
        ids, text, found = doc_ids(t["doc_id"]), Texts.of(t["text"]), []
        for at, s in text.slices(SLICE):
            gram, first, last, doc, h, run = g.runs(s)
            own = np.flatnonzero(shared.has(h))
            base = int(text.offsets[at])
            found.append((run[own], ids[doc[own] + at], gram[own] + base, first[own] + base, last[own] + base))
        run, doc, gram, first, last = (np.concatenate([f[i] for f in found]) for i in range(5))
        del found
        # the first of equal runs has the least id; equal hashes are held to be equal runs only if their bytes are
        _, pick, inverse = np.unique(run, return_index=True, return_inverse=True)
        rep = pick[inverse]
        again = np.flatnonzero(rep != np.arange(len(run)))
        same = np.ones(len(again), bool)
        for a in range(0, len(again), CHUNK):
            x, y = again[a : a + CHUNK], rep[again[a : a + CHUNK]]
            same[a : a + CHUNK] = (g.rows(text.data, gram[x], first[x], last[x]) == g.rows(text.data, gram[y], first[y], last[y])).all(1)
        pick, again = np.sort(np.concatenate([pick, again[~same]])), again[same]
        span, via = exchange.route(n_ranges, part)
        lead = leading(text.data, gram[pick])
        pick = pick[np.argsort(lead, kind="stable")]
        to = np.searchsorted(cuts, np.sort(lead), "right")
        rows = np.vstack([g.rows(text.data, gram[pick], first[pick], last[pick]).T, planes(doc[pick], 8), planes(first[pick], 8)])
        yield from exchange.packed(parts.ENTRIES, to, part, rows, span, via, by_row=True)
        # what repeats inside the part, by way of a range that only hands it on
        rows = np.vstack([planes(x, 8) for x in (first[again], last[again] - first[again], first[rep[again]], (doc[rep[again]] < doc[again]).astype(np.int64))])
        yield from exchange.packed(parts.NOTES, np.full(len(again), part % n_ranges), part, rows, span, via)

    def settle(t: pa.Table) -> Iterator[tuple]:
        span, via = exchange.route(n_parts, int(t["to"][0].as_py()))
        _, part, rows = exchange.of_kind(t, parts.NOTES)
        yield from exchange.packed(parts.NOTES, part, part, rows, span, via)
        _, part, rows = exchange.of_kind(t, parts.ENTRIES)
        if not len(part):
            return
        ids, first = integers(rows, g.row, 8).astype(np.int64), integers(rows, g.row + 8, 8)
        rows = np.ascontiguousarray(rows[: g.row].T)
        mask = settle_range(g, rows, ids)
        hit = np.flatnonzero(mask)
        yield from exchange.packed(parts.ENTRIES, part[hit], part[hit], np.vstack([planes(first[hit], 8), planes(mask[hit].astype(np.uint64), 4)]), span, via)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = parts.ordered(t)
        ids, text = doc_ids(t["doc_id"]), Texts.of(t["text"])
        _, _, rows = exchange.of_kind(answers, parts.ENTRIES)
        first, bits = (integers(rows, 0, 8).astype(np.int64), integers(rows, 8, 4)) if rows.size else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(first)
        first, bits = first[order], bits[order]
        _, _, rows = exchange.of_kind(answers, parts.NOTES)
        if rows.size:  # repeats lose all that a smaller document of the part has, else what their like loses
            own, more, like, all_of = (integers(rows, i, 8).astype(np.int64) for i in (0, 8, 16, 24))
            told = np.zeros(len(own), np.uint64)
            if len(first):
                at = np.minimum(np.searchsorted(first, like), len(first) - 1)
                told = np.where(first[at] == like, bits[at], 0).astype(np.uint64)
            told = np.where(all_of == 1, (np.uint64(2) << more.astype(np.uint64)) - np.uint64(1), told)
            first, bits = np.concatenate([first, own]), np.concatenate([bits, told])
        cover = np.zeros(len(text.data) + 1, np.int32)
        for j in range(g.reach + 1):
            w = first[(bits >> np.uint64(j)) & np.uint64(1) == 1] + j
            np.add.at(cover, w, 1)
            np.add.at(cover, w + window, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        del cover
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = text.offsets[:-1][np.diff(text.offsets) > 0]
        starts[inner] = gone[inner]
        n_removed, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[text.offsets]) for x in (gone, starts))
        kept = [text[i] if not n_removed[i] else text.data[a:b][~gone[a:b]].tobytes() for i, (a, b) in enumerate(zip(text.offsets[:-1], text.offsets[1:], strict=True))]
        out = {"doc_id": id_column(ids), "n_bytes": pa.array(np.diff(text.offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept": pa.array(kept, pa.binary())}
        out = pa.table(out | {f"carry_{i}": t[f"carry_{i}"] for i in range(len(carry))})
        exchange.release()
        return out

    answers = parts.answered(dealt, n_parts, n_ranges, keys, entries, settle)
    kinds = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return dealt.groupBy("part").cogroup(answers.groupBy("to")).applyInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{kinds}")

"""Substring deduplication over words, by difference-cover anchors.

A window is `window` consecutive words. Anchors are shorter runs of words that start
at those positions of a document which, modulo a period, lie in a difference cover:
for any two positions some shift below the period takes both into the cover, so two
documents that share a window share an anchor at the same place inside it. Only anchors
(about a fifth of all positions) are hashed at first; those that another document
holds are extended to both sides, to the windows they lie in, which are looked up by 96 bits of hash. A
part looks up each distinct window once and keeps a note of where it repeats. Neighbouring
windows found at neighbouring places of one other document are one match; its words are
sent to the part that holds that document and compared there, letter by letter.

So a word goes if and only if a window that covers it also starts in a document with a smaller
id: equal windows have equal hashes, and should two different ones have too, the
comparison stops the job with an error that asks for another `seed`.

Null texts have no words; documents shorter than the window keep all; rows without an id
come after all others; rows that repeat an id do not remove each other's words; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange, parts
from .arrowtext import WORD_POWERS, Texts, doc_ids, id_column, mix, prefix, spans
from .exchange import integers, planes
from .units import ranges

# Perfect difference sets, period: residues.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Words of documents on their way: a claim that these words stand at `start` in the part, or (no words) that its words from `start` go.
CLAIM = "part int, start long, n long, words binary"
SLICE = 1 << 20


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves anchors of two fifths of the window, and its cover as a mask."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, window * 2 // 5))
    mask = np.zeros(period, bool)
    mask[list(COVERS[period])] = True
    return period, mask


class Words:
    """Hashes of a slice's words as prefix sums, and the first word of each document."""

    def __init__(self, t: Texts, seed: int) -> None:
        hashes, self.first = t.word_hashes()
        self.sums, self.n = prefix(mix(hashes + np.uint64(seed)), WORD_POWERS), len(hashes)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, document and hash of each anchor: hashes are made at positions of the cover alone."""
        period, mask = cover_for(window)
        length, count = window - period + 1, np.diff(self.first)
        residues = np.flatnonzero(mask)
        fit = np.where(count >= window, count - length + 1, 0)  # places of a document where an anchor fits
        n = fit // period * len(residues) + np.searchsorted(residues, fit % period)
        doc = np.repeat(np.arange(len(count)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = self.first[doc] + nth // len(residues) * period + residues[nth % len(residues)]
        return start, doc, spans(self.sums, start, start + length, WORD_POWERS)

    def around(self, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
        """First words of the windows that hold one of these anchors."""
        period, _ = cover_for(window)
        low, high = np.maximum(at - period + 1, self.first[doc]), np.minimum(at, self.first[doc + 1] - window)
        step = np.zeros(self.n + 1, np.int64)
        np.add.at(step, low, 1)
        np.add.at(step, high + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def hashed(self, start: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to 64 bits of these windows, and 32 more from their first halves if there are to be more."""
        h = spans(self.sums, start, start + window, WORD_POWERS)
        half = spans(self.sums, start, start + window // 2, WORD_POWERS)
        x = (mix(half ^ (h << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
        return (h, x) if bits > 64 else (h & ~np.uint64((1 << (64 - bits)) - 1), x & np.uint32(0))


def grouped(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (h, x), and where each distinct value starts in it."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (x[order][1:] != x[order][:-1])).any():  # two windows with one first hash
        order = np.lexsort((x, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (x[order][1:] != x[order][:-1])
    return order, np.flatnonzero(new)


def chains(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin in which the first two columns grow by one and the others stay, and how long each is."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    broken = np.zeros(len(columns[0]), bool)
    broken[0] = True
    for i, c in enumerate(columns):
        broken[1:] |= np.diff(c) != (1 if i < 2 else 0)
    at = np.flatnonzero(broken)
    return at, np.diff(np.append(at, len(broken)))


class Plain:
    """A part's words, joined by single spaces, with each word's place."""

    def __init__(self, t: Texts) -> None:
        joined, at, first, size = [], [], [np.zeros(1, np.int64)], 0
        for _, s in t.slices(SLICE):
            data, start, f = spaced(s)
            joined.append(data)
            at.append(start + size)
            first.append(f[1:] + first[-1][-1])
            size += len(data)
        self.data = b"".join(joined)
        self.at = np.concatenate([*at, [size]]).astype(np.int64)
        self.first = np.concatenate(first)

    def words(self, start: int, n: int) -> bytes:
        return self.data[self.at[start] : self.at[start + n] - 1]


def spaced(t: Texts, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a slice (or those to keep), each with a space behind it: the bytes, each word's place, and each document's first word."""
    start, end, first = t.words()
    if keep is not None:
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        start, end = start[keep], end[keep]
    n = end - start + 1
    data = np.append(t.data, np.uint8(32))[ranges(start, n)]
    ends = np.cumsum(n)
    data[ends - 1] = 32
    return data.tobytes(), ends - n, first


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: tuple[str, ...] = (), as_is: bool = False, seed: int = 0, bits: int = 96) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by a space; with as_is, texts that lose none are not joined anew) and carry_0, ... for the carried columns.

    bits of hash find windows that may be equal (up to 64, or 96); fewer make the comparison of words stop the job more often.
    """
    if window < 2:
        raise ValueError("a window must be of two words or more")
    dealt, n_parts, _ = parts.deal(docs, id_col, text_col, carry)
    n_buckets = parts.buckets(n_parts)

    def keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, hashes, held = doc_ids(t["doc_id"]), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, s in Texts.of(t["text"]).slices(SLICE):
            _, doc, h = Words(s, seed).anchors(window)
            hashes.append(h)
            held.append(ids[doc + at])
        return np.concatenate(hashes), np.concatenate(held)

    def entries(t: pa.Table, shared: parts.Shared, part: int) -> Iterator[tuple]:
        ids, before, found = doc_ids(t["doc_id"]), 0, []
        for at, s in Texts.of(t["text"]).slices(SLICE):
            w = Words(s, seed)
            a, doc, h = w.anchors(window)
            own = shared.has(h)
            start = w.around(a[own], doc[own], window)
            h, x = w.hashed(start, window, bits)
            found.append((h, x, ids[np.searchsorted(w.first, start, "right") - 1 + at], start + before))
            before += w.n
        h, x, doc, start = (np.concatenate([f[i] for f in found]) for i in range(4))
        del found
        order, first = grouped(h, x)
        pick = order[first]  # documents come in order of id, so the first has the least
        rep = np.empty(len(h), np.int64)
        rep[order] = np.repeat(pick, np.diff(np.append(first, len(h))))
        to = ((h[pick] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        rows = np.vstack([planes(h[pick], 8), planes(x[pick].astype(np.uint64), 4), planes(doc[pick], 8), planes(start[pick], 8)])
        span, via = exchange.route(n_buckets, part)
        yield from exchange.packed(parts.ENTRIES, to, part, rows, span, via)
        # what repeats inside the part, by way of a bucket that only hands it on
        again = np.flatnonzero(rep != np.arange(len(h)))
        where, copied = start[again], start[rep[again]]
        at, n = chains(where, copied)
        rows = np.vstack([planes(where[at], 8), planes(copied[at], 8), planes(n, 8)])
        yield from exchange.packed(parts.NOTES, np.full(len(at), part % n_buckets), part, rows, span, via)

    def settle(t: pa.Table) -> Iterator[tuple]:
        span, via = exchange.route(n_parts, int(t["to"][0].as_py()))
        _, part, rows = exchange.of_kind(t, parts.NOTES)
        yield from exchange.packed(parts.NOTES, part, part, rows, span, via)
        _, part, rows = exchange.of_kind(t, parts.ENTRIES)
        if not len(part):
            return
        h, x, ids, start = integers(rows, 0, 8), integers(rows, 8, 4), integers(rows, 12, 8).astype(np.int64), integers(rows, 20, 8)
        by_id = np.argsort(ids, kind="stable")
        order, first = grouped(h[by_id], x[by_id])
        order = by_id[order]
        least = np.repeat(order[first], np.diff(np.append(first, len(h))))
        hit = ids[least] < ids[order]
        own, other = order[hit], least[hit]
        yield from exchange.packed(parts.ENTRIES, part[own], part[own], np.vstack([planes(start[own], 8), planes(part[other], 8), planes(start[other], 8)]), span, via)

    def claim(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        """What of this part's words goes, after comparing its repeats, and the matches for other parts to compare."""
        part, out = key[0].as_py(), []
        if t.num_rows and answers.num_rows:
            t = ordered_texts(t)
            text, ids = Plain(Texts.of(t["text"])), doc_ids(t["doc_id"])
            owner = lambda w: ids[np.searchsorted(text.first, w, "right") - 1]
            _, _, rows = exchange.of_kind(answers, parts.ENTRIES)
            found = np.zeros((0, 3), np.int64)
            if rows.size:
                found = np.column_stack([integers(rows, i, 8).astype(np.int64) for i in (0, 8, 16)])
                found = found[np.argsort(found[:, 0])]
            at, n = chains(found[:, 0], found[:, 2], found[:, 1])
            claims: dict[tuple, None] = {}
            for (w, other, place), k in zip(found[at].tolist(), (n + window - 1).tolist(), strict=True):
                claims[other, place, k, text.words(w, k)] = None
            out += claims
            gone = found[:, 0]
            _, _, rows = exchange.of_kind(answers, parts.NOTES)
            if rows.size:
                where, copied, n = (integers(rows, i, 8).astype(np.int64) for i in (0, 8, 16))
                for w, c, k in zip(where.tolist(), copied.tolist(), (n + window - 1).tolist(), strict=True):
                    if text.words(w, k) != text.words(c, k):
                        raise two_passages(seed)
                where, copied = ranges(where, n), ranges(copied, n)
                hit = owner(copied) < owner(where)
                if len(gone):
                    hit |= gone[np.minimum(np.searchsorted(gone, copied), len(gone) - 1)] == copied
                gone = np.unique(np.concatenate([gone, where[hit]]))
            if len(gone):
                cut = np.flatnonzero(np.diff(gone, prepend=gone[0] - 2) > 1)
                last = gone[np.append(cut[1:], len(gone)) - 1]
                out += [(part, a, b - a + window, None) for a, b in zip(gone[cut].tolist(), last.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        table = pa.table({"part": pa.array(columns[0], pa.int32()), "start": pa.array(columns[1], pa.int64()), "n": pa.array(columns[2], pa.int64()), "words": pa.array(columns[3], pa.binary())})
        exchange.release()
        return table

    def finish(t: pa.Table, claims: pa.Table) -> pa.Table:
        t = parts.ordered(t)
        ids, texts = doc_ids(t["doc_id"]), Texts.of(t["text"])
        start, n, words = claims["start"].to_numpy(), claims["n"].to_numpy(), claims["words"].combine_chunks()
        own = words.is_null().to_numpy(zero_copy_only=False)
        asks = np.flatnonzero(~own)
        asks = asks[np.argsort(start[asks], kind="stable")]
        begin, length = start[own], n[own]
        n_words, n_removed, kept, before = [], [], [], 0
        for at, s in texts.slices(SLICE):
            _, _, first = s.words()
            total = int(first[-1])
            here = asks[np.searchsorted(start[asks], before) : np.searchsorted(start[asks], before + total)]
            if len(here):
                data, place, _ = spaced(s)
                place = np.append(place, len(data))
                for i in here.tolist():
                    a = start[i] - before
                    if data[place[a] : place[a + n[i]] - 1] != words[i].as_py():
                        raise two_passages(seed)
                del data, place
            mine = (begin >= before) & (begin < before + total)
            step = np.zeros(total + 1, np.int64)
            np.add.at(step, begin[mine] - before, 1)
            np.add.at(step, begin[mine] + length[mine] - before, -1)
            keep = np.cumsum(step[:-1]) == 0
            data, place, new_first = spaced(s, keep)
            place = np.append(place, len(data))
            lost = np.diff(first) - np.diff(new_first)
            n_words.append(np.diff(first))
            n_removed.append(lost)
            for i, (a, b) in enumerate(zip(place[new_first[:-1]].tolist(), place[new_first[1:]].tolist(), strict=True)):
                kept.append(s[i] if as_is and not lost[i] else data[a : max(a, b - 1)])
            before += total
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        out = {"doc_id": id_column(ids), "n_words": flat(n_words), "n_removed": flat(n_removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        out = pa.table(out | {f"carry_{i}": t[f"carry_{i}"] for i in range(len(carry))})
        exchange.release()
        return out

    ordered_texts = lambda t: parts.ordered(t.select(["doc_id", "text", "text_hash"]))
    answers = parts.answered(dealt, n_parts, n_buckets, keys, entries, settle)
    claims = dealt.groupBy("part").cogroup(answers.groupBy("to")).applyInArrow(claim, CLAIM).distinct()  # a claim that all parts make is one row
    kinds = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return dealt.groupBy("part").cogroup(claims.groupBy("part")).applyInArrow(finish, f"doc_id long, n_words long, n_removed long, kept_text string{kinds}")


def two_passages(seed: int) -> RuntimeError:
    return RuntimeError(f"two different passages have one hash; run again with a seed other than {seed}")

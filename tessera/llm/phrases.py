"""Phrase collocations by pivot partitioning.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Every contiguous phrase is owned
by its rarest word, the pivot (the leftmost one, if that word stands in it twice). So each occurrence of a frequent word sends one
fragment to its pivot's bucket: the words around it, at most longest - 1 on either side, as far as no rarer word stands
between. A bucket mines its fragments alone and counts only the phrases that hold the pivot, so every occurrence of every
phrase of frequent words is counted exactly once, at one pivot.

  part -> word counts -> bucket -> frequent words, their counts and numbers -> part -> fragments -> pivot's bucket -> phrases

Documents are dealt into parts (see parts.deal); a part counts words and equal fragments before it sends them, so a passage that a
third of all documents hold is sent once by each part. A word that occurs more than `salt_at` times is the pivot of several
buckets, among which its fragments are dealt by a neighbour: phrases that hold the word to the pivot's left too are counted where that
pair belongs, those that begin with the pivot where it belongs with the word to its right. So all occurrences of a phrase meet in
one bucket, and rare phrases are dropped there whatever their pivot. Words are known by 96 bits of hash of word and language.

A null language is `und`; a null text has no words. Rows that repeat, ids that repeat or are null, and other columns do no harm: every
row's text counts. Ties in score go to the larger count, then to the smaller phrase by bytes. An empty table gives no rows.
What grows with the input in one task: a word that every part holds is a row a part in one bucket of word counts, and a fragment that every part holds one in
its pivot's bucket (or its pair's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange, parts
from .arrowtext import BYTE_BASE, BYTE_POWERS, BYTE_TABLE, Powers, Texts, mix, prefix, spans
from .exchange import integers, planes
from .store import written

UNKNOWN, LONGEST, LEAST = "und", 5, 100
SALT_AT = 1 << 17
#: Bytes of a word's number, of a count, and of the two hashes that tell words apart.
ID, COUNT, H1, H2 = 6, 6, 8, 4
#: Kinds of packets: frequent words, words and counts, and fragments.
FREQUENT, WORDS, FRAGMENTS = 0, 1, 2
#: What a fragment is dealt by: its pivot, or the pivot with the word on one side.
ALL, LEFT, RIGHT = 0, 1, 2
#: Larger parts than elsewhere: the more text a part has, the fewer parts send the same word or fragment.
PART_BYTES = 8 << 20
SLICE = 1 << 20

_BREAKS = np.zeros(256, bool)
_BREAKS[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = True
_OUTSIDE = _BREAKS.copy()
_OUTSIDE[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE2 = mix(BYTE_TABLE ^ np.uint64(BYTE_BASE))
_POWERS2 = Powers(0xC2B2AE3D27D4EB4F)


class Slice:
    """Words of a slice of documents in order: two hashes each, and whether a piece begins with it."""

    def __init__(self, t: Texts, lang: np.ndarray) -> None:
        data = _LOWER[t.data]
        solid, cut = ~_OUTSIDE[data], _BREAKS[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = t.offsets[(t.offsets > 0) & (t.offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.data = data
        doc = np.searchsorted(t.offsets, self.start, "right") - 1
        self.lang = lang[doc]
        piece = np.cumsum(cut)[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.fresh = np.ones(len(doc), bool)
        self.fresh[1:] = (np.diff(doc) != 0) | (np.diff(piece) != 0)
        own = mix((self.lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
        self.h1 = mix(spans(prefix(BYTE_TABLE[data], BYTE_POWERS), self.start, self.end, BYTE_POWERS) ^ own)
        self.h2 = (mix(spans(prefix(_TABLE2[data], _POWERS2), self.start, self.end, _POWERS2) + own) >> np.uint64(32)).astype(np.uint32)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def _lang_hash(names: list[str]) -> np.ndarray:
    t = Texts.of(pa.array(names, pa.string()))
    return spans(prefix(BYTE_TABLE[t.data], BYTE_POWERS), t.offsets[:-1], t.offsets[1:], BYTE_POWERS)


def _slices(t: pa.Table) -> Iterator[tuple[Slice, list[str]]]:
    """The part's slices, with languages by a hash of their names, and these names."""
    if not t.num_rows:
        return
    d = t["carry_0"].combine_chunks().dictionary_encode()
    which, names = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
    hashed = _lang_hash(names)
    for at, s in Texts.of(t["text"]).slices(SLICE):
        yield Slice(s, hashed[which[at : at + len(s)]]), names


def _first_of(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by both hashes, and where each distinct word starts in it."""
    order = np.argsort(h1, kind="stable")
    if ((h1[order][1:] == h1[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h1))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return order, np.flatnonzero(new)


def _distinct(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h1, h2, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order, at = _first_of(h1, h2)
    return h1[order[at]], h2[order[at]], np.add.reduceat(n[order], at) if len(at) else n


def _counts(n_buckets: int):
    def count(key: tuple, t: pa.Table) -> pa.Table:
        """The part's distinct words and how often each is there, for the buckets of their hashes."""
        found = []
        for s, _ in _slices(t):
            order, at = _first_of(s.h1, s.h2)
            found.append((s.h1[order[at]], s.h2[order[at]], np.diff(np.append(at, len(order)))))
        if not found:
            return exchange.table([])
        h1, h2, n = _distinct(found)
        part = key[0].as_py()
        to = (((h1 >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
        rows = np.vstack([planes(h1, H1), planes(h2.astype(np.uint64), H2), planes(n.astype(np.int64), COUNT)])
        out = exchange.table(exchange.packed(WORDS, to, part, rows, *exchange.route(n_buckets, part)))
        exchange.release()
        return out

    return count


def _frequent(n_parts: int, n_buckets: int, least: int):
    def tell(t: pa.Table) -> pa.Table:
        """For each part those of its words that occur often enough in all: hashes, count, number, and whether this part is to name it."""
        to, part, rows = exchange.of_kind(t, WORDS)
        if not len(to):
            return exchange.table([])
        bucket, h1, h2, n = int(to[0]), integers(rows, 0, H1), integers(rows, H1, H2).astype(np.uint32), integers(rows, H1 + H2, COUNT).astype(np.int64)
        order, at = _first_of(h1, h2)
        total = np.add.reduceat(n[order], at)
        times = np.diff(np.append(at, len(order)))
        often = total >= least
        number = np.empty(len(at), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(at))  # frequent words get small numbers, which take little room in fragments
        keep = np.repeat(often, times)
        pick, group = order[keep], np.repeat(np.arange(len(at)), times)[keep]
        ids = (number[group] * n_buckets + bucket).astype(np.uint64)
        naming = np.repeat(np.minimum.reduceat(part[order], at), times)[keep] == part[pick]
        out = np.vstack([planes(h1[pick], H1), planes(h2[pick].astype(np.uint64), H2), planes(total[group], COUNT), planes(ids, ID), planes(naming.astype(np.uint64), 1)])
        exchange.release()
        return exchange.table(exchange.packed(FREQUENT, part[pick], bucket, out, *exchange.route(n_parts, bucket)))

    return tell


class Vocabulary:
    """A part's frequent words: hashes in order, total counts, numbers, and which of them the part is to name."""

    def __init__(self, answers: pa.Table) -> None:
        _, _, rows = exchange.of_kind(answers, FREQUENT)
        if not rows.size:
            rows = np.zeros((H1 + H2 + COUNT + ID, 0), np.uint8)
        h1, h2 = integers(rows, 0, H1), integers(rows, H1, H2).astype(np.uint32)
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        self.total = integers(rows, H1 + H2, COUNT)[order].astype(np.int64)
        self.id = integers(rows, H1 + H2 + COUNT, ID)[order]
        self.naming = integers(rows, H1 + H2 + COUNT + ID, 1)[order] == 1
        #: a word's place from the rarest up; ties by number, which is the same in every part
        self.rank = np.empty(len(order), np.int64)
        self.rank[np.lexsort((self.id, self.total))] = np.arange(len(order))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each word's place in this vocabulary, or -1."""
        if not len(self.h1):
            return np.full(len(h1), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        for _ in range(8):  # words that share the first hash are next to one another
            step = (self.h1[at] == h1) & (self.h2[at] < h2) & (at + 1 < len(self.h1))
            if not step.any():
                break
            at = at + step
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def fragments(place: np.ndarray, rank: np.ndarray, fresh: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word that is a pivot of two words or more: where it stands, and how many words its fragment has left and right of it.

    place: words in order, -1 for rare ones; rank: of each place, from the rarest up; fresh: whether a piece begins there.
    """
    order = np.where(place >= 0, rank[place], -1) if len(rank) else np.full(len(place), -1, np.int64)
    n = len(order)
    pad = longest - 1
    padded = np.concatenate([np.full(pad, -1, np.int64), order, np.full(pad, -1, np.int64)])
    piece = np.concatenate([np.full(pad, -1, np.int64), np.cumsum(fresh), np.full(pad, -2, np.int64)])
    here, own = padded[pad : pad + n], piece[pad : pad + n]
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    going = here >= 0
    for d in range(1, longest):
        going = going & (padded[pad - d : pad - d + n] > here) & (piece[pad - d : pad - d + n] == own)  # a word like it to the left owns what holds both
        left += going
    going = here >= 0
    for d in range(1, longest):
        going = going & (padded[pad + d : pad + d + n] >= here) & (piece[pad + d : pad + d + n] == own)
        right += going
    at = np.flatnonzero(left + right > 0)
    return at, left[at], right[at]


def dealt_by(at: np.ndarray, left: np.ndarray, right: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fragments of fragments() and what they are dealt by. Those of pivots that occur often (a flag of each word) become up to two:
    one for the phrases that hold the pivot and the word to its left, and one without what is left of the pivot, for the phrases that begin with it."""
    split = often[at]
    one, two, three = np.flatnonzero(~split), np.flatnonzero(split & (left > 0)), np.flatnonzero(split & (right > 0))
    pick, side = np.concatenate([one, two, three]), np.repeat([ALL, LEFT, RIGHT], [len(one), len(two), len(three)])
    return at[pick], np.where(side == RIGHT, 0, left[pick]), right[pick], side


def _grouped(columns: list[np.ndarray], n: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct row of small integers (below `numbers`), and the sum of n over its like."""
    bits = max(1, int(numbers - 1).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for a in range(0, len(columns), each):
        key = np.zeros(len(n), np.int64)
        for c in columns[a : a + each]:
            key = (key << bits) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(n[order], at) if len(at) else n


def _put(n_buckets: int, longest: int, salt_at: int):
    def put(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        """The part's distinct fragments with their counts, for their pivots' buckets."""
        part, v = key[0].as_py(), Vocabulary(answers)
        if not t.num_rows or not len(v.h1):
            return exchange.table([])
        found: dict[int, list[np.ndarray]] = {}
        for s, _ in _slices(t):
            place = v.places(s.h1, s.h2)
            at, left, right, side = dealt_by(*fragments(place, v.rank, s.fresh, longest), v.total[place] > salt_at)
            size = left + right + 1
            for k in np.unique(size).tolist():
                own = size == k
                first = at[own] - left[own]
                found.setdefault(k, []).append(np.vstack([left[own] * 4 + side[own], *(place[first + j] for j in range(k))]).astype(np.int32))
        most, bodies, places = 2 * longest - 1, [], []
        for k in sorted(found):
            rows = np.concatenate(found.pop(k), 1)
            pick, n = _grouped(list(rows[1:].astype(np.int64)) + [rows[0].astype(np.int64)], np.ones(rows.shape[1], np.int64), max(len(v.id), 16))
            rows = rows[:, pick]
            left, side, each = rows[0] >> 2, rows[0] & 3, np.arange(len(pick))
            pivot, beside = v.id[rows[1 + left, each]], v.id[rows[1 + left + (side == RIGHT) - (side == LEFT), each]]
            owner = np.where(side == ALL, mix(pivot), mix(mix(pivot) + mix(beside * np.uint64(BYTE_BASE) + side.astype(np.uint64))))
            places.append((((mix(owner) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64))
            body = np.zeros((2 + COUNT + most * ID, len(pick)), np.uint8)
            body[0], body[1] = k, left << 1 | (side == LEFT)
            body[2 : 2 + COUNT] = planes(n, COUNT)
            for j, c in enumerate(rows[1:]):
                body[2 + COUNT + j * ID : 2 + COUNT + (j + 1) * ID] = planes(v.id[c], ID)
            bodies.append(body)
        out = exchange.table(exchange.packed(FRAGMENTS, np.concatenate(places), part, np.concatenate(bodies, 1), *exchange.route(n_buckets, part)) if places else [])
        exchange.release()
        return out

    return put


def _mined(longest: int, least: int):
    def mine(t: pa.Table) -> pa.Table:
        """Frequent phrases owned by this bucket's pivots, or by pairs of a pivot and a word beside it: their words' numbers and counts."""
        frags = []
        _, _, rows = exchange.of_kind(t, FRAGMENTS)
        for k in np.unique(rows[0]).tolist() if rows.size else []:
            own = rows[:, rows[0] == k]
            head = own[1].astype(np.int64)
            frags.append((k, head >> 1, head & 1, integers(own, 2, COUNT).astype(np.int64), [integers(own, 2 + COUNT + ID * j, ID) for j in range(k)]))
        del rows
        vocabulary = np.unique(np.concatenate([np.unique(c) for f in frags for c in f[4]])) if frags else np.zeros(0, np.uint64)
        frags = [(k, o, s, n, [np.searchsorted(vocabulary, c).astype(np.int32) for c in words]) for k, o, s, n, words in frags]
        keys, counts = [], []
        for size in range(2, longest + 1):
            columns: list[list[np.ndarray]] = [[] for _ in range(size)]
            ns = []
            for k, offset, both, n, words in frags:
                for first in range(k - size + 1):
                    own = (offset >= first + both) & (offset < first + size)
                    for j in range(size):
                        columns[j].append(words[first + j][own])
                    ns.append(n[own])
            if not ns:
                continue
            c, n = [np.concatenate(x).astype(np.int64) for x in columns], np.concatenate(ns)
            if not len(n):
                continue
            pick, total = _grouped(c, n, max(2, len(vocabulary)))
            keep = total >= least
            pick = pick[keep]
            ids = np.stack([vocabulary[x[pick]] for x in c], 1).astype(">u8").view(np.uint8).reshape(len(pick), size, 8)[:, :, 8 - ID :].tobytes()
            ends = pa.array(np.arange(len(pick) + 1, dtype=np.int32) * np.int32(size * ID))
            keys.append(pa.Array.from_buffers(pa.binary(), len(pick), [None, ends.buffers()[1], pa.py_buffer(ids)]))
            counts.append(total[keep])
        exchange.release()
        return pa.table([pa.chunked_array(keys, pa.binary()), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], ["key", "n"])

    return mine


def _name(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows for the frequent words that this part is to name, and one with the number of words of each language."""
    v = Vocabulary(answers)
    langs, words, ids, totals, counts = [], [], [], [], {}
    named = np.zeros(len(v.h1), bool)
    for s, names in _slices(t):
        by_hash = dict(zip(_lang_hash(names).tolist(), names, strict=True))
        for h, n in zip(*np.unique(s.lang, return_counts=True), strict=True):
            counts[by_hash[int(h)]] = counts.get(by_hash[int(h)], 0) + int(n)
        if not len(v.h1):
            continue
        place = v.places(s.h1, s.h2)
        found, at = np.unique(place, return_index=True)
        for p, i in zip(found.tolist(), at.tolist(), strict=True):
            if p >= 0 and v.naming[p] and not named[p]:
                named[p] = True
                langs.append(by_hash[int(s.lang[i])])
                words.append(s.word(i))
                ids.append(int(v.id[p]).to_bytes(ID, "big"))
                totals.append(int(v.total[p]))
    for k, n in counts.items():
        langs.append(k)
        words.append(None)
        ids.append(None)
        totals.append(n)
    exchange.release()
    return pa.table([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], ["lang", "word", "key", "n"])


def _size(key: Column) -> Column:
    return (F.octet_length(key) / ID).cast("int")


def _cut(key: Column, first: Column, n: Column | None = None) -> Column:
    """Words of a key from the given one on (from 0)."""
    return F.substr(key, first * ID + 1, F.octet_length(key) if n is None else n * ID)


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, salt_at: int = SALT_AT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n) of phrases of two words or more with n >= least; (lang, word, key, n) of such words; (lang, n) of all words.

    A key is the numbers of a phrase's words, ID bytes each. They are parts of one stored table, so that the passes over the texts read one exchange.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    dealt, n_parts, _ = parts.deal(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")), "doc_id", "text", ("lang",), PART_BYTES)
    n_words, n_buckets = parts.buckets(n_parts), max(parts.LEAST_BUCKETS, n_parts)
    words = exchange.delivered(dealt.groupBy("part").applyInArrow(_counts(n_words), exchange.PACKET), n_words)
    answers = exchange.delivered(words.groupBy("to").applyInArrow(_frequent(n_parts, n_words, least), exchange.PACKET), n_parts)
    asked = dealt.groupBy("part").cogroup(answers.groupBy("to"))
    named = asked.applyInArrow(_name, "lang string, word string, key binary, n bigint")
    sent = exchange.delivered(asked.applyInArrow(_put(n_buckets, longest, salt_at), exchange.PACKET), n_buckets)
    mined = sent.groupBy("to").applyInArrow(_mined(longest, least), "key binary, n bigint")
    found = written(named.unionByName(mined, allowMissingColumns=True), "phrases")
    totals = found.where("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return found.where("word IS NULL AND key IS NOT NULL").select("key", "n"), found.where("word IS NOT NULL"), totals


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = 2000, salt_at: int = SALT_AT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to `longest` words that occur `least` times or more.

    a, l, r: how often the phrase, its first part and the rest occur, at the cut with the lowest score; n: words of the
    language; score: floor(1000 a n / (l r)). A phrase inside a longer one that occurs as often is left out.
    """
    phrases, words, totals = frequent_phrases(docs, id_col, text_col, lang_col, longest, least, salt_at)
    counts = phrases.select("key", "n").unionByName(words.select("key", "n"))
    # what lies in a longer phrase of the same count lies in one that is one word longer
    longer = phrases.where(_size(F.col("key")) > 2)
    inside = longer.select(F.explode(F.array(_cut(F.col("key"), F.lit(0), _size(F.col("key")) - 1), _cut(F.col("key"), F.lit(1)))).alias("key"), "n").distinct()
    left = phrases.join(inside, ["key", "n"], "left_anti").withColumnRenamed("n", "a")
    each = left.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), _size(F.col("key")) - 1), lambda i: _cut(F.col("key"), i, F.lit(1)))).alias("i", "one"))
    spelled = each.join(words.select(F.col("key").alias("one"), "lang", "word"), "one").groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), _size(F.col("key")) - 1)).alias("k")).select("key", "a", "k", _cut(F.col("key"), F.lit(0), F.col("k")).alias("first"), _cut(F.col("key"), F.col("k")).alias("rest"))
    both = cuts.join(counts.select(F.col("key").alias("first"), F.col("n").alias("l")), "first").join(counts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    scored = both.join(spelled, "key").join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')} DIV ({wide('l')} * {wide('r')})")
    best = scored.withColumn("score", score).groupBy("key").agg(F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

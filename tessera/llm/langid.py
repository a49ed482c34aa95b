"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased, each run of other characters than letters becomes one space, and its n-grams are
the stretches of one to three characters that hold a letter and a space at most at their ends. A language's
profile is its `size` most frequent n-grams over all learned texts, in order; a document's is the same of itself. The
out-of-place distance of the two adds, over the document's n-grams, how many places each is away
from its place in the language's profile, or `size` for those that are not there. The language with the least distance is predicted, the
first by name on a tie; equal counts are ordered by code points. The score is 1 - distance / (n-grams * size), from 0 to 1.

N-grams are three code points in one 63-bit integer, so nothing is hashed. They are counted whole texts at a time, in slices of
bounded size, and summed over batches before a shuffle. The profiles (`size` n-grams a language) are all that reaches the driver;
more than `most_languages` languages are an error, never cut.

Null and empty texts, and texts without a letter, get 'und' and score 0, as does every text where nothing could be learned.
Rows that repeat are judged alike. Rows without an id are judged, but never learned from by learned_and_judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, MOST_LANGUAGES = 400, 4096
#: Characters whose n-grams are counted at once, and counts that a task holds before it passes them on.
PORTION, HELD = 1 << 20, 1 << 21
UNKNOWN = "und"
_BITS = np.uint64(21)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, one space for each run of others (one in front, one between texts), and the text of each."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    owner = np.repeat(np.arange(len(lower)), size + 1) if lower else np.zeros(0, np.int64)
    owner = np.concatenate([[0], owner])[: len(points)]
    solid = letters()[points]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[0] = True
    points = np.where(solid, points, np.uint32(32))
    return points[keep], owner[keep]


def counted(points: np.ndarray, owner: np.ndarray, portion: int = PORTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, n-gram) in order, and how often each is there."""
    parts, a = [], 0
    while a < len(points):
        step = portion
        while True:  # rare: very many different characters, whose numbers would not fit
            p, o = points[a : a + step + 3], owner[a : a + step + 3]
            alphabet = np.flatnonzero(np.bincount(p))
            base = len(alphabet) + 1
            if step <= 1024 or (int(o[-1]) + 1) * base**3 < 1 << 62:
                break
            step //= 4
        here = min(step, len(points) - a)
        a += here
        numbered = np.zeros(int(alphabet[-1]) + 1, np.int64)
        numbered[alphabet] = np.arange(1, base)
        code = np.concatenate([numbered[p], [0, 0]])
        solid = np.concatenate([p != 32, [False, False]])
        there = np.concatenate([np.ones(len(p), bool), [False, False]])
        c0, c1, c2, s0, s1, s2 = (x[i : i + here] for x in (code, solid) for i in range(3))
        t1, t2 = there[1 : 1 + here], there[2 : 2 + here]
        own = np.where(s0, o[:here], np.append(o, o[-1:])[1 : 1 + here]).astype(np.int64)  # a space belongs to the word behind it
        keys = []
        for ok, x, y in ((s0, 0, 0), ((s0 | s1) & t1, c1, 0), (s1 & t2, c1, c2)):
            keys.append((((own * base + c0) * base + x) * base + y)[ok])
        key = np.concatenate(keys)
        if (int(o[-1]) + 1) * base**3 < 1 << 32:  # half as wide, twice as fast to sort
            key = key.astype(np.uint32)
        key, n = np.unique(key, return_counts=True)
        key = key.astype(np.int64)
        points_of = np.concatenate([[0], alphabet]).astype(np.uint64)
        gram = (((points_of[key // base**2 % base] << _BITS) | points_of[key // base % base]) << _BITS) | points_of[key % base]
        parts.append((key // base**3, gram, n))
    if len(parts) == 1:
        return parts[0]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def summed(owner: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (owner, n-gram) added up; in order of both."""
    order = np.lexsort((gram, owner))
    owner, gram, n = owner[order], gram[order], n[order]
    at = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(gram.view(np.int64), prepend=-1) != 0))
    return owner[at], gram[at], np.add.reduceat(n, at) if len(at) else n


def batches_of(texts: list[str], most: int = PORTION) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` characters (one text at least), with the first one's place."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        lang, gram, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch([pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(list(names), pa.string())).cast(pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        langs = [names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()]
        for at, texts in batches_of(batch.column("text").to_pylist()):
            points, owner = spelled(texts)
            held.append(counted(points, np.array(langs[at : at + len(texts)], np.int64)[owner]))
            size += len(held[-1][0])
            if size > HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def profiles(learn: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """lang, gram, n, place (from 0): each language's `size` most frequent n-grams, from whole texts of all rows with a text and a language."""
    rows = learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    grams = rows.mapInArrow(_learned, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return grams.withColumn("place", place - 1).where(F.col("place") < size)


class Judge:
    """Profiles as arrays: n-grams in order, and the place of each in each language (`size` where it has none)."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.names, self.size = sorted({r[0] for r in rows}), size
        gram = np.array([r[1] for r in rows], np.int64).astype(np.uint64)
        lang = np.searchsorted(np.array(self.names, object), np.array([r[0] for r in rows], object)) if rows else np.zeros(0, np.int64)
        order = np.lexsort((gram, lang))
        self.gram, self.place = gram[order], np.array([r[2] for r in rows], np.int64)[order]
        self.first = np.searchsorted(lang[order], np.arange(len(self.names) + 1))

    def distances(self, gram: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distance of each document (its n-grams start at `at`) from each language."""
        out = np.zeros((len(self.names), len(at)), np.int64)
        for k in range(len(self.names)):
            own, there = (x[self.first[k] : self.first[k + 1]] for x in (self.gram, self.place))
            where = np.minimum(np.searchsorted(own, gram), len(own) - 1)
            away = np.where(own[where] == gram, np.abs(there[where] - place), self.size)
            out[k] = np.add.reduceat(away, at) if len(at) else 0
        return out

    def judged(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names or not texts:
            return lang, score
        owner, gram, n = counted(*spelled(texts))
        order = np.lexsort((gram, -n, owner))
        owner, gram = owner[order], gram[order]
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
        top = place < self.size
        owner, gram, place = owner[top], gram[top], place[top]
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        away = self.distances(gram, place, at)
        best = away.argmin(0)
        own = np.diff(np.append(at, len(owner))) * self.size
        for i, k in zip(owner[at].tolist(), best.tolist(), strict=True):
            lang[i] = self.names[k]
        score[owner[at]] = 1 - away[best, np.arange(len(at))] / own
        return lang, score


def identify(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most_languages: int = MOST_LANGUAGES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the carried columns (as carry_0, ...) of every row, by profiles() with the same `size`."""
    rows = learned.select("lang", "gram", "place").limit(most_languages * size + 1).collect()  # at most `size` a language
    if len({r["lang"] for r in rows}) > most_languages or len(rows) > most_languages * size:
        raise ValueError(f"more than {most_languages} languages to learn")
    judge = Judge([(r["lang"], r["gram"], r["place"]) for r in rows], size)
    kept = [f"carry_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for at, some in batches_of(texts):
                lang, score = judge.judged(some)
                cut = batch.slice(at, len(some))
                yield pa.record_batch([cut.column("doc_id"), *(cut.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", *kept, "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.drop("text").schema)
    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id in decimal, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learned_and_judged(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; nothing is learned from fold 0, or from rows without an id."""
    part = fold(F.col("doc_id"))
    out = identify(docs, profiles(docs.where(part != 0), size=size), size=size)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

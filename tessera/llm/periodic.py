"""Periodic runs of words: every lag against the whole document.

A run is a maximal stretch of consecutive words whose smallest period is q and that is at
least max(least, min_exp * q) long. Texts become arrays of word numbers (equal words, equal
numbers; nothing is hashed), and the array is compared with itself at each shift q up to
n / min_exp; true stretches are run-length coded. A stretch of min_exp periods holds min_exp - 1
places in a row at every q-th word, so a shift looks at every q-th word first, then at a few
words between those that fit, and compares a document in full only where all of them do: no run is
missed, and a document of n words costs about n log n.

By the theorem of Fine and Wilf a stretch has a smaller period only if that divides q and
the smaller period's stretch is the same one, so of equal stretches the smallest lag stays.

Documents are batched, about a megabyte of text a scan. A text of more than `whole` bytes is dealt to tasks
by ranges of `lags` shifts, whose runs meet again by a hash of id and text. Null texts are empty: they have no words,
no runs, and an empty kept text. Rows that repeat, ids that repeat or are null, and other columns do no harm:
each row is judged by its own text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import SPACES, Texts
from .substring_dedup import spaced

SLICE = 1 << 20
WHOLE_BYTES, LAGS = 8 << 20, 1 << 18
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Words between two of a stride that are looked at before a document is compared in full.
PROBES = 8


def word_numbers(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A number of each word, equal for equal words, and the first word of each document."""
    start, end, first = t.words()
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    solid = np.ascontiguousarray(t.data[~SPACES[t.data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False), first


def stretches(ids: np.ndarray, first: np.ndarray, min_exp: int, least: int, low: int = 1, high: int | None = None) -> np.ndarray:
    """Rows (first word, word after the last, lag) of maximal stretches at lags from low up to high; each smallest lag only once all lags are in."""
    count = np.diff(first)
    most = int(count.max(initial=0)) // min_exp
    found = [np.zeros((0, 3), np.int64)]
    for q in range(low, min(most + 1, high or most + 1)):
        every = ids[::q]
        same = every[1:] == every[:-1]
        if len(same) < min_exp - 1:
            break
        hit = same[: len(same) - min_exp + 2].copy()
        for k in range(1, min_exp - 1):
            hit &= same[k : len(same) - min_exp + 2 + k]
        at = np.flatnonzero(hit) * q
        if not len(at):
            continue
        doc = np.searchsorted(first, at, "right") - 1
        at, doc = (x[(at + (min_exp - 1) * q < first[doc + 1]) & (count[doc] >= max(least, min_exp * q))] for x in (at, doc))
        if min_exp > 2 and len(at):
            between = at[:, None] + np.arange((min_exp - 2) * PROBES + 1) * q // PROBES
            fits = (ids[between] == ids[between + q]).all(1)
            at, doc = at[fits], doc[fits]
        for s, e, _ in _longer(found, q, min_exp):  # a stretch of a period that divides q is the stretch at q
            out = (at < s) | (at + (min_exp - 1) * q >= e)
            at, doc = at[out], doc[out]
        for d in np.unique(doc).tolist():
            a, b = first[d], first[d + 1]
            edge = np.diff((ids[a : b - q] == ids[a + q : b]).astype(np.int8), prepend=0, append=0)
            s, e = np.flatnonzero(edge == 1) + a, np.flatnonzero(edge == -1) + a + q
            keep = e - s >= max(least, min_exp * q)
            found.append(np.stack([s[keep], e[keep], np.full(int(keep.sum()), q)], 1))
    return smallest(np.concatenate(found))


def _longer(found: list[np.ndarray], q: int, min_exp: int) -> np.ndarray:
    rows = np.concatenate(found)
    return rows[(q % np.maximum(rows[:, 2], 1) == 0) & (rows[:, 1] - rows[:, 0] > (min_exp - 1) * q)] if len(rows) else rows


def smallest(rows: np.ndarray) -> np.ndarray:
    """Of equal stretches that of the smallest lag; in order of start, then lag."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _listed(rows: np.ndarray, doc: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs of each document as a list, by word numbers of that document."""
    n = np.bincount(doc, minlength=len(first) - 1)
    fields = [pa.array(x) for x in (rows[:, 0] - first[doc], rows[:, 1] - rows[:, 0], rows[:, 2])]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_RUN.value_type)))


def _kept(t: Texts, rows: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each document's words without those that a run holds after its first period, joined by a space."""
    step = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 1], -1)
    data, at, own = spaced(t, np.cumsum(step[:-1]) == 0)
    at = np.append(at, len(data))[own]
    return pa.array([data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()).cast(pa.string())


def _scanned(min_exp: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t in Texts.of(batch.column("text")).slices(SLICE):
                ids, first = word_numbers(t)
                rows = stretches(ids, first, min_exp, least)
                doc = np.searchsorted(first, rows[:, 0], "right") - 1
                cut = batch.slice(at, len(t))
                yield pa.record_batch([cut.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), _listed(rows, doc, first), _kept(t, rows, first)], ["doc_id", "n_words", "runs", "kept_text"])

    return run


def _some_lags(min_exp: int, least: int, lags: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, first = word_numbers(Texts.of(batch.column("text").slice(i, 1)))
                low = batch.column("nth")[i].as_py() * lags + 1
                rows = stretches(ids, first, min_exp, least, low, low + lags)
                yield pa.record_batch([batch.column("_row").slice(i, 1), _listed(rows, np.zeros(len(rows), np.int64), first)], ["_row", "found"])

    return run


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            t = Texts.of(batch.column("text").slice(i, 1))
            _, _, first = t.words()
            found = batch.column("found")[i].as_py() or []
            rows = smallest(np.array([(r["start"], r["start"] + r["length"], r["period"]) for r in found], np.int64).reshape(-1, 3))
            yield pa.record_batch([batch.column("doc_id").slice(i, 1), batch.column("copies").slice(i, 1), pa.array([int(first[-1])], pa.int64()), _listed(rows, np.zeros(len(rows), np.int64), first), _kept(t, rows, first)], ["doc_id", "copies", "n_words", "runs", "kept_text"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 4, least: int = 6, whole: int = WHOLE_BYTES, lags: int = LAGS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and kept_text, the text without what its runs repeat.

    min_exp: how many periods a run has at least; least: how many words. Texts of more than `whole` bytes go to a task for
    every `lags` shifts.
    """
    if min_exp < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    schema = f"doc_id bigint, n_words bigint, runs {RUNS}, kept_text string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.where(size <= whole).mapInArrow(_scanned(min_exp, least), schema)
    row = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)
    long = rows.where(size > whole).withColumn("_row", row).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    last = F.floor((size + 1) / (2 * min_exp * lags)).cast("int")  # a word has a byte and a space at least
    dealt = long.select("_row", "text", F.explode(F.sequence(F.lit(0), last)).alias("nth")).repartition("_row", "nth")
    found = dealt.mapInArrow(_some_lags(min_exp, least, lags), f"_row string, found {RUNS}").groupBy("_row").agg(F.flatten(F.collect_list("found")).alias("found"))
    done = long.join(found, "_row", "left").select("doc_id", "text", "copies", "found").mapInArrow(_finished, f"doc_id bigint, copies bigint, n_words bigint, runs {RUNS}, kept_text string")
    repeated = done.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_nth", "copies")
    return short.unionByName(repeated)


def echoed(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the end of every tenth text (by crc32 of its id) repeats: each word from a on is word a + (i - a) % p.

    With h = crc32 of the id in decimal and g = floor(h / 10): a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Others, and texts without
    words or ids, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def said(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat_ws(" ", F.slice(w, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p)))

    # the words are a lambda's variable, so that no rewriting of the plan splits a text anew for every word
    words = F.array(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    new = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, said(w))), 0)
    return docs.select("doc_id", F.coalesce(F.when(h % 10 == 0, new), F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """A row a document: how many runs, the longest one, and hashes of all runs and of the kept text."""
    longest: Column = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = runs.withColumn("top", longest)
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length DIV top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone: shares of byte classes, word and line shapes,
repetition. Trees are grown level by level on binned statistics with the logistic
loss, then flattened into arrays, which numpy walks for all documents of a batch at once.

The fit uses at most `max_rows` labelled documents (those with the least hash of id), so
what the driver holds is bounded; every document is scored over its whole text. Null
texts count as empty and are scored as such. Labels that are null or have no document
are left out; of several labels of an id the lowest counts. Without labels every score
is 0.5, and with one class it is near that class. A row without an id is scored and is not
held out. Repeated rows get the same score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import BYTE_POWERS, BYTE_TABLE, Texts, mix, prefix, spans
from .exchange import release
from .units import portions

MAX_ROWS, SLICE = 20_000, 1 << 18
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "wide": range(128, 256), "stop": b".", "comma": b",", "shout": b"!?",
    "mark": b"#$%&*+=<>@^~\\", "bar": b"|", "quote": b"'\"`", "bracket": b"()[]{}", "dash": b"-_/:;", "control": (*range(9), 11, 12, *range(14, 32), 127),
}
CLASSES = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    CLASSES[list(_bytes), _k] = 1


UPPER, LETTER = CLASSES[:, 0] > 0, CLASSES[:, [0, 1, 5]].any(1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document (40 bits of them), and how often its commonest occurs."""
    own = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    at = np.flatnonzero(own[1:] != own[:-1]) + 1 if len(own) else np.zeros(0, np.int64)
    at = np.concatenate([np.zeros(min(1, len(own)), np.int64), at])
    of = (own[at] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, np.diff(np.append(at, len(own))))
    return np.bincount(of, minlength=n), top


def statistics(t: Texts) -> np.ndarray:
    """A row of statistics for each document."""
    n, size = len(t), np.diff(t.offsets)
    doc_of_byte = np.repeat(np.arange(n) * 256, size)
    doc_of_byte += t.data
    classes = np.bincount(doc_of_byte, minlength=n * 256).reshape(n, 256).astype(float) @ CLASSES
    sums = prefix(BYTE_TABLE[t.data], BYTE_POWERS)
    start, end, first = t.words()
    n_words, length = np.diff(first), end - start
    doc = np.repeat(np.arange(n), n_words)
    upper, letters = (np.concatenate([[0], np.cumsum(mask[t.data], dtype=np.int32)]) for mask in (UPPER, LETTER))
    up, let = upper[end] - upper[start], letters[end] - letters[start]
    h = spans(sums, start, end, BYTE_POWERS)
    per_doc = lambda x: np.bincount(doc, x, minlength=n)
    mean = _share(per_doc(length), n_words)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    pair_hash = mix(h[pair] + mix(h[pair + 1])) if len(pair) else np.zeros(0, np.uint64)
    # lines
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.unique(np.concatenate([t.offsets[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(t.data)]
    line_end = np.append(line_start[1:], len(t.data))[: len(line_start)]
    line_doc = np.searchsorted(t.offsets, line_start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    line_hash = spans(sums, line_start, line_end - (t.data[line_end - 1] == 10), BYTE_POWERS)
    out = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), *(_share(classes[:, k], size) for k in range(classes.shape[1]))]
    out += [mean, np.sqrt(np.maximum(_share(per_doc(length.astype(float) ** 2), n_words) - mean**2, 0)), _share(per_doc((up == let) & (up > 0)), n_words), _share(per_doc((up == 1) & (let > 1)), n_words)]
    out += [_share(per_doc(length <= 3), n_words), _share(per_doc(length >= 12), n_words), _share(per_doc(let == 0), n_words), _share(per_doc((let > 0) & (length - let >= 2)), n_words)]
    words, top = _repeats(h, doc, n)
    out += [_share(words, n_words), _share(_repeats(pair_hash, doc[pair], n)[0], np.maximum(n_words - 1, 0)), _share(_repeats(line_hash, line_doc, n)[0], n_lines), _share(size, n_lines), _share(top, n_words)]
    return np.column_stack(out)


def batch_statistics(column: pa.Array) -> np.ndarray:
    found = [statistics(s) for _, s in Texts.of(column).slices(SLICE)]
    return np.concatenate(found) if found else np.zeros((0, N_STATISTICS))


N_STATISTICS = 3 + len(_CLASSES) + 13


@dataclass(frozen=True)
class Forest:
    """Trees side by side: feature, limit and left child by node; a leaf's feature is -1 and its value counts. The right child follows the left."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = self.left[node] + (x[rows, np.maximum(f, 0)] > self.limit[node])
                node = np.where(inner, step, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Boosted trees; statistics are binned at their quantiles, and a level's histograms are made in one pass each."""
    feature, limit, left, value, roots = [], [], [], [], []
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        raw, n_features = np.full(len(y), base), x.shape[1]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            node = np.zeros(len(y), np.int64)  # place of each row within its level
            level = [len(feature)]
            for arr, v in ((feature, -1), (limit, 0.0), (left, 0), (value, 0.0)):
                arr.append(v)
            live = np.ones(len(y), bool)
            for d in range(depth + 1):
                m = len(level)
                rows = np.flatnonzero(live)
                gs, hs, ns = np.bincount(node[rows], g[rows], m), np.bincount(node[rows], h[rows], m), np.bincount(node[rows], minlength=m)
                for k in range(m):
                    value[level[k]] = -rate * gs[k] / (hs[k] + l2)
                if d == depth:
                    break
                best = np.full(m, 1e-6)
                pick = np.full((m, 2), -1)
                for f in range(n_features):
                    at = node[rows] * bins + binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(at, w, m * bins).reshape(m, bins), 1) for w in (g[rows], h[rows], None))
                    gr, hr, nr = gs[:, None] - gl, hs[:, None] - hl, ns[:, None] - nl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None]
                    gain[(nl < least) | (nr < least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(m), b] > best
                    best[better] = gain[np.arange(m), b][better]
                    pick[better] = np.column_stack([np.full(m, f), b])[better]
                grown, child = [], np.full(m, -1)
                for k in range(m):
                    f, b = pick[k]
                    if f < 0:
                        continue
                    child[k] = len(grown)
                    feature[level[k]], limit[level[k]], left[level[k]] = int(f), float(cuts[f][b]), len(feature)
                    for _side in range(2):
                        grown.append(len(feature))
                        for arr, v in ((feature, -1), (limit, 0.0), (left, 0), (value, 0.0)):
                            arr.append(v)
                if not grown:
                    break
                f = pick[node[rows], 0]
                goes = child[node[rows]] + (binned[rows, np.maximum(f, 0)] > pick[node[rows], 1])
                live[rows[f < 0]] = False
                node[rows[f >= 0]] = goes[f >= 0]
                level = grown
            tree = Forest(0.0, np.array(roots[-1:]), *(np.array(a) for a in (feature, limit, left, value)))
            raw += _raw(tree, x)
    return Forest(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(limit), np.array(left, np.int64), np.array(value))


def _raw(tree: Forest, x: np.ndarray) -> np.ndarray:
    node, rows = np.full(len(x), tree.roots[0]), np.arange(len(x))
    while (inner := tree.feature[node] >= 0).any():
        node = np.where(inner, tree.left[node] + (x[rows, np.maximum(tree.feature[node], 0)] > tree.limit[node]), node)
    return tree.value[node]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "quality") -> Forest:
    """A forest from at most max_rows labelled documents outside the held-out quarter, though documents may repeat an id."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id")  # max_rows rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("y"), pa.array(list(batch_statistics(b.column("text"))), pa.list_(pa.float64()))], names=["doc_id", "text_hash", "y", "x"])

    measured = texts.select("doc_id", "text", "text_hash", "y").mapInArrow(measure, "doc_id long, text_hash long, y double, x array<double>")
    rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(max_rows).toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, N_STATISTICS)
    return fit(x, (rows["y"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    forest = train(docs, labels, max_rows)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in portions(whole, "text")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forest.scores(batch_statistics(b.column("text"))))], names=["doc_id", "score"])
        release()

    rows = texts.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.7) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    forest, at = train(docs, labels, max_rows), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [forest.scores(batch_statistics(p.column(at).cast(pa.string()))) >= threshold for p in portions(b, at)]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))
        release()

    return docs.mapInArrow(keep, docs.schema)

"""Near-duplicate detection by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its runs of five words (all its words, if fewer). Each
(shingle, level of its count) owns a Poisson process whose points fall on signature
components; a component keeps its earliest point, so two signatures agree in a
component with probability the weighted Jaccard similarity. Levels of a count are
grouped in dyadic blocks, and a block's process is split in halves only when its next
point can still matter, so a count of thousands costs few draws.

Equal texts are one node from the start. Bands of equal components make buckets. First each text is
compared with the least of each of its buckets, exactly, and only links found so are
closed to classes. Then only buckets are left whose other members fall into several
classes: a link may still lie between these. Their members meet in blocks of at most BLOCK,
each pair of blocks counts multiset overlaps exactly and reports a spanning forest of the
links found, not the pairs. So every pair of a bucket is in one class or was
compared, and strangers that share a band are never joined.

Two texts are linked if their similarity is `threshold` or more. Null texts are empty;
texts without words are alike only if equal. Repeated rows are in one class. A class's id is the
least doc_id in it (null if none has one). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import WORD_POWERS, Texts, mix, prefix, spans
from .components import components
from .exchange import release
from .store import discard, written
from .units import portions

SHINGLE, BANDS, ROWS = 5, 32, 5
#: Texts beside one least text, texts of one bucket in a block, and texts in a group of such.
STAR, BLOCK, SMALL_GROUP = 64, 512, 2048
PORTION = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each shingle, repeats included."""
    hashes, first = t.word_hashes()
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    return doc, spans(prefix(mix(hashes), WORD_POWERS), start, np.minimum(start + size, first[doc + 1]), WORD_POWERS)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document and how often they occur."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _waits(seed: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    u = (mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return -np.log1p(-u) / rate


def bag_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (earliest point of each component; infinite for documents without elements)."""
    sig = np.full(n_docs * m, np.inf)
    # dyadic blocks of levels: [0, 1), [1, 2), [2, 4), [4, 8), ...
    parts = []
    k = 0
    while True:
        low = 0 if k == 0 else 1 << (k - 1)
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        size = max(1, low)
        seed = mix(h[own] + np.uint64((k + 1) * int(_STEP) % (1 << 64)))
        parts.append((doc[own], seed, np.full(len(own), size), weight[own] - low, _waits(seed, m * size)))
        k += 1
    if not parts:
        return sig.reshape(n_docs, m)
    node_doc, seed, size, left, x = (np.concatenate([p[i] for p in parts]) for i in range(5))
    total = np.bincount(doc, weight, n_docs)
    bound = (np.log(m) + 2) / np.maximum(total, 1)  # most signatures are full by this time
    high = np.full(n_docs, np.inf)
    drawn = np.zeros(len(x), np.uint64)
    while True:
        live = x <= high[node_doc]
        if not live.all():
            node_doc, seed, size, left, x, drawn = (a[live] for a in (node_doc, seed, size, left, x, drawn))
        if not len(x):
            return sig.reshape(n_docs, m)
        due = x <= bound[node_doc]
        if not due.any():
            waiting = np.unique(node_doc)
            bound[waiting] *= 2
            continue
        leaf = due & (size == 1)
        at = np.flatnonzero(leaf)
        if len(at):
            component = (mix(seed[at] ^ (drawn[at] * _STEP + np.uint64(7))) % np.uint64(m)).astype(np.int64)
            np.minimum.at(sig, node_doc[at] * m + component, x[at])
            drawn[at] += np.uint64(1)
            x[at] += _waits(seed[at] + drawn[at] * _STEP, m)
            touched = np.unique(node_doc[at])
            high[touched] = sig.reshape(n_docs, m)[touched].max(1)
        at = np.flatnonzero(due & (size > 1))
        if len(at):  # the point lies in one half, which keeps it; the other half's first point comes later
            half = size[at] // 2
            lower = (mix(seed[at] + np.uint64(3)) & np.uint64(1)) == 0
            seeds = mix(seed[at] * np.uint64(2) + np.uint64(11)), mix(seed[at] * np.uint64(2) + np.uint64(12))
            later = x[at] + _waits(seed[at] + np.uint64(5), m * half)
            up = np.flatnonzero(left[at] > half)  # levels above the count take no part
            fresh = (node_doc[at][up], seeds[1][up], half[up], left[at][up] - half[up], np.where(lower, later, x[at])[up], np.zeros(len(up), np.uint64))
            seed[at], x[at], left[at], size[at], drawn[at] = seeds[0], np.where(lower, x[at], later), np.minimum(left[at], half), half, 0
            node_doc, seed, size, left, x, drawn = (np.concatenate([a, b]) for a, b in zip((node_doc, seed, size, left, x, drawn), fresh, strict=True))


def signatures(column: pa.Array, m: int) -> np.ndarray:
    out = [bag_min_hash(*counted(*shingles(s)), len(s), m) for _, s in Texts.of(column).slices(1 << 19)]
    return np.concatenate(out) if out else np.zeros((0, m))


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sig), bands)).copy()
    for r in range(rows):
        out = mix(out ^ bits[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


def _fingers(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in portions(whole, "text", PORTION)):
            sig = signatures(b.column("text"), bands * rows)
            hashes, empty = band_hashes(sig, bands, rows), np.isinf(sig[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]), pa.int32()), pa.array(hashes[~empty].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), lists], names=["doc_id", "text_hash", "bands"])
        release()

    return run


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted, distinct elements) have a Jaccard similarity of threshold or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets], float)
    flat, doc = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n), size.astype(int))
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.diff(flat, prepend=~flat[:1]) != 0 if len(flat) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(flat)))
    shared = np.repeat(times > 1, times)
    column = np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    doc = doc[shared]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s, e = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((n, min(4096, int(column[-1]) + 1 - a)), np.float32)
        block[doc[s:e], column[s:e] - a] = 1
        common += block @ block.T
    union = size[:, None] + size[None, :] - common
    out = (common >= threshold * union - 1e-6) & (union > 0)
    np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this adjacency."""
    todo, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root] or not linked[root].any():
            continue
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & todo)
            todo[new] = False
            edges += [(root, int(j)) for j in new]
            front += new.tolist()
    return edges


def multisets(texts: pa.Array) -> list[np.ndarray]:
    """The elements of each text: shingles, each with which time it occurs, as sorted hashes."""
    out: list[np.ndarray] = []
    for _, s in Texts.of(texts).slices():
        doc, h, n = counted(*shingles(s))
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        element, of = mix(np.repeat(h, n) + nth.astype(np.uint64) * _STEP), np.repeat(doc, n)
        order = np.lexsort((element, of))
        element, of = element[order], of[order]
        cut = np.searchsorted(of, np.arange(len(s) + 1))
        out += [element[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two multisets have a Jaccard similarity of threshold or more."""
    if not len(a) or min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-6:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= threshold * (len(a) + len(b) - common) - 1e-6


def _grouped(t: pa.Table, *keys: str) -> tuple[pa.Table, list[np.ndarray], Iterator[tuple[int, int]]]:
    """A table in order of some keys and row, its texts' multisets, and where each value of the keys begins and ends."""
    t = t.sort_by([(k, "ascending") for k in (*keys, "row")])
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([np.diff(t[k].to_numpy()) != 0 for k in keys], axis=0)
    at = np.flatnonzero(new).tolist()
    return t, multisets(t["text"].combine_chunks()), zip(at, [*at[1:], t.num_rows], strict=True)


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    release()
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _stars(threshold: float):
    """Links between the least text of a group (its row is `lead`) and the others."""

    def run(t: pa.Table) -> pa.Table:
        t, sets, groups = _grouped(t, "lead", "parts", "part")
        rows, leads, found = t["row"].to_numpy(), t["lead"].to_numpy(), []
        for a, b in groups:
            own = sets[a + int(np.argmax(rows[a:b] == leads[a]))]
            found += [(int(rows[i]), int(leads[i])) for i in range(a, b) if rows[i] != leads[i] and similar(sets[i], own, threshold)]
        return _edges(found)

    return run


def _blocks(threshold: float):
    """A spanning forest of the links between the texts of each group."""

    def run(t: pa.Table) -> pa.Table:
        t, sets, groups = _grouped(t, "band", "i", "j")
        rows, found = t["row"].to_numpy(), []
        for a, b in groups:
            found += [(int(rows[a + i]), int(rows[a + j])) for i, j in forest(links(sets[a:b], threshold))]
        return _edges(found)

    return run


def _met(want: DataFrame, texts: DataFrame, keys: tuple[str, ...], n_rows: int, verify) -> DataFrame:
    """Edges from the groups of texts that `want` (row and keys) names; small groups share a call."""
    own = F.pmod(F.xxhash64(*keys), F.lit(max(1, n_rows // SMALL_GROUP))).cast("int")
    return want.join(texts, "row").withColumn("shared", own).groupBy("shared").applyInArrow(verify, "a long, b long")


def _labelled(nodes: DataFrame, near: DataFrame) -> DataFrame:
    return nodes.join(near.select(F.col("a").alias("row"), F.col("b").alias("root")), "row", "left").withColumn("root", F.coalesce("root", "row"))


def _joined(near: DataFrame, links_: DataFrame) -> DataFrame:
    """Classes (a, b) after more links: only links between different classes are closed over, by the classes' roots."""
    root = lambda side: near.select(F.col("a").alias(side), F.col("b").alias(f"{side}_root"))
    ends = links_.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    across = written(ends.where("a != b").distinct(), "across")
    if across.isEmpty():
        discard(across)
        return near
    above = components(across)
    moved = near.join(above.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left").select("a", F.coalesce("top", "b").alias("b"))
    out = written(moved.unionByName(above), "classes")
    discard(near, across, above)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, text_hash and keeper of each row; one row of each class is its keeper. A stored table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_hash"), text.alias("text"))
    fingers = source.mapInArrow(_fingers(bands, rows), "doc_id long, text_hash string, bands array<long>")
    base = written(fingers.withColumn("row", F.monotonically_increasing_id()), "fingers")
    # one node for each text: its row of the least id, rows without one last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = written(base.groupBy("text_hash").agg(first.alias("first"), F.first("bands").alias("bands")).select("text_hash", "first.doc_id", "first.row", "bands"), "nodes")
    banded = nodes.select("row", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("row").alias("lead"), F.count("*").alias("n")).where("n > 1")
    held = written(banded.join(leads, "band").where("row != lead"), "buckets")
    # a least text meets the others STAR at a time, so one with very many is dealt over tasks
    stars = written(held.groupBy("row", "lead").agg(F.ceil(F.max("n") / STAR).cast("int").alias("parts")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")), "stars")
    both = stars.unionByName(stars.select("lead", "parts", "part").distinct().withColumn("row", F.col("lead")))
    members = nodes.join(both.select("row").distinct(), "row").select("row", "text_hash", "doc_id")
    texts = written(source.alias("s").join(members.alias("m"), (F.col("s.text_hash") == F.col("m.text_hash")) & F.col("s.doc_id").eqNullSafe(F.col("m.doc_id"))).select("m.row", "s.text").dropDuplicates(["row"]), "texts")
    sure = written(_met(both, texts, ("lead", "parts", "part"), stars.count(), _stars(threshold)), "links")
    near = components(sure)
    # buckets whose members, but for the least, are of several classes; the same members under several bands count once
    roots = _labelled(held.select("band", "row"), near)
    members = [F.count("*"), F.min("row"), F.max("row"), *(F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")) for i in range(2))]
    open_bands = roots.groupBy("band").agg((F.min("root") != F.max("root")).alias("several"), F.struct(*(c.alias(f"m{i}") for i, c in enumerate(members))).alias("members")).where("several")
    once = open_bands.groupBy("members").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("members.m0") / BLOCK).cast("int").alias("blocks"))
    # a small bucket is one group; a block of a large one meets each block, itself included
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    want = written(held.select("band", "row").join(once, "band").withColumn("block", block).select("band", "row", F.explode(meets).alias("g")).select("band", "row", "g.i", "g.j"), "open")
    n_open = want.count()
    if n_open:
        near = _joined(near, _met(want, texts, ("band", "i", "j"), n_open, _blocks(threshold)))
    discard(held, stars, texts, sure, want)
    labelled = _labelled(nodes.select("text_hash", "doc_id", "row"), near)
    heads = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    classes = labelled.join(heads, "root").select("text_hash", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head_row"))
    out = written(base.select("doc_id", "text_hash", "row").join(classes, "text_hash").select("doc_id", "class_id", "text_hash", (F.col("row") == F.col("head_row")).alias("keeper")), "classes")
    discard(base, nodes, near)
    return out


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with the keeper of each class alone, with all their columns."""
    classes = near_duplicates(docs, threshold)
    keepers = classes.where("keeper").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    text_hash = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    kept = docs.join(keepers, docs["doc_id"].eqNullSafe(F.col("k_id")) & (text_hash == F.col("k_hash")), "left_semi")
    repeated = classes.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    name = "text_hash"
    while name in docs.columns:
        name += "_"
    return kept.withColumn(name, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).dropDuplicates(["doc_id", name]).drop(name)

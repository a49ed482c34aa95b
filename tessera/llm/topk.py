"""Exact top-k by integer inner product, with MaxScore pruning.

A vector is a document whose terms are its dimensions; a query's terms are its components.
A shard keeps, for every group of TERMS terms, the postings of the candidates that have one of them.
Queries with like heavy terms are searched together, in one order of terms; each query
has its own split: the terms after it are non-essential, because the bound on what they can add together
(the least of the sum of their highest contributions and the product of norms) does not exceed the
query's threshold. Essential postings are traversed for all candidates; the others are probed, a group of
terms at a time, only for candidates that are still competitive. Blocks of candidates are
shards: each gives its own best k of a query, and a window merges them. Where products may exceed what a double holds, bounds have a
margin for its error, and the candidates that pass them are scored again in whole numbers.

Queries and candidates are packed into blocks of rows; a block of queries meets a
block of candidates by an equi-join on the shard number, so the rows shuffled are
blocks, not pairs.

Vectors that are null, or hold a null or non-finite component, and rows without an id take no part; an
empty vector, or a shorter one, counts as padded with zeros. Components are floor(scale * x), held within the
range of a long; scores are exact, and those outside a long's range count as its ends. Rows that
repeat an id: each is a query of its own with results of its own, and candidates with the query's id
are left out. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import release

QUERY_BLOCK, CANDIDATE_BLOCK, SHARD_BLOCKS = 1024, 32768, 8
INNER_BLOCK, MOST_INNER, TOGETHER, TERMS = 1024, 16384, 64, 8
BLOCK = "block long, n int, dim int, width int, ids binary, rows binary"
#: The largest double below the end of a long.
MOST = float((1 << 63) - 1024)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and the integer components of all vectors that take part."""
    x = F.col(column)
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))).cast("long")
    return vectors.where(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def out() -> pa.RecordBatch:
            nonlocal block
            block += 1
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            whole = np.zeros((len(rows), max(1, int(n.max()))), np.int64)
            whole[np.arange(whole.shape[1]) < n[:, None]] = np.concatenate(rows)
            width = 4 if np.abs(whole // 2).max(initial=0) < 1 << 30 else 8
            values = [(task << 24) + block - 1], [len(rows)], [whole.shape[1]], [width], [np.array(ids, np.int64).tobytes()], [whole.astype(f"<i{width}").tobytes()]
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "n", "dim", "width", "ids", "rows"])

        for b in batches:
            column = b.column(1)
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            for i, key in enumerate(b.column(0).to_pylist()):
                ids.append(key)
                rows.append(flat[at[i] : at[i + 1]])
                if len(rows) == size:
                    yield out()
                    ids, rows = [], []
        if rows:
            yield out()

    return pack


class Best:
    """Positions and scores of each query's best k so far, and the score that a later candidate must exceed."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.where, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, i: int, where: np.ndarray, scores: np.ndarray) -> None:
        """Candidates come in order of id, so a tie with the threshold loses."""
        s, w = np.concatenate([self.scores[i], scores]), np.concatenate([self.where[i], where])
        if len(s) > self.k:
            keep = np.flatnonzero(s >= np.partition(s, len(s) - self.k)[len(s) - self.k])
            s, w = s[keep], w[keep]
        top = np.lexsort((w, ~s))[: self.k]
        self.where[i], self.scores[i] = w[top], s[top]
        if len(top) == self.k:
            self.floor[i] = float(s[top[-1]])


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of components of any size. Sums wrap, which is right for all that a long can hold; the others are its ends."""
    x, y = q.astype(np.float64), c.astype(np.float64).T
    about, error = x @ y, (np.abs(x) @ np.abs(y)) * 1e-12
    out = q @ c.T
    end = float(1 << 63)
    out[about >= end + error], out[about <= -end - error] = (1 << 63) - 1, -(1 << 63)
    for i, j in np.argwhere(np.abs(np.abs(about) - end) < error).tolist():
        whole = sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist(), strict=True))
        out[i, j] = max(-(1 << 63), min((1 << 63) - 1, whole))
    return out


def max_score(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, inner: int = INNER_BLOCK) -> tuple[Best, np.ndarray, int]:
    """The best k candidates of each query (ties to the smaller id), the order of candidates that positions refer to, and how many postings were read."""
    order = np.argsort(c_ids, kind="stable")
    c, c_ids, best, read = c[order], c_ids[order], Best(len(q), k), 0
    size = lambda m: int(max(m.max(initial=0), -int(m.min(initial=0))))
    big = size(q) * size(c) * q.shape[1]
    kind = np.float32 if big < 1 << 24 else np.float64
    if sure := big >= 1 << 53:  # bounds are compared with a margin; who is left is scored again in whole numbers
        q, c = q.astype(np.int64), c.astype(np.int64)
    alike = np.argsort(np.abs(q.astype(np.float64)).argmax(1), kind="stable")  # queries with one heaviest term lie together
    at, step = 0, inner
    while at < len(c):  # thresholds rise in the first, small blocks; later ones are larger
        whole, part_ids = c[at : at + step], c_ids[at : at + step]
        part = whole.astype(kind)
        high, low = part.max(0).astype(np.float64), part.min(0).astype(np.float64)
        for a in range(0, len(q), TOGETHER):
            read += _together(q, q_ids, alike[a : a + TOGETHER], part, part_ids, high, low, at, best, whole if sure else None)
        at, step = at + step, min(2 * step, max(inner, MOST_INNER))
    return best, order, read


def _together(q: np.ndarray, q_ids: np.ndarray, own: np.ndarray, part: np.ndarray, part_ids: np.ndarray, high: np.ndarray, low: np.ndarray, at: int, best: Best, whole: np.ndarray | None = None) -> int:
    """Searches a block of candidates for some queries that share an order of terms. Gives the number of postings read. whole: the candidates in whole numbers, where floats do not hold their products."""
    x = q[own].astype(np.float64)
    reach = np.maximum(x * high, x * low)  # the most that each term can add
    terms = np.argsort(-(np.abs(x).sum(0) * np.maximum(np.abs(high), np.abs(low))), kind="stable")
    groups = [terms[i : i + TERMS] for i in range(0, len(terms), TERMS)]
    # what the groups from the jth on can add: by single terms, and by norms
    later = lambda m: np.concatenate([np.cumsum(m[:, ::-1], 1)[:, ::-1], np.zeros((len(m), 1))], 1)
    by_term = later(np.column_stack([reach[:, g].sum(1) for g in groups]))
    q_norm = np.sqrt(later(np.column_stack([(x[:, g] ** 2).sum(1) for g in groups])))
    c_norm = np.sqrt(later(np.column_stack([(part[:, g].astype(np.float64) ** 2).sum(1) for g in groups])))
    bound = np.minimum(by_term, q_norm * c_norm.max(0))
    floor = best.floor[own]
    essential = (bound > floor[:, None]).sum(1)  # bounds fall from group to group once they are below the threshold
    essential = np.where(np.isinf(floor), len(groups), np.minimum(essential, len(groups)))
    scores, read = np.zeros((len(own), len(part)), part.dtype), 0
    query, postings = x.astype(part.dtype), []
    for g in groups:
        held = np.flatnonzero(part[:, g].any(1))
        postings.append((held if 2 * len(held) < len(part) else slice(None), np.ascontiguousarray(part[:, g].T if 2 * len(held) >= len(part) else part[held][:, g].T)))
    for j, (held, values) in enumerate(postings):
        live = np.flatnonzero(essential > j)
        if not len(live):
            break
        more = query[np.ix_(live, groups[j])] @ values
        if isinstance(held, slice):
            scores[live] += more
        else:
            scores[np.ix_(live, held)] += more
        read += len(live) * values.size
    slack = 1e-6 * (1 + np.abs(bound).max(initial=0))
    for n, i in enumerate(own.tolist()):
        alive = np.flatnonzero(part_ids != q_ids[i])
        for j in range(int(essential[n]), len(groups) + 1):
            rest = np.minimum(by_term[n, j], q_norm[n, j] * c_norm[alive, j])
            alive = alive[scores[n, alive] + rest + slack > floor[n]]
            if j == len(groups) or not len(alive):
                break
            scores[n, alive] += part[np.ix_(alive, groups[j])] @ query[n, groups[j]]
            read += len(alive) * len(groups[j])
        if len(alive):
            best.add(i, alive + at, scores[n, alive].astype(np.int64) if whole is None else exact_scores(q[i : i + 1], whole[alive])[0])
    return read


def _search(k: int, inner: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}
                q = np.frombuffer(x["q_rows"], f"<i{x['q_width']}").reshape(x["q_n"], x["q_dim"])
                c = np.frombuffer(x["rows"], f"<i{x['width']}").reshape(x["n"], x["dim"])
                dim = max(q.shape[1], c.shape[1])
                q, c = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (q, c))
                q_ids, c_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                best, order, _ = max_score(q, q_ids, c, c_ids, k, inner)
                n, which = [len(w) for w in best.where], np.concatenate(best.where)
                columns = np.repeat(q_ids, n), np.repeat(x["q_block"] * QUERY_BLOCK + np.arange(len(q)), n), c_ids[order[which]], np.concatenate(best.scores)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["query_id", "query_row", "vec_id", "score"])
        release()

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, inner: int = INNER_BLOCK, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query. vectors: vec_id and v, as integer_vectors gives them.

    block: candidates of a shard's block; inner: how many of them are searched before thresholds rise for the first time.
    """
    candidates = vectors.mapInArrow(_pack(block), BLOCK)
    queries = vectors.where(is_query).mapInArrow(_pack(QUERY_BLOCK), BLOCK).select(*(F.col(c).alias(f"q_{c}") for c in ("block", "n", "dim", "width", "ids", "rows")))
    shards = max(16, vectors.count() // (block * SHARD_BLOCKS))  # a block of queries is copied once a shard
    pairs = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(candidates.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")), "shard")
    found = pairs.mapInArrow(_search(k, inner), "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round shrinks trees towards stars whose centre is the least node; a round's edges are
written to the shared folder, so lineage stays short and a lost executor costs no earlier
round. Neighbourhoods are only aggregated (a minimum each) and joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) of each node of `edges` (long a, long b) but the least of its component, which is b."""
    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    e_stored, before = e, _state(e)
    for _ in range(most_rounds):
        # a node's least neighbour; nodes that are no edge's greater end are least themselves. Stored, so that the join
        # below has a plain exchange on both sides and a node with very many neighbours can be split over tasks.
        least = written(e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "least")
        large = e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        last, e = e_stored, written(e, "edges")
        discard(last, least)
        e_stored, now = e, _state(e)
        if now == before:
            return e
        before = now
    raise RuntimeError("the components did not settle")

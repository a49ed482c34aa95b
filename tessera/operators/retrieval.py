"""Exact filtered vector search, section policy and citations."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import knn

ITEM_1, ITEM_1A, ITEM_7, ITEM_7A = "Item 1", "Item 1A", "Item 7", "Item 7A"
# What a narrative question may search, where a label is stored otherwise, and what is searched in its absence.
POLICY = {
    "company_overview": (ITEM_1,), "strategy": (ITEM_1, ITEM_7), "competition_and_regulation": (ITEM_1, ITEM_1A), "risk_factors": (ITEM_1A,),
    "management_commentary": (ITEM_7,), "market_risk": (ITEM_7A, ITEM_7),
}
SECTION_ALIASES = {("QCOM", ITEM_1): (ITEM_1A,), ("META", ITEM_1): (ITEM_1A,)}
FALLBACKS = {"market_risk": (ITEM_1A,)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; lower is closer."""
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64, text: str = "text") -> DataFrame:
    """chunks with the vector of each text, from any function of a list of texts; it is called for at most `batch` texts at a time. Null texts are empty."""
    columns = chunks.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield part.assign(embedding=embed(part[text].fillna("").tolist()))[[*columns, "embedding"]]

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def hashed_words(texts: list[str], dim: int = 256) -> list[list[float]]:
    """A stand-in for a model, for tests and use without a network: counts of words by a hash of each."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % dim] += 1.0
        out.append(v)
    return out


def nearest(chunks: DataFrame, query: list[float], k: int, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest chunks of those that pass the filter, fewer if there are fewer; ties by key."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = chunks.where(where) if where is not None else chunks
    vector = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", cosine_distance(F.col("embedding"), vector)).orderBy("distance", key).limit(k)


def nearest_each(chunks: DataFrame, query: list[float], k: int, group: str, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest of each group, so large groups crowd no other out; ranked from 1."""
    rows = chunks.where(where) if where is not None else chunks
    vector = F.array(*(F.lit(float(x)) for x in query))
    w = Window.partitionBy(group).orderBy("distance", key)
    return rows.withColumn("distance", cosine_distance(F.col("embedding"), vector)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


SAME_COMPANY, OTHER_COMPANY = "wrong_block_same_company", "wrong_block_other_company"


def seed_swap(seeds: DataFrame, chunks: DataFrame, rank: int = 10, key: str = "vec_id") -> DataFrame:
    """The chunk each seed's citation is swapped for, searched exactly in the cited section; ties by key.

    seeds: seed_id, kind, company, section, claim (a vector), cited array of keys; chunks: key, company, section, embedding.
    A same-company seed takes the `rank`th nearest of the company's chunks it does not cite, the last if there are fewer; an
    other-company seed the nearest of any other company. A seed without a candidate stays, with a null key and its status.
    Any number of seeds: they meet blocks of chunks that may be near enough (see knn).
    """
    if rank < 1:
        raise ValueError("rank must be at least 1")
    same = F.col("kind") == SAME_COMPANY
    asked = seeds.select("seed_id", "kind", "company", "section", F.col("claim").alias("embedding"), F.when(same, F.col("cited")).alias("cited"))

    def allowed(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
        one_company = q["company"].to_numpy()[:, None] == c["company"].to_numpy()
        return (q["section"].to_numpy()[:, None] == c["section"].to_numpy()) & (one_company == (q["kind"].to_numpy() == SAME_COMPANY)[:, None])

    found = knn.nearest_many(chunks, asked, rank, key, "seed_id", columns=("company", "section"), query_columns=("kind", "company", "section"), match=allowed, excluded="cited")
    picked = found.join(seeds.select("seed_id", "kind"), "seed_id").where(same | (F.col("rank") == 1)).groupBy("seed_id").agg(F.max("rank").alias("nth"), F.max_by(key, "rank").alias(key), F.max_by("distance", "rank").alias("distance"))
    out = seeds.select("seed_id", "kind", "company", "section").join(picked, "seed_id", "left")
    return out.withColumn("status", F.when(F.col(key).isNull(), "no_candidate").otherwise("swapped"))


def with_status(groups: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Every eligible group with the number of blocks found and a status."""
    n = found.groupBy(group).agg(F.count("*").alias("n_blocks"))
    return groups.join(n, group, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0))).withColumn("status", F.when(F.col("n_blocks") > 0, "searched").otherwise("no_matching_chunks"))


def with_fallback(groups: DataFrame, chunks: DataFrame, primary: Column, fallback: Column, group: str) -> DataFrame:
    """Chunks of each group's own sections; of the fallback sections only for groups that hold none of their own."""
    tagged = chunks.where(primary | fallback).withColumn("_own", primary)
    has = tagged.groupBy(group).agg(F.max("_own").alias("_has"))
    used = tagged.join(has, group).where(F.col("_own") == F.col("_has")).withColumn("fallback_used", ~F.col("_own")).drop("_own", "_has")
    return groups.select(group).join(used, group)


def stored_sections(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Sections to search: an alias of (ticker, section) replaces the section; sorted and distinct per ticker."""
    each = asked.select("ticker", F.explode("sections").alias("section"))
    mapped = each.join(aliases.select("ticker", "section", "stored"), ["ticker", "section"], "left")
    return mapped.groupBy("ticker").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("stored", F.array("section")))))).alias("sections"))


def numbered_context(found: DataFrame, group: str, text: str = "text") -> DataFrame:
    """One text per group with its blocks numbered from 1."""
    return found.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda b: F.concat(F.lit("["), b["rank"].cast("string"), F.lit("] "), b["t"])), "\n").alias("context"))


def candidate_pool(ranked: DataFrame, hits: DataFrame, top: int = 10, cap: int = 25, key: str = "vec_id") -> DataFrame:
    """The first `top` by rank, then the best `cap` by keyword hits (rank breaks ties), each key once at its first place."""
    a = ranked.where(F.col("rank") <= top).select(key, F.col("rank").alias("place"))
    b = ranked.join(hits, key).where("hits > 0").orderBy(F.col("hits").desc(), "rank").limit(cap)
    b = b.withColumn("place", F.lit(top) + F.row_number().over(Window.orderBy(F.col("hits").desc(), "rank"))).select(key, "place")  # cap rows
    return a.unionByName(b).groupBy(key).agg(F.min("place").alias("place"))


def chunks_by_key(chunks: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The chunks with these identities; keys nobody holds stay absent."""
    return chunks.join(keys.select(*columns).distinct(), columns, "left_semi")


def citation_numbers(refs: DataFrame, answer: tuple[str, ...] = ()) -> DataFrame:
    """Answer-wide numbers by first citation of (ticker, fiscal_year, section, chunk_index); refs has position.

    With the columns of `answer`, many answers are numbered at once, each by itself; without them, all references are one answer's, whose
    sources are few.
    """
    identity = ["ticker", "fiscal_year", "section", "chunk_index"]
    first = refs.groupBy(*answer, *identity).agg(F.min("position").alias("first_position"))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(*answer).orderBy("first_position")))

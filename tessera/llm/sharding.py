"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id modulo a fixed number of slots, so it never
changes. Which shard serves a slot is a small table (one row a slot, so its size
has a fixed bound) that is edited, not recomputed, when shards are rebalanced or
added; each edit makes a new version. All versions are stored with the edits that made them, so any
can be loaded and the way to it read.

Under law "key" the slot is a hash of the id alone, so rows that repeat an id are in one slot, as that law asks. Under law "bytes" it is a hash of id and
text; of rows that repeat both, up to SHARES shares go to slots of their own, so that no group of equal rows makes a shard heavy. Equal rows
are counted first and get their places from their number, so they are one row in every shuffle however many they are. Null texts have size 1, as
empty ones; rows without an id are spread by their text and their number. Places in a slot are numbered in SUBS lots by a hash of the text, so that a slot is no task of
its own. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, SUBS, SHARES, RUN = 4096, 16, 1024, 1 << 16
MAP, EDITS = "version int, n_shards int, vslot int, shard int", "version int, vslot int, source int, target int"


@dataclass(frozen=True)
class SlotMap:
    """owner[s] is the shard of slot s; history has (version, slot, from, to) of each edit."""

    n_shards: int
    owner: tuple[int, ...]
    version: int = 0
    history: tuple[tuple[int, int, int, int], ...] = field(default=(), compare=False)

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return cls(n_shards, tuple(s % n_shards for s in range(n_slots)))

    def _edited(self, moves: dict[int, int], n_shards: int | None = None) -> SlotMap:
        v = self.version + 1
        owner = list(self.owner)
        for s, to in moves.items():
            owner[s] = to
        edits = tuple((v, s, self.owner[s], to) for s, to in sorted(moves.items()) if self.owner[s] != to)
        return SlotMap(n_shards or self.n_shards, tuple(owner), v, self.history + edits)

    def rebalanced(self, loads: dict[int, int]) -> SlotMap:
        """Moves slots, or swaps two, between the heaviest and the lightest shard while that narrows their gap."""
        owner, total = list(self.owner), [0] * self.n_shards
        held: list[set[int]] = [set() for _ in total]
        for s, shard in enumerate(owner):
            total[shard] += loads.get(s, 0)
            if loads.get(s, 0):
                held[shard].add(s)
        for _ in range(4 * len(owner)):
            high, low = max(range(self.n_shards), key=lambda k: (total[k], -k)), min(range(self.n_shards), key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            if gap <= 1:
                break
            best, give, take = gap, None, None  # what is left of the gap
            for s in sorted(held[high]):
                if abs(gap - 2 * loads[s]) < best:
                    best, give, take = abs(gap - 2 * loads[s]), s, None
            if best > gap // 64:
                low_slots = sorted((loads[s], s) for s in held[low])
                for s in sorted(held[high]):
                    want, lo, hi = loads[s] - gap / 2, 0, len(low_slots)
                    while lo < hi:
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if low_slots[mid][0] < want else (lo, mid)
                    for load, t in low_slots[max(0, lo - 1) : lo + 1]:
                        if abs(gap - 2 * (loads[s] - load)) < best:
                            best, give, take = abs(gap - 2 * (loads[s] - load)), s, t
            if give is None:
                break
            for s, a, b in ((give, high, low), (take, low, high)):
                if s is not None:
                    owner[s] = b
                    held[a].remove(s)
                    held[b].add(s)
                    total[a] -= loads[s]
                    total[b] += loads[s]
        return self._edited({s: k for s, k in enumerate(owner) if k != self.owner[s]})

    def grown(self) -> SlotMap:
        """One more shard, which takes an even share of the slots from the shards that have most; no other slot moves."""
        n, moves = self.n_shards + 1, {}
        held = [[s for s, k in enumerate(self.owner) if k == shard] for shard in range(self.n_shards)]
        for _ in range(len(self.owner) // n):
            moves[max(held, key=len).pop()] = self.n_shards
        return self._edited(moves, n)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, s, k) for s, k in enumerate(self.owner)], MAP)

    def save(self, spark: SparkSession, path: str) -> None:
        """Stores this version and the edits up to it; other versions stay."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/map/version={self.version}")
        spark.createDataFrame(list(self.history), EDITS).coalesce(1).write.mode("overwrite").parquet(f"{path}/edits/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.schema(MAP).parquet(f"{path}/map/version={version}").orderBy("vslot").collect()  # a row a slot
        edits = spark.read.schema(EDITS).parquet(f"{path}/edits/version={version}").orderBy("version", "vslot").collect()
        return cls(rows[0].n_shards, tuple(r.shard for r in rows), version, tuple(map(tuple, edits)))


def sized(docs: DataFrame, key: Column, text: Column, n_slots: int = SLOTS, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, copies, vslot, sub: equal rows counted, and in law "bytes" dealt to shares of about one size."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_hash"))
    equal = rows.groupBy("doc_id", "size", "text_crc32", "_hash").agg(F.count("*").alias("_n"))
    shares = F.least("_n", F.lit(SHARES if law == "bytes" else 1)).cast("int")
    each = equal.withColumn("_shares", shares).withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    copies = F.floor(F.col("_n") / F.col("_shares")) + F.when(F.col("_share") < F.col("_n") % F.col("_shares"), 1).otherwise(0)
    slot = F.xxhash64("doc_id") if law == "key" else F.when(F.col("_share") == 0, F.xxhash64("doc_id", "_hash")).otherwise(F.xxhash64("doc_id", "_hash", "_share"))
    return each.select("doc_id", "size", "text_crc32", "_hash", "_share", copies.cast("long").alias("copies"), F.pmod(slot, F.lit(n_slots)).cast("int").alias("vslot"), F.pmod(F.shiftright("_hash", 32), F.lit(SUBS)).cast("int").alias("sub"))


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS, law: str = "bytes", slot_map: SlotMap | None = None, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Places of all documents, and the map used; with `store`, the map is saved there and the places come from what was loaded back.

    law "bytes": the slots' bytes are aggregated (at most SUBS * n_slots rows come to the
    driver) and the map is edited until the shards' bytes are near equal.
    law "key": the map depends on the number of shards alone, and grown_shard tells
    where a row goes with one more shard.
    """
    if law not in ("bytes", "key"):
        raise ValueError(f"no such law: {law}")
    spark, rows = docs.sparkSession, sized(docs, docs["doc_id"], docs["text"], n_slots, law)
    lots = {(r.vslot, r["sub"]): (r.n, r.bytes) for r in rows.groupBy("vslot", "sub").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("bytes")).collect()}
    placed = slot_map or SlotMap.initial(n_shards, n_slots)
    if law == "bytes":
        loads: dict[int, int] = {}
        for (s, _), (_, b) in lots.items():
            loads[s] = loads.get(s, 0) + b
        placed = placed.rebalanced(loads)
    if store:
        placed.save(spark, store)
        placed = SlotMap.load(spark, store, placed.version)
    later, next_place, bases = placed.grown(), [0] * placed.n_shards, []
    for (s, sub), (n, _) in sorted(lots.items()):
        k = placed.owner[s]
        bases.append((s, sub, k, next_place[k], later.owner[s] if law == "key" else None))
        next_place[k] += n
    bounded = spark.createDataFrame(bases, "vslot int, sub int, shard int, base long, grown_shard int")  # at most SUBS * n_slots rows
    in_lot = Window.partitionBy("vslot", "sub").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32", "_hash", "_share").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("copies").over(in_lot), F.lit(0))).join(F.broadcast(bounded), ["vslot", "sub"])
    runs = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    here = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run") * RUN)
    each = runs.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), here - 1)))
    place = F.col("base") + F.col("before") + F.col("run") * RUN + F.col("nth")
    return each.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", place.cast("long").alias("slot"), "grown_shard", F.col("vslot").alias("virtual_slot"), F.lit(placed.version).alias("map_version")), placed

"""Chunks with vectors, keyed by filing, in versions (see snapshots), with the parameters they were made under."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots

KEYS = ["source_cik", "source_year"]


def params_hash(**params: object) -> str:
    """Twelve hex digits over every parameter that changes the chunks."""
    return hashlib.sha256("|".join(f"{k}={params[k]}" for k in sorted(params)).encode()).hexdigest()[:12]


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, params: str) -> None:
        self.params, self.table = params, Snapshots(spark, path, KEYS, params)

    def matches(self) -> bool | None:
        """Whether the store was built with these parameters (None: it does not say). A mismatch is reported, not raised."""
        held = self.table.manifest()["params"]
        return None if held is None else held == self.params

    def add(self, chunks: DataFrame) -> int:
        """Replaces the filings that occur in chunks, as one version; chunks with a null in their metadata are refused."""
        meta = [c for c in chunks.columns if c.startswith("source_") or c == "chunk_index"]
        if chunks.where(F.greatest(*(F.col(c).isNull() for c in meta))).limit(1).count():
            raise ValueError("chunk metadata must not be null")
        return self.table.upsert(chunks)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def count(self) -> int:
        """Chunks in the store, or -1 if it cannot be read."""
        try:
            m = self.table.manifest()
            return self.table.read().count() if m["version"] and m["folders"] else -1
        except Exception:  # noqa: BLE001  any failure to read means the same here
            return -1

    def reset(self, docs: DataFrame) -> DataFrame:
        """Empties the store; the documents come back with is_embedded cleared, so the two agree."""
        self.table.clear()
        return docs.withColumn("is_embedded", F.lit(False))

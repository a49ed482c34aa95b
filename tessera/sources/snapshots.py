"""Tables of which every version can be read: partitions copied on write, and a manifest for each version.

Rows are dealt into a fixed number of buckets by a hash of their key. A change writes new files for the buckets it touches
and leaves all others; then a manifest that names the files of every bucket is put in place by one rename. So a reader has either the old version
or the new one, a version that is being read stays as it is, and a change that does not end leaves files that no manifest names. The rename must
be one that does not replace what is there, as a distributed file system's is; of two changes made at once one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Files

BUCKETS = 16


class Conflict(RuntimeError):
    """Another change was committed in the meantime; nothing was changed by this one."""


class Snapshots:
    """A table under a path, keyed by some columns; params say what it was made under and stand in each manifest."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], params: str = "", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.params, self.buckets = spark, path.rstrip("/"), keys, params, buckets
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Parameters, columns and the folder of each bucket; without a version the latest, of an empty table if there is none."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "params": None, "buckets": self.buckets, "schema": None, "folders": {}}
        return json.loads(self.files.read_text(self._manifest(version)))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["version"]:
            raise ValueError(f"nothing is stored under {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        folders = sorted(m["folders"].values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame) -> int:
        """Replaces all rows of each key that occurs; gives the new version. Rows of one key come together, however many they are."""
        return self._changed(rows, rows.select(*self.keys).distinct())

    def delete(self, keys: DataFrame) -> int:
        """Leaves out all rows of these keys; gives the new version."""
        return self._changed(None, keys.select(*self.keys).distinct())

    def clear(self) -> int:
        m = self.manifest()
        return self._committed(m, {}, m["schema"])

    def expire(self, keep: int = 1) -> None:
        """Forgets all but the last versions, and removes the files that none of these names."""
        versions = sorted(self.versions())
        gone, left = versions[:-keep], versions[-keep:]
        named = {f.rsplit("/", 1)[0] for v in left for f in self.manifest(v)["folders"].values()}
        unnamed = {f.rsplit("/", 1)[0] for v in gone for f in self.manifest(v)["folders"].values()} - named
        for v in gone:
            self.files.remove(self._manifest(v))
        for f in unnamed:
            self.files.remove(f)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:08d}.json"

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _changed(self, rows: DataFrame | None, keys: DataFrame) -> int:
        m = self.manifest()
        n = m["buckets"]
        schema = rows.schema.jsonValue() if m["schema"] is None else m["schema"]
        columns = [f["name"] for f in schema["fields"]]
        if rows is not None and sorted(rows.columns) != sorted(columns):
            raise ValueError(f"the table has the columns {columns}")
        touched = [r[0] for r in keys.select(self._bucket(n).alias("b")).distinct().collect()]  # at most the number of buckets
        old = [m["folders"][str(b)] for b in touched if str(b) in m["folders"]]
        new = rows.select(*columns) if rows is not None else None
        if old:
            same = [F.equal_null(F.col(f"_o.{k}"), F.col(f"_k.{k}")) for k in self.keys]  # a null key is a key
            kept = self.spark.read.schema(T.StructType.fromJson(schema)).parquet(*old).alias("_o").join(keys.alias("_k"), same, "left_anti")
            new = kept.unionByName(new) if new is not None else kept
        folders = dict(m["folders"])
        if touched and new is not None:
            into = f"{self.path}/data/{uuid.uuid4().hex}"
            new.withColumn("_bucket", self._bucket(n)).repartition("_bucket").write.partitionBy("_bucket").parquet(into)
            there = set(self.files.names(into))
            for b in touched:
                folders.pop(str(b), None)
                if f"_bucket={b}" in there:
                    folders[str(b)] = f"{into}/_bucket={b}"
        return self._committed(m, folders, schema)

    def _committed(self, before: dict, folders: dict, schema: dict | None) -> int:
        version = before["version"] + 1
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}.json"
        self.files.write_text(draft, json.dumps({"version": version, "params": self.params, "buckets": before["buckets"], "schema": schema, "folders": folders}))
        if not self.files.rename(draft, self._manifest(version)):
            self.files.remove(draft)
            raise Conflict(f"version {version} is there already")
        return version

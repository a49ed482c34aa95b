"""Tables written to the shared folder to cut lineage, and removed when they are done with."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from ..store import Files, new_folder, shared_folder  # noqa: F401

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, removed when the driver's Python ends."""
    path = new_folder(spark, name)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing that is still to run reads them."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def remove(spark: SparkSession, path: str) -> None:
    Files(spark, path).remove(path)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return

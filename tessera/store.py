"""The folder that driver and executors share, and new places in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, only a session in local mode (as in tests, where
    driver and executors are one process) gets a folder of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Hadoop's file system behind a path, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_folder(self, path: str) -> bool:
        return self._fs.getFileStatus(self._path(path)).isDirectory()

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def rename(self, old: str, new: str) -> bool:
        """Whether the move was made; never over something that is there."""
        if self.exists(new):
            return False
        self._fs.mkdirs(self._path(new).getParent())
        return self._fs.rename(self._path(old), self._path(new))

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        into = self._fs.open(self._path(path))
        try:
            return bytes(into.readAllBytes()).decode()
        finally:
            into.close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

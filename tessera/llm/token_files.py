"""Token ids as flat unsigned integer files with 64-bit document offsets.

A range of document ids makes one file of ids (16 bits wide where the vocabulary
allows, else 32), one of offsets (n + 1 64-bit integers from 0) and one of document
ids, all little-endian, readable by memory map. A manifest gives each file's base:
the tokens and documents before it, from prefix sums over the files' totals (a row on the
driver for each FILE_BYTES of text). Documents are in ascending order of id, repeated ids in
order of a hash of their text, then of their token bytes, documents without an id last. Null texts are empty: they
hold the end id alone. An empty table makes no files. A task writes under a name of its own
and renames, so a task that runs again leaves whole files only.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import doc_ids, id_column
from .exchange import release
from .ranges import id_ranges
from .tokenizer import word_tokenizer
from .units import portions

FILE_BYTES, LEAST_FILE, READ_DOCS = 64 << 20, 1 << 20, 10_000


def encoded(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """bucket, doc_id, text_hash and ids as bytes of the given width, each document's end id with it."""
    kind = np.dtype(f"<u{width}")
    end = np.array([end_id], kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for b in (p for whole in batches for p in portions(whole, "text")):
            codes = tokenizer.encode(b.column("text"))
            flat, at = codes.ids.astype(kind).tobytes(), codes.offsets * width
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("doc_id"), b.column("text_hash"), pa.array([flat[s:e] + end for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["bucket", "doc_id", "text_hash", "ids"])
            release()

    return docs.mapInArrow(encode, "bucket int, doc_id long, text_hash long, ids binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the files and returns the manifest: file, n_docs, n_tokens, doc_base, token_base and width of each."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, text_hash = id_ranges(texts, "doc_id", max(1, -(-size // FILE_BYTES), min(tasks, size // LEAST_FILE))), F.xxhash64(F.coalesce("text", F.lit("")))
    width = 2 if max(word_tokenizer(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[int, int, int]] = []
        bucket, out, temp, lengths, ids = -1, None, "", [], []

        def close() -> None:
            out.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
            for suffix, values in (("off", offsets), ("ids", np.concatenate(ids).astype("<i8"))):
                with store.open_output_stream(f"{temp}.{suffix}") as f:
                    f.write(values.tobytes())
            for suffix in ("bin", "off", "ids"):
                store.move(f"{temp}.{suffix}", f"{root}/{bucket:06d}.{suffix}")
            done.append((bucket, len(offsets) - 1, int(offsets[-1])))

        for b in batches:
            own = b.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if own[s] != bucket:
                    if out is not None:
                        close()
                    bucket, lengths, ids = int(own[s]), [], []
                    temp = f"{root}/.{bucket:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{temp}.bin")
                part = b.slice(s, e - s)
                blobs = part.column("ids").to_pylist()
                out.write(b"".join(blobs))
                lengths.append(np.fromiter(map(len, blobs), np.int64, len(blobs)) // width)
                ids.append(doc_ids(part.column("doc_id")))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["bucket", "n_docs", "n_tokens"])

    rows = encoded(texts.select(ranges.of(F.col("doc_id"), text_hash).alias("bucket"), "doc_id", text_hash.alias("text_hash"), "text"), tokenizer, end_id, width)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "text_hash", "ids")
    files = sorted(ordered.mapInArrow(write, "bucket long, n_docs long, n_tokens long").collect())
    manifest, docs_before, tokens_before = [], 0, 0
    for bucket, n_docs, n_tokens in files:
        manifest.append({"file": f"{bucket:06d}", "n_docs": n_docs, "n_tokens": n_tokens, "doc_base": docs_before, "token_base": tokens_before, "width": width})
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Mapped:
    """A file's integers by slices: a memory map where the store is a file system of this machine, else reads of the bytes asked for."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str) -> None:
        self.kind, self.size = np.dtype(kind), store.get_file_info(path).size // np.dtype(kind).itemsize
        local = isinstance(store, fs.LocalFileSystem)
        self.map = np.memmap(path, kind, "r") if local and self.size else None
        self.file = None if local else store.open_input_file(path)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> np.ndarray:
        a, b, _ = at.indices(self.size)
        if self.file is None:
            return np.zeros(0, self.kind) if self.map is None else self.map[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for x in b.to_pylist():
                ids, offsets, docs = (Mapped(store, f"{root}/{x['file']}.{suffix}", kind) for suffix, kind in (("bin", f"<u{x['width']}"), ("off", "<i8"), ("ids", "<i8")))
                for a in range(0, len(docs), READ_DOCS):
                    at = offsets[a : a + READ_DOCS + 1]
                    own = ids[int(at[0]) : int(at[-1])]
                    crc = [zlib.crc32(own[s:e].astype("<u4").tobytes()) for s, e in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([id_column(np.array(docs[a : a + READ_DOCS], np.int64)), pa.array(at[:-1] + x["token_base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["file"], m["token_base"], m["width"]) for m in manifest], "file string, token_base long, width int")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token files: independent zstandard frames with a trailing seek table (operator 1).

A file is::

    zstd frame*                 ids of one document (long ones over several frames), little-endian
                                unsigned 32-bit, each frame independent and with its own checksum
    skippable frame 0x184D2A5D  documents: int64 doc_id, uint8 null flag, uint32 frames, uint64 ids, each
    skippable frame 0x184D2A5E  seek table: uint32 packed size, uint32 size, uint32 checksum (low half of
                                XXH64 of the ids' bytes) per frame, then footer: uint32 frames,
                                uint8 flags (0x80), uint32 magic 0x8F92EAB1

Any zstandard decoder reads the whole file; a reader that knows the tables fetches the footer, the
tables and then only the frames of the documents it wants.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlab.llm.common import prepare, work_dir
from mixlab.llm.encoding import default_tokenizer, encoder

SKIP_DOCS, SKIP_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frames", "<u4"), ("ids", "<u8")])
#: Ids in one frame at most; a longer document takes several frames.
FRAME_IDS = 1 << 20

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class CorruptFrame(ValueError):
    """A frame's bytes do not match its checksum."""


def write_file(out, docs: Iterable[tuple[int | None, bytes]], level: int = 3, frame_ids: int = FRAME_IDS) -> tuple[int, int]:
    """Write (doc_id, ids as bytes) in the given order; number of documents and of ids."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    frames, index, total = bytearray(), bytearray(), 0
    for doc_id, ids in docs:
        n = 0
        for at in range(0, max(len(ids), 1), 4 * frame_ids):
            part = ids[at : at + 4 * frame_ids]
            packed = packer.compress(part)
            out.write(packed)
            frames += struct.pack("<III", len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            n += 1
        index += struct.pack("<qBIQ", doc_id or 0, doc_id is None, n, len(ids) // 4)
        total += len(ids) // 4
    out.write(struct.pack("<II", SKIP_DOCS, len(index)) + index)
    footer = struct.pack("<IBI", len(frames) // ENTRY.itemsize, 0x80, SEEK_MAGIC)
    out.write(struct.pack("<II", SKIP_SEEK, len(frames) + len(footer)) + frames + footer)
    return len(index) // DOC.itemsize, total


@dataclass
class TokenFile:
    """An open token file; ``docs`` and ``frames`` are its tables."""

    file: object
    docs: np.ndarray
    frames: np.ndarray
    at: np.ndarray  # where each frame begins
    first: np.ndarray  # first frame of each document

    @staticmethod
    def open(file) -> TokenFile:
        file.seek(0, io.SEEK_END)
        size = file.tell()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise CorruptFrame("no seek table")
        end = size - 9 - n * ENTRY.itemsize
        file.seek(end)
        frames = np.frombuffer(file.read(n * ENTRY.itemsize), ENTRY)
        at = np.concatenate([[0], np.cumsum(frames["packed"].astype(np.int64))])
        file.seek(int(at[-1]))
        kind, length = struct.unpack("<II", file.read(8))
        if kind != SKIP_DOCS or int(at[-1]) + 16 + length != end:
            raise CorruptFrame("the tables do not fit the file")
        docs = np.frombuffer(file.read(length), DOC)
        first = np.concatenate([[0], np.cumsum(docs["frames"].astype(np.int64))])
        return TokenFile(file, docs, frames, at, first)

    def ids(self, k: int) -> bytes:
        """Ids of the document at place k: only its frames are read and decompressed."""
        parts = []
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            self.file.seek(int(self.at[f]))
            try:
                part = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames["packed"][f])))
            except zstandard.ZstdError as e:
                raise CorruptFrame(f"frame {f}: {e}") from e
            if len(part) != self.frames["size"][f] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames["check"][f]:
                raise CorruptFrame(f"frame {f}: checksum")
            parts.append(part)
        return b"".join(parts)

    def doc_id(self, k: int) -> int | None:
        return None if self.docs["null"][k] else int(self.docs["doc_id"][k])


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, write token files in ascending id order; returns the manifest.

    One file per range of ids. ``folder`` is a URI that all executors reach. A task writes a file
    of a name of its own, and only files named in the manifest, which Spark commits, count: a
    task that runs twice leaves an unread file and no wrong row. Null texts are empty documents,
    null ids come first, repeated ids stay as repeated documents, ordered by text. An empty table
    gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(path), TaskContext.get().partitionId()

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, x in zip(ids, enc.encode(texts)):
                    yield doc_id, x + tail

        docs = encoded()
        first = next(docs, None)
        if first is None:
            return
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        with store.open_output_stream(f"{base}/{name}") as out:
            n_docs, n_tokens = write_file(out, _chain(first, docs))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder.rstrip('/')}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum is taken over the manifest, a row per file; documents are only summed
    within their file.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "start")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                with store.open_input_file(path) as f:
                    tokens, start, out = TokenFile.open(f), row["start"], []
                    for k in range(len(tokens.docs)):
                        ids = tokens.ids(k)
                        out.append((tokens.doc_id(k), start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                    doc_id, at, n, crc = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, at, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest_path: str, spark: SparkSession, doc_ids: list[int]) -> DataFrame:
    """Ids of the requested documents only: no other frame is decompressed."""
    wanted = frozenset(doc_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                with store.open_input_file(path) as f:
                    tokens = TokenFile.open(f)
                    hits = [k for k in range(len(tokens.docs)) if tokens.doc_id(k) in wanted]
                    for k in hits:
                        ids = np.frombuffer(tokens.ids(k), "<u4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([tokens.doc_id(k)], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    prepare(spark)
    return spark.read.schema(MANIFEST).parquet(manifest_path).select("path").mapInArrow(rows, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the files below the shared folder and read every document back."""
    return read_tokens(write_tokens(docs, work_dir(docs.sparkSession, "tokens"), **options))

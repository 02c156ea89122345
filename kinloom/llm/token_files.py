"""Token-ID files: independent zstandard frames, one a document, with a trailing seek table.

A file holds, in ascending doc_id order, one zstandard frame a document (its
ids as little-endian unsigned 32-bit integers), then a skippable frame with
the number of null doc_ids, which come first, and all doc_ids, then the seek table of the public "zstd seekable" format: each
frame's sizes and the low 32 bits of XXH64 of its content. A reader fetches
the table from the end of the file and decompresses only the frames it wants.
A file ends at `most` compressed bytes or documents, so what a writer holds of
it is bounded; one document is never split.

Defined results: a null or empty text has the end id alone. Repeated rows keep
one frame each, ordered by doc_id, then text; null doc_ids come first. An empty table gives no file. Extra columns are
ignored. Tasks write under a name of their own attempt and rename at the end,
so a retried or doubled task leaves whole files only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh_path
from .tokens import encoder

#: Fixed values of the seekable format and of skippable frames.
SEEK_FRAME, SEEK_FOOTER, IDS_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: A file ends when it has so many compressed bytes or documents.
FILE_BYTES, FILE_DOCS = 1 << 30, 4_000_000


class FrameWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.nulls, self.size = out, 0, 0
        self.ids, self.entries = array("q"), array("I")
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.compress(content)
        self.out.write(frame)
        self.nulls += doc_id is None
        self.ids.append(doc_id or 0)
        self.entries.extend((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.size += len(frame)

    def close(self) -> None:
        ids = np.array([self.nulls, *self.ids], "<i8").tobytes()
        self.out.write(struct.pack("<II", IDS_FRAME, len(ids)) + ids)
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.ids), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + len(foot)) + table + foot)
        self.out.close()


class FrameReader:
    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("not a token file")
        source.seek(size - 9 - 12 * n - 8 - 8 * (n + 1))
        ids, _, table = source.read(8 * (n + 1)), source.read(8), source.read(12 * n)
        ids = np.frombuffer(ids, "<i8")
        self.nulls, self.ids = int(ids[0]), ids[1:]
        self.entries = np.frombuffer(table, "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0], dtype=np.int64)))
        self.expand = zstandard.ZstdDecompressor().decompress

    def read(self, k: int) -> bytes:
        self.source.seek(int(self.offsets[k]))
        size, whole, check = (int(x) for x in self.entries[k])
        content = self.expand(self.source.read(size), max_output_size=max(1, whole))
        if len(content) != whole or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents with that id; no other frame is read."""
        a, b = 0, self.nulls
        if doc_id is not None:
            a, b = (self.nulls + np.searchsorted(self.ids[self.nulls :], doc_id, side) for side in ("left", "right"))
        return [np.frombuffer(self.read(k), "<u4") for k in range(a, b)]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, most: tuple[int, int] = (FILE_BYTES, FILE_DOCS)) -> DataFrame:
    """Writes the files; one row a file: path, first doc_id, part (its place among files of its task), documents, tokens.

    Runs at the first action.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        store, at = open_store(folder)
        writer, name, first, part = None, "", None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            store.move(f"{at}/{name}.partial", f"{at}/{name}.tok.zst")
            tokens = sum(writer.entries[1::3]) // 4
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.tok.zst"], "first_id": pa.array([first], pa.int64()), "part": pa.array([part], pa.int32()), "documents": pa.array([len(writer.ids)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is not None and (writer.size >= most[0] or len(writer.ids) >= most[1]):
                    yield closed()
                    writer, part = None, part + 1
                if writer is None:
                    store.create_dir(at, recursive=True)
                    name, first = uuid.uuid4().hex, doc_id
                    writer = FrameWriter(store.open_output_stream(f"{at}/{name}.partial", compression=None))
                writer.add(doc_id, encode.ids(text.as_py() or "") + end)
        if writer is not None:
            yield closed()

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "path string, first_id long, part int, documents long, tokens long")


def read_files(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32; `files` has path and base (tokens before)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_store(path)
                with store.open_input_file(at) as source:
                    reader = FrameReader(source)
                    lengths = reader.entries[:, 1].astype(np.int64) // 4
                    starts = base + np.cumsum(lengths) - lengths
                    for a in range(0, len(lengths), 5000):
                        b = min(a + 5000, len(lengths))
                        ids = [x if k >= reader.nulls else None for k, x in enumerate(reader.ids[a:b].tolist(), a)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts[a:b]), "n_tokens": pa.array(lengths[a:b]), "ids_crc32": pa.array([zlib.crc32(reader.read(k)) for k in range(a, b)], pa.int64())})

    return files.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, most: tuple[int, int] = (FILE_BYTES, FILE_DOCS)) -> DataFrame:
    """Encodes and writes all documents, then reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    # The manifest is written, so that the files are written once; it has one row a file.
    manifest_path = fresh_path(spark, "manifest")
    write_files(docs, folder, tokenizer, end_id, most).write.parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path)
    before = Window.orderBy("first_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return read_files(files.repartition(max(1, manifest.count()), "path"))

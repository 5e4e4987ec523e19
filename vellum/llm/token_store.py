"""Token ids in fixed-width bit-packed files with block offsets and random access.

File: magic, packed blocks one after the other, a footer and its position.
A block holds BLOCK ids in the minimum bits of the vocabulary; the footer has
the offsets of the blocks and the documents' ids and running token counts. The
files are listed in a manifest table, which alone says which files count: a
task that is run again, or twice, leaves a file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, shuffle_partitions
from vellum.llm.tokens import END_ID, encoder, in_chunks
from vellum.session import scratch_path

MAGIC = b"VLTOK1\0\0"
BLOCK = 1 << 16  # ids in a block
FILE_BYTES = 256 << 20  # bytes of text that go to one file on average
NO_ID = -(1 << 63)  # stands for a null document id in the files


def id_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """`n` ids from position `start` of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low = start * bits // 8
    planes = np.unpackbits(np.frombuffer(raw, np.uint8)[low:-(-(start + n) * bits // 8)], bitorder="little")
    planes = planes[start * bits - low * 8:][:n * bits].reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for i in range(bits):
        out |= planes[:, i].astype(np.uint32) << np.uint32(i)
    return out


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path (shared storage: file, hdfs, s3, ...)."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


class Writer:
    """One file; memory holds a block and the index."""

    def __init__(self, path: str, bits: int):
        fs, at = _open(path)
        self.out, self.bits = fs.open_output_stream(at), bits
        self.out.write(MAGIC)
        self.pos, self.waiting, self.have = len(MAGIC), [], 0
        self.blocks, self.docs, self.ends, self.total = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        while len(ids):
            some = ids[:BLOCK - self.have]
            self.waiting.append(some)
            self.have += len(some)
            ids = ids[len(some):]
            if self.have == BLOCK:
                self._flush()

    def _flush(self) -> None:
        raw = pack(np.concatenate(self.waiting), self.bits)
        self.out.write(raw)
        self.blocks.append(self.pos)
        self.pos += len(raw)
        self.waiting, self.have = [], 0

    def close(self) -> None:
        if self.have:
            self._flush()
        footer = struct.pack("<IIQQ", self.bits, BLOCK, len(self.docs), self.total)
        footer += np.array([*self.blocks, self.pos], "<i8").tobytes()
        footer += np.array(self.docs, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes()
        self.out.write(footer + struct.pack("<Q", self.pos))
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        (foot,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        raw = self.file.read_at(size - 8 - foot, foot)
        self.bits, self.block, n, self.total = struct.unpack_from("<IIQQ", raw)
        b = -(-self.total // self.block) + 1
        at = struct.calcsize("<IIQQ")
        self.blocks = np.frombuffer(raw, "<i8", b, at)
        self.docs = np.frombuffer(raw, "<i8", n, at + 8 * b)
        self.ends = np.frombuffer(raw, "<i8", n, at + 8 * (b + n))
        self._last: tuple[int, bytes] = (-1, b"")

    def close(self) -> None:
        self.file.close()

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, i: int) -> int | None:
        return None if self.docs[i] == NO_ID else int(self.docs[i])

    def span(self, i: int) -> tuple[int, int]:
        return int(self.ends[i - 1]) if i else 0, int(self.ends[i])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop of the file: the blocks that hold them are read, nothing else."""
        parts = []
        while start < stop:
            k = start // self.block
            if self._last[0] != k:
                self._last = k, self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k]))
            n = min(stop, (k + 1) * self.block) - start
            parts.append(unpack(self._last[1], self.bits, n, start - k * self.block))
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append END_ID, write files in ascending id order; returns the stored manifest.

    The documents are range-partitioned by id, one file a task, so files and
    rows in them ascend (nulls first, equal ids by a hash of the text across
    files and by text inside one). There are as many files as shuffle
    partitions, more where a file would hold over FILE_BYTES of text. A null text is empty
    and has the end id alone. Manifest: file, part, n_docs, n_ids, start (ids
    in all files before). Texts and ids stream through a task; an empty table
    gives a manifest without rows. Other columns are not read. `path` must be
    a folder that all executors share.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-int(size) // FILE_BYTES))
    spread = F.xxhash64("text")  # null and repeated ids are many files' too; equal ids lie in order of their texts inside a file
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .repartitionByRange(n, F.col("id"), spread).sortWithinPartitions("id", "text")
               .withColumn("part", F.spark_partition_id()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        out = name = part = None
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for a, b in in_chunks(texts):
                for doc, raw in zip(ids[a:b], enc.encode(texts[a:b])):
                    if out is None:
                        part = batch.column("part")[0].as_py()
                        name = f"{path}/tokens-{part:06d}-{uuid.uuid4().hex[:8]}.bin"
                        out = Writer(name, id_bits(enc.vocab_size))
                    out.add(doc, np.append(np.frombuffer(raw, enc.dtype), np.array([END_ID], enc.dtype)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [len(out.docs)], "n_ids": [out.total]},
                                             pa.schema([("file", "string"), ("part", "int32"), ("n_docs", "int64"), ("n_ids", "int64")]))

    spark = docs.sparkSession
    _make_folder(spark, path)
    files = cut(ordered.mapInArrow(write, "file string, part int, n_docs long, n_ids long"), "token-files")  # a row a file
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _make_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files alone.

    `ids` is binary, little-endian unsigned 32-bit; `start` counts the ids of
    all documents before it.
    """
    n = max(1, manifest.count())
    schema = pa.schema([("doc_id", "int64"), ("start", "int64"), ("n_tokens", "int64"), ("ids_crc32", "int64"), ("ids", "binary")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, rows, held = Reader(row["file"]), [], 0
                for i in range(len(file)):
                    a, b = file.span(i)
                    raw = file.ids(a, b).astype("<u4").tobytes()
                    rows.append((file.doc_id(i), row["start"] + a, b - a, zlib.crc32(raw), raw))
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                file.close()

    return manifest.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The documents' (doc_id, start, n_tokens, ids_crc32) as read back from newly written files."""
    path = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer)).drop("ids")

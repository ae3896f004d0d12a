"""Token ids of documents in files of Huffman-coded blocks, in ascending order of doc_id, and back.

A file is a run of blocks; Spark writes it as bytes to any file system that it knows and reads it as a binary file. A block stands alone:

    4 bytes  mark "TLID"
    8 x 8    little-endian: part, place of the block in its part, ids before it in its part, documents, ids, bytes of the three sections below
    sections documents (zlib: doc_ids, whether each is null, number of ids of each), checkpoints (zlib: bits between them, 32 bits each), bits
    4 bytes  crc32 of all before it
    1 byte   line feed, the end of a record

Parts are ranges of doc_id in ascending order. Beside the files (ids/) lie the code lengths (codes/) and each part's first id (parts/), as Parquet.
Codes come from the counts of all ids. A block has whole documents of BLOCK ids together, or a single longer one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .common import delete_at_exit, drop, map_blocks, partitions, shared_dir, small_batches, stage
from .tokens import encoder

#: Ids of a block; blocks of a file; ids of a part, about, where there are more than one part for each shuffle partition.
BLOCK, FILE_BLOCKS, PART = 1 << 18, 64, 1 << 26
MARK, HEAD = b"TLID", struct.Struct("<4s8Q")


def tokenised(docs: DataFrame, name: str, end: int) -> DataFrame:
    """Staged doc_id, n, ids (little-endian, 16 bits each where the vocabulary allows it, else 32) of each row of docs(doc_id, text)."""
    kind = _kind(name)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text").fill_null("").to_pylist()
        ids, first = encoder(name).encode_many(texts, end)
        data, size = ids.astype(kind).tobytes(), kind.itemsize
        return pa.record_batch({"doc_id": block.column("doc_id"), "n": pa.array(np.diff(first), pa.int64()), "ids": pa.array([data[a * size : b * size] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(map_blocks(slim, run, "doc_id long, n long, ids binary"))


def _kind(name: str) -> np.dtype:
    return np.dtype("<u2" if encoder(name).whole.get_vocab_size() <= 1 << 16 else "<u4")


def counts(tokens: DataFrame, kind: np.dtype, many: int) -> np.ndarray:
    """How often each id below many occurs in all rows; as many numbers reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(many, np.int64)
        for batch in batches:
            data, _ = _bytes(batch.column("ids"))
            found += np.bincount(data.view(kind), minlength=many)
        ids = np.nonzero(found)[0]
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(found[ids], pa.int64())})

    out = np.zeros(many, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def block_bytes(coder: huffman.Coder, part: int, place: int, first: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One block's record, without the line feed."""
    bits, gaps = coder.encode(ids)
    documents = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + sizes.astype("<u8").tobytes()
    sections = [zlib.compress(documents, 1), zlib.compress(gaps.astype("<u4").tobytes(), 1), bits]
    out = HEAD.pack(MARK, part, place, first, len(doc_ids), len(ids), *map(len, sections)) + b"".join(sections)
    return out + struct.pack("<I", zlib.crc32(out))


def heads(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """part, first id, documents, ids and where it begins of each block of a file."""
    at = 0
    while at < len(data):
        mark, part, _, first, documents, ids, *sizes = HEAD.unpack_from(data, at)
        if mark != MARK:
            raise ValueError(f"no block at byte {at}")
        yield part, first, documents, ids, at
        at += HEAD.size + sum(sizes) + 5


def read_block(coder: huffman.Coder, data: bytes, at: int) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and ids of the block at a byte of a file; ValueError where it isn't what was written."""
    _, _, _, _, documents, n, *sizes = HEAD.unpack_from(data, at)
    end = at + HEAD.size + sum(sizes)
    if end + 4 > len(data) or struct.unpack_from("<I", data, end)[0] != zlib.crc32(memoryview(data)[at:end]):
        raise ValueError(f"the block at byte {at} is damaged")
    places = np.cumsum([at + HEAD.size, *sizes]).tolist()
    raw, gaps = (zlib.decompress(memoryview(data)[a:b]) for a, b in zip(places[:2], places[1:3], strict=True))
    doc_ids, null, many = np.frombuffer(raw, "<i8", documents), np.frombuffer(raw, np.uint8, documents, 8 * documents), np.frombuffer(raw, "<u8", documents, 9 * documents)
    ids = coder.decode(data[places[2] : places[3]], np.frombuffer(gaps, "<u4"), n)
    return [None if x else d for d, x in zip(doc_ids.tolist(), null, strict=True)], many.astype(np.int64), ids


def write(docs: DataFrame, name: str, end: int, path: str) -> None:
    """Writes the ids of all rows of docs(doc_id, text), each row's followed by end, to a new folder.

    Null texts are empty. Rows come in ascending order of doc_id, null ids first; rows of equal ids in that of a hash of their ids, each as a document of its own.
    Further columns are ignored. An empty table gives no blocks.
    """
    spark, kind = docs.sparkSession, _kind(name)
    tokens = tokenised(docs, name, end)
    count = counts(tokens, kind, max(encoder(name).whole.get_vocab_size(), end + 1))
    used = int((count > 0).sum())
    length = huffman.lengths(count, max(huffman.LIMIT, (used - 1).bit_length()))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(length) if n], "id int, bits int").write.parquet(f"{path}/codes")
    parts = max(partitions(spark), -(-int(count.sum()) // PART))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = huffman.Coder(length), TaskContext.get().partitionId()
        place, first, doc_ids, sizes, held, many = 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held).view(kind).astype(np.int64)
            return pa.record_batch({"block": pa.array([block_bytes(coder, part, place, first, doc_ids, np.array(sizes), ids)], pa.binary())})

        for batch in batches:
            data, offsets = _bytes(batch.column("ids"))
            for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if held and many + n > BLOCK:
                    yield block()
                    place, first, doc_ids, sizes, held, many = place + 1, first + many, [], [], [], 0
                doc_ids.append(doc_id)
                sizes.append(n)
                held.append(data[offsets[i] : offsets[i + 1]].copy())
                many += n
        if held:
            yield block()

    small_batches(spark)
    ranged = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "ids")
    coded = ranged.select("doc_id", "n", "ids").mapInArrow(run, "block binary")
    coded.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")
    drop(tokens)

    def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for content in batch.column("content") for x in heads(content.as_py())]
            yield pa.record_batch({"part": pa.array([x[0] for x in found], pa.int64()), "n": pa.array([x[3] for x in found], pa.int64())})

    sizes = spark.read.format("binaryFile").load(f"{path}/ids").select("content").mapInArrow(firsts, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    before, rows = 0, []
    for r in sorted(sizes):
        rows.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(rows, "part long, first long").write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian, 32 bits each) of each document of a folder that write() made."""
    bits = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codes").collect()}
    length = np.zeros(max(bits, default=0) + 1, np.uint8)
    for i, n in bits.items():
        length[i] = n
    first_of = {r["part"]: r["first"] for r in spark.read.parquet(f"{path}/parts").collect()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = huffman.Coder(length)
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                for part, first, _, _, at in heads(data):
                    doc_ids, many, ids = read_block(coder, data, at)
                    offsets = np.concatenate([[0], np.cumsum(many)])
                    raw = pa.py_buffer(ids.astype("<u4").tobytes())
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer((4 * offsets).astype(np.int64).tobytes()), raw])
                    yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(first_of[part] + first + offsets[:-1], pa.int64()), "ids": column.cast(pa.binary())})

    small_batches(spark)
    return spark.read.format("binaryFile").load(f"{path}/ids").select("content").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, name: str, end: int) -> DataFrame:
    """What read() gives of files that write() made of docs in the shared folder; they go at exit."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, name, end, path)
    delete_at_exit(spark, path)
    return read(spark, path)

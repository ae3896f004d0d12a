"""Blocks of documents, staged so that rows about a block meet it without moving its texts.

A block is one row with some consecutive documents: a key for each row, their ids and their texts as one compressed value. The table is bucketed by
block, so a cogroup by block shuffles only the other side. What a block asks goes to shards as one row for each block and
shard, with compressed arrays; so a value that all documents have is sent once for each block, not once for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks as sliced
from .common import partitions, shared_dir, small_batches, text_bytes

#: Bytes of text of a block, about; a longer document is a block of its own.
BYTES = 8 << 20
SCHEMA = "block long, rows array<long>, ids array<long>, offsets binary, data binary"


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Writes df to the shared folder, bucketed by key, and reads it as a table; forget() deletes it."""
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(partitions(spark), key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    out._staged_name = name
    return out


def forget(df: DataFrame) -> None:
    spark, name = df.sparkSession, df._staged_name
    spark.sql(f"drop table if exists {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def of_texts(docs: DataFrame, limit: int = BYTES, row: str | None = None) -> DataFrame:
    """The blocks of docs(doc_id, text); null texts are empty. row names a column with a number for each row; without it rows are numbered here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))]).astype(np.int64)
            data = np.concatenate([d for d, _ in parts])
            return pa.record_batch({"block": pa.array([number], pa.int64()), "rows": pa.array([rows], pa.list_(pa.int64())), "ids": pa.array([ids], pa.list_(pa.int64())), "offsets": pa.array([pack(offsets)], pa.binary()), "data": pa.array([pack(data)], pa.binary())})

        for x in sliced(batches, limit=1 << 20):
            data, offsets = text_bytes(x.column("text"))
            if parts and held + len(data) > limit:
                yield block()
                number, rows, ids, parts, held = number + 1, [], [], [], 0
            rows += x.column("row").to_pylist()
            ids += x.column("doc_id").to_pylist()
            parts.append((data.copy(), offsets))
            held += len(data)
        if parts:
            yield block()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"))
    return bucketed(slim.mapInArrow(run, SCHEMA), "block")


def texts_of(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """ids, UTF-8 bytes and offsets of a block."""
    return row["ids"], unpack(row["data"], np.uint8), unpack(row["offsets"], np.int64)

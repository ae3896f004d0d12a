"""Helpers that several operators share: the shared folder, staged tables, splitting Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer document is a block of its own.
BLOCK_BYTES = 3 << 20

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir where that is set. A local session without it gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that its lineage ends there. Goes at exit or by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    for entry in [x for x in _staged if x[1] == path]:
        _staged.remove(entry)
        delete(*entry)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    _staged.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _staged:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone; its folder then goes with it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches between the JVM and Python, unless the session sets them: texts and sets are kilobytes a row."""
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Applies fn to blocks of rows within tasks."""

    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, limit):
            out = fn(block)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Keys that lookup() may broadcast.
FREQUENT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, columns: list[str], spread: Column | None = None) -> DataFrame:
    """rows with columns of table(key, many, columns), for rows whose key it has; many: how many rows have the key.

    A key that FREQUENT-th of the rows have, of which there are at most FREQUENT, is looked up in a broadcast table, so that its rows aren't dealt
    to one task. spread: a key for those rows in the other join, by default a hash of the row.
    """
    total = table.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    names, hot_key = {c: f"hot_{c}" for c in columns}, f"hot_{key}"
    hot = table.where(F.col("many") * FREQUENT > total).select(F.col(key).alias(hot_key), *[F.col(c).alias(h) for c, h in names.items()])
    cold = table.where(F.col("many") * FREQUENT <= total).select(F.col(key).alias("cold_key"), *columns)
    dealt = F.when(F.col(hot_key).isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns) if spread is None else spread)
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left").withColumn("dealt", dealt)
    joined = joined.join(cold, F.col("dealt") == F.col("cold_key"), "left").where(F.col(hot_key).isNotNull() | F.col("cold_key").isNotNull())
    return joined.select(*rows.columns, *[F.when(F.col(hot_key).isNotNull(), F.col(h)).otherwise(F.col(c)).alias(c) for c, h in names.items()])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that links lead to) of each id of nodes(id), by edges(a, b).

    Alternating large-star and small-star steps over staged edges, until each id has one edge and that to the least id it
    reaches; the number of steps grows with the logarithm of the longest path. Work follows the number of edges; nothing is gathered
    on the driver.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        after = stage(small.select("e.a", "e.b").where("a <> b").distinct())
        drop(edges)
        edges = after
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)").isEmpty()

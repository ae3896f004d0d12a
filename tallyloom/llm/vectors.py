"""Vectors of Arrow batches as integer matrices, shared by the operators that compute with whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components of a list column, one after the other, with what a row needs to be used.

    Returns values (flat), where each row's begin (n + 1 places), whole (the row is not null and all its components are finite), and most (the
    largest absolute value of a row's scaled components, as a double). Components of rows that aren't whole are 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    of_row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(of_row[~np.isfinite(x)], minlength=len(sizes)) > 0
    whole = ~bad & column.is_valid().to_numpy(zero_copy_only=False)
    x = np.where(whole[of_row], x, 0.0)
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    most, filled = np.zeros(len(sizes)), sizes > 0
    if len(x):
        most[filled] = np.maximum.reduceat(np.abs(x), first[:-1][filled])
    return np.where(np.abs(x) < 2.0**62, x, 0.0).astype(np.int64), first, whole, most


def matrix(values: np.ndarray, first: np.ndarray, pick: np.ndarray, width: int) -> np.ndarray:
    """The rows of pick, all of width components, as a matrix."""
    return values[first[:-1][pick][:, None] + np.arange(width)]


#: Rows of sums(): for each cell and place of a component how many vectors a task had there and their total.
SUMS = "cell long, place long, many long, total long"


def sums(many: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """A task's counts (by cell) and totals (cells x components) as rows of SUMS; empty cells have none."""
    cell, size = np.nonzero(many)[0], totals.shape[1]
    return pa.record_batch({"cell": pa.array(np.repeat(cell, size), pa.int64()), "place": pa.array(np.tile(np.arange(size), len(cell)), pa.int64()), "many": pa.array(np.repeat(many[cell], size), pa.int64()), "total": pa.array(totals[cell].ravel(), pa.int64())})


def floor_means(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    """before (cells x components) with each cell that rows of SUMS have replaced by the floor of its mean. Only one number for each component reaches the driver."""
    out = before.copy()
    for r in rows.groupBy("cell", "place").agg(F.sum("many").alias("many"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cell"], r["place"]] = int(r["total"]) // r["many"]
    return out

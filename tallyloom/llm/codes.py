"""Vector code compression: integer vectors cut into parts, each part coded as the nearest entry of its position's codebook.

Nearest entries are found with a vantage-point tree over the entries of a part position. A node holds an entry and, for each of its two halves,
the least and largest distance of the half's entries from it, rounded outwards; a half is visited unless the triangle
inequality shows that all its entries are farther than the best so far. Equal bounds are visited, since ties go to the lower index, and
each visited entry is compared by its exact integer distance. All parts of a batch walk the tree together, in numpy.

Codebooks are small (parts x entries x components), so a round is one pass over the vectors: a task sums its parts by entry and
Spark sums the tasks' rows; only those sums reach the driver, and the new codebooks go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, small_batches, stage
from .vectors import SUMS, floor_means, integers, matrix, sums

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components from here on could overflow a sum of squares, so their vectors get no code.
LIMIT = 2.0**26
#: Share by which a bound is rounded outwards: far more than the errors of a square root and a sum of doubles.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over the rows of entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries = np.asarray(entries, np.int64)
        #: for each node: its entry, and (child, least, largest distance) of its halves
        self.entry: list[int] = []
        self.halves: list[list[tuple[int, float, float]]] = []
        todo = [(np.arange(len(entries)), None)] if len(entries) else []
        while todo:
            items, above = todo.pop()
            spread = entries[items] - entries[items].mean(axis=0)
            at = int((spread * spread).sum(axis=1).argmax())
            node, rest = len(self.entry), np.delete(items, at)
            self.entry.append(int(items[at]))
            self.halves.append([])
            if above is not None:
                self.halves[above[0]].append((node, *above[1:]))
            d = self._squared(entries[rest], self.entry[node])
            rest, d = rest[np.argsort(d, kind="stable")], np.sort(d)
            middle = (len(rest) + 1) // 2
            for part, far in ((rest[middle:], d[middle:]), (rest[:middle], d[:middle])):
                if len(part):
                    todo.append((part, (node, np.sqrt(far[0]) * (1 - SLACK), np.sqrt(far[-1]) * (1 + SLACK))))

    def _squared(self, x: np.ndarray, entry: int) -> np.ndarray:
        away = x - self.entries[entry]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the index of the nearest entry (of equally near ones the lowest), its squared distance; and how many were compared."""
        n = len(x)
        best, index, compared = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries)), 0

        def see(node: int, q: np.ndarray) -> np.ndarray:
            nonlocal compared
            e = self.entry[node]
            d = self._squared(x[q], e)
            better = (d < best[q]) | ((d == best[q]) & (e < index[q]))
            best[q[better]], index[q[better]] = d[better], e
            compared += len(q)
            return np.sqrt(d)

        todo = [(0, np.arange(n))] if n and self.entry else []
        while todo:  # each row goes down to one leaf first, so that the walk below begins with a good bound
            node, q = todo.pop()
            t = see(node, q)
            if len(self.halves[node]) == 2:
                (a, _, high), (b, low, _) = sorted(self.halves[node], key=lambda h: h[1])
                near = t <= (high + low) / 2
                todo += [(c, s) for c, s in ((a, q[near]), (b, q[~near])) if len(s)]
            elif self.halves[node]:
                todo.append((self.halves[node][0][0], q))
        todo = [(0, np.arange(n), None, 0.0, 0.0)] if n and self.entry else []
        while todo:
            node, q, t, low, high = todo.pop()
            if t is not None:
                bound = np.sqrt(best[q].astype(np.float64)) * (1 + SLACK)
                q = q[(low - t * (1 + SLACK) <= bound) & (t * (1 - SLACK) - high <= bound)]
            if len(q):
                t = see(node, q)
                todo += [(child, q, t, lo, hi) for child, lo, hi in self.halves[node]]
        return index, best, compared


def _used(batch: pa.RecordBatch, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows: which are whole, which can be coded, and the matrix of those."""
    values, first, whole, most = integers(batch.column("embedding"), scale)
    fits = whole & (np.diff(first) == width) & (most < LIMIT) & (width > 0)
    return whole, fits, matrix(values, first, np.nonzero(fits)[0], width)


def _assign(trees: list[Tree], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes (rows x parts) and squared distances summed over parts."""
    size = m.shape[1] // max(1, len(trees))
    index, error = np.zeros((len(m), len(trees)), np.int64), np.zeros(len(m), np.int64)
    for p, tree in enumerate(trees):
        index[:, p], d, _ = tree.nearest(m[:, p * size : (p + 1) * size])
        error += d
    return index, error


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x components) of vectors(vec_id, embedding); see compress()."""
    small_batches(vectors.sparkSession)
    v = F.col("embedding")
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    rows = vectors.select("vec_id", "embedding").where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & whole)
    usual = rows.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not usual:
        return np.zeros((parts, 0, 0), np.int64)
    width = usual[0]["width"]
    start = rows.where(F.size(v) == width).select("vec_id", scaled.alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _improved(vectors, books, scale)
    return books


def _improved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, size = books.shape

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        many, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for batch in batches:
            _, _, m = _used(batch, parts * size, scale)
            index, _ = _assign(trees, m)
            for p in range(parts):
                cell = p * entries + index[:, p]
                many += np.bincount(cell, minlength=len(many))
                np.add.at(totals, cell, m[:, p * size : (p + 1) * size])
        yield sums(many, totals)

    found = vectors.select("embedding").mapInArrow(tally, SUMS)
    return floor_means(found, books.reshape(parts * entries, size)).reshape(books.shape)


def compress(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (index of each part's entry, two hex digits), error (squared distance summed over parts) of vectors(vec_id, embedding, label).

    Vectors that are null or have a null or non-finite component are dropped. Those that can't be cut like the codebooks' (of another
    length, which is the commonest one that parts divide) or whose scaled components reach LIMIT keep their row, with null code and error. Rows
    with equal or null ids are rows of their own; further columns are ignored.
    """
    small_batches(vectors.sparkSession)
    parts, entries, size = books.shape
    if entries > 256:
        raise ValueError("an index of two hex digits is below 256")

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            whole, fits, m = _used(batch, parts * size, scale)
            index, error = _assign(trees, m)
            digits, place = index.astype(np.uint8).tobytes().hex(), np.cumsum(fits) - 1
            out = [(digits[2 * parts * place[i] : 2 * parts * (place[i] + 1)], int(error[place[i]])) if fits[i] else (None, None) for i in np.nonzero(whole)[0]]
            kept = batch.filter(pa.array(whole))
            yield pa.record_batch({"vec_id": kept.column("vec_id"), "label": kept.column("label"), "code": pa.array([c for c, _ in out], pa.string()), "error": pa.array([e for _, e in out], pa.int64())})

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return slim.mapInArrow(code, "vec_id long, label string, code string, error long")


def decompress(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding (the middle of each component's cell of width 1 / scale) of codes(vec_id, code)."""

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if c is None else ((books[np.arange(len(books)), list(bytes.fromhex(c))].ravel() + 0.5) / scale).tolist() for c in batch.column("code").to_pylist()]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "embedding": pa.array(rows, pa.list_(pa.float64()))})

    return codes.select("vec_id", "code").mapInArrow(back, "vec_id long, embedding array<double>")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over rows of the same label (nulls together). Labels with many rows aren't dealt to one task."""
    coded = stage(coded.withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    totals = coded.groupBy("label_key").agg(F.sum(F.coalesce("error", F.lit(0)).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("many"))
    return lookup(coded, totals, "label_key", ["label_error"]).drop("label_key")

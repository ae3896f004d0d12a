"""Centroid clustering: Lloyd rounds over integer vectors with a cover tree over the vectors and one over the centroids.

Vectors are cut into blocks of about BLOCK rows. Each block's cover tree is built once and staged with its vectors; a tree over the centroids is built each
round. A task walks pairs of nodes of both trees: with d the distance between two nodes' centres and r, s their radii, no centroid below the one is
nearer to a vector below the other than d - r - s, and the centroid at the centre is no farther than d + r. A pair whose lower bound is above
the least upper bound is dropped. A node of vectors with one centroid left belongs to it whole, and its vectors' sum is counted at once; where
leaves meet, exact integer distances decide, ties to the smaller number. Bounds are rounded outwards, so no tie is lost.

Sums by centroid go through Spark; only the new centroids reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import small_batches, stage
from .vectors import SUMS, floor_means, integers, matrix, sums

CENTROIDS, ROUNDS, SCALE, WIDTH = 16, 3, 64, 64
#: Rows of a block; rows that a leaf may have; scaled components from here on could overflow a sum of squares.
BLOCK, LEAF, LIMIT = 1024, 8, 2.0**26
#: Share by which bounds are rounded outwards.
SLACK = 1e-9


@dataclass
class CoverTree:
    """A cover tree over points, whose rows are in the tree's order: a node has the rows from begin to end, the first of them its centre.

    A node's children have their centres more than half of its scale (a power of two) apart and their points within that. Children have
    consecutive numbers, children[i] to children_end[i]; a leaf has none.
    """

    points: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    children: np.ndarray
    children_end: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.children == self.children_end


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
    """The tree over the rows of x (at least one), and the order in which it has them."""
    exact = x.astype(np.float64)
    order, radius, begin, end, first, last = np.arange(len(x)), [], [], [], [], []
    waiting = [(0, len(x))]
    for a, b in waiting:  # grows as it goes
        items = order[a:b].copy()
        d = _distances(exact[items], exact[items[0]])
        radius.append(float(d.max()) * (1 + SLACK))
        begin.append(a)
        end.append(b)
        first.append(len(waiting))
        if b - a > leaf and d.max() > 0:
            within = 2.0 ** (math.ceil(math.log2(d.max())) - 1)
            at, rest = a, items
            near = d <= within
            while True:
                own = rest[near]
                order[at : at + len(own)] = own
                waiting.append((at, at + len(own)))
                at, rest = at + len(own), rest[~near]
                if not len(rest):
                    break
                near = _distances(exact[rest], exact[rest[0]]) <= within
                near[0] = True
        last.append(len(waiting))
    return CoverTree(x[order], np.array(radius), np.array(begin), np.array(end), np.array(first), np.array(last)), order


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = x - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    away = x - y
    return np.einsum("ij,ij->i", away, away)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first[i] to last[i], for each i after the other, and that i."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which], which


def assign(vectors: CoverTree, centroids: CoverTree, number: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """Which centroid is nearest to each vector. number: the number of each row of the centroids' tree; its leaves hold equal centroids.

    Returns whole nodes with one centroid as (nodes, rows of centroids), the rows of vectors that were compared one by one, the row of the centroid of each,
    and how many pairs of a vector and a centroid were compared.
    """
    best = np.full(len(vectors.radius), np.inf)
    # of equal centroids the one with the smallest number stands for its leaf
    stands = np.array([a + int(number[a:b].argmin()) for a, b in zip(centroids.begin, centroids.end, strict=True)])
    v_leaf, c_leaf = vectors.leaf, centroids.leaf
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    leaf_a, leaf_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        d = np.sqrt(_squared(vectors.points[vectors.begin[a]], centroids.points[centroids.begin[b]]).astype(np.float64))
        np.minimum.at(best, a, d * (1 + SLACK) + vectors.radius[a])
        keep = d * (1 - SLACK) - vectors.radius[a] - centroids.radius[b] <= best[a]
        a, b = a[keep], b[keep]
        finer = ~c_leaf[b] & (v_leaf[a] | (centroids.radius[b] >= vectors.radius[a]))
        waits = np.bincount(a[finer], minlength=len(best)) > 0  # nodes that meet finer centroids first
        one = (np.bincount(a, minlength=len(best)) == 1)[a] & c_leaf[b]
        whole.append((a[one], stands[b[one]]))
        met = ~one & ~waits[a] & v_leaf[a]
        leaf_a.append(a[met])
        leaf_b.append(b[met])
        stay, down = ~one & waits[a], ~one & ~waits[a] & ~v_leaf[a]
        finer_b, i = _ranges(centroids.children[b[stay & finer]], centroids.children_end[b[stay & finer]])
        finer_a, j = _ranges(vectors.children[a[down]], vectors.children_end[a[down]])
        best[finer_a] = np.minimum(best[finer_a], best[a[down]][j])
        a, b = np.concatenate([a[stay & ~finer], a[stay & finer][i], finer_a]), np.concatenate([b[stay & ~finer], finer_b, b[down][j]])
    la, lb = np.concatenate(leaf_a), np.concatenate(leaf_b)
    row, i = _ranges(vectors.begin[la], vectors.end[la])
    to = stands[lb[i]]
    d = _squared(vectors.points[row], centroids.points[to])
    order = np.lexsort((number[to], d, row))
    first = np.ones(len(order), bool)
    first[1:] = row[order[1:]] != row[order[:-1]]
    return whole, row[order[first]], to[order[first]], len(row)


def _tree(centroids: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    return build(centroids, leaf=1)


_KINDS = {"points": np.int64, "radius": np.float64, "begin": np.int64, "end": np.int64, "children": np.int64, "children_end": np.int64}
TREES = "ids array<long>, " + ", ".join(f"{k} binary" for k in _KINDS)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, CoverTree]]:
    for i in range(batch.num_rows):
        tree = CoverTree(**{k: unpack(batch.column(k)[i].as_py(), kind) for k, kind in _KINDS.items()})
        tree.points = tree.points.reshape(-1, width)
        yield batch.column("ids")[i].as_py(), tree


def prepare(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Staged blocks of vectors(vec_id, embedding), each with its cover tree. Vectors that are null, have another length than width, a null or
    non-finite component or one of LIMIT or more once scaled are left out."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, many = [], [], 0

        def block() -> pa.RecordBatch:
            tree, order = build(np.concatenate(held))
            return pa.record_batch({"ids": pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), **{k: pa.array([pack(np.asarray(getattr(tree, k), kind))], pa.binary()) for k, kind in _KINDS.items()}})

        for batch in batches:
            values, first, whole, most = integers(batch.column("embedding"), scale)
            pick = np.nonzero(whole & (np.diff(first) == width) & (most < LIMIT))[0]
            m, own = matrix(values, first, pick, width), batch.column("vec_id").to_pylist()
            for at in range(0, len(pick), BLOCK):
                held.append(m[at : at + BLOCK])
                ids += [own[i] for i in pick[at : at + BLOCK]]
                many += len(held[-1])
                if many >= BLOCK:
                    yield block()
                    held, ids, many = [], [], 0
        if many:
            yield block()

    return stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, TREES))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of 1:vec_id, in its order; of repeated ids the smaller vector first, null ids last."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    rows = vectors.where(v.isNotNull() & (F.size(v) == width) & whole)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    found = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), scaled.alias("v")).orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), width)


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    k, width = centroids.shape

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = _tree(centroids)
        many, totals = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, v in _trees(batch, width):
                whole, rows, to, _ = assign(v, tree, number)
                before = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(v.points, axis=0)])
                for nodes, c in whole:
                    many += np.bincount(number[c], v.end[nodes] - v.begin[nodes], minlength=k).astype(np.int64)
                    np.add.at(totals, number[c], before[v.end[nodes]] - before[v.begin[nodes]])
                many += np.bincount(number[to], minlength=k)
                np.add.at(totals, number[to], v.points[rows])
        yield sums(many, totals)

    return floor_means(blocks.mapInArrow(tally, SUMS), centroids)


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Staged vec_id, cluster, distance (squared, to the cluster's centroid) of vectors(vec_id, embedding), and the final centroids.

    Each round assigns all vectors and moves centroids to the floor of their vectors' mean, empty ones stay; then vectors are assigned once
    more. Vectors that prepare() leaves out have no row. Rows with equal or null ids are rows of their own; further columns are ignored.
    """
    k, width = centroids.shape
    schema = "vec_id long, cluster int, distance long"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema), centroids
    blocks = prepare(vectors, width, scale)
    for _ in range(rounds):
        centroids = _round(blocks, centroids)
    final = centroids

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = _tree(final)
        for batch in batches:
            for ids, v in _trees(batch, width):
                whole, rows, to, _ = assign(v, tree, number)
                own = np.zeros(len(ids), np.int64)
                for nodes, c in whole:
                    row, i = _ranges(v.begin[nodes], v.end[nodes])
                    own[row] = c[i]
                own[rows] = to
                yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(number[own], pa.int32()), "distance": pa.array(_squared(v.points, tree.points[own]), pa.int64())})

    return stage(blocks.mapInArrow(last, schema)), final


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256 (of the components, joined by commas)."""
    spark = assigned.sparkSession
    sums_of = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, sums_of[c], sum(sums_of.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums_of)]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster")  # as many rows as there are centroids

"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors are compared only within a label. Equal vectors are one class, so that a group of copies costs one row. Each class gets a sign
code in each of several tables; classes that share a code in a table are compared exactly, in double precision, in the
first table they meet in (so that each pair counts once). A bucket is cut into chunks and tasks get pairs of chunks, which
spreads a large bucket over many tasks; pairs themselves are never emitted: a task returns, for each vector, how many others it
links with and one spanning set of links. Components come from those links.

The code's length grows with the logarithm of the largest label's number of classes and the number of tables follows
from it, so that a pair at the threshold is missed with probability at most MISS at every size. Vectors that are null, empty, zero, have
null or non-finite components, or a null label link with nothing; so do vectors of different lengths. Each row is a vector of its own, whether its id
repeats, with an equal vector or another, or is null. A component is named by its smallest id, null if it has none; a row is kept if its id is
that one (a null id: if its component has none).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stage

THRESHOLD = 0.93
#: Classes that share a code by chance, about; bound of the chance to miss a pair at the threshold; rows of a chunk.
BUCKET, MISS, CHUNK = 512, 0.005, 1024
SEED = 20_240


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a code and number of tables for labels of at most largest classes."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest) / BUCKET)) if largest > BUCKET else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One row of codes for each row of x."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    sign = (x @ planes > 0).reshape(len(x), tables, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int64))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; each is first scaled by its largest component, which keeps tiny and huge ones exact."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _compare(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float) -> tuple[np.ndarray, ...]:
    """Links between the rows of a and b (b None: within a): sums for a and b, and the links of a spanning forest."""
    table = int(a["table"].iloc[0])
    other = a if b is None else b
    xa, xb = (unit(np.stack([np.asarray(v, np.float64) for v in t["v"]])) for t in (a, other))
    near = xa @ xb.T >= threshold
    ca, cb = np.stack(a["codes"].to_numpy()), np.stack(other["codes"].to_numpy())
    for t in range(table):  # those pairs have met before
        near &= ca[:, t][:, None] != cb[:, t][None, :]
    if b is None:
        np.fill_diagonal(near, False)
    wa, wb = a["n"].to_numpy(np.int64), other["n"].to_numpy(np.int64)
    i, j = np.nonzero(near)
    ids_a, ids_b = a["rep"].to_numpy(), other["rep"].to_numpy()
    # a spanning forest joins what all links join here
    keep: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(u: int) -> int:
        while (p := parent.setdefault(u, u)) != u:
            parent[u] = u = parent[p] if p in parent else p
        return u

    for p, q in zip(ids_a[i], ids_b[j], strict=True):
        if (r := root(p)) != (s := root(q)):
            parent[max(r, s)] = min(r, s)
            keep.append((p, q))
    return near @ wb, near.T @ wa, keep


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("digest", F.when(F.col("fine"), F.md5(F.concat_ws(",", "label", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))))
    classes = rows.where("fine").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = stage(classes.withColumn("rep", F.monotonically_increasing_id()))  # a class has a number of its own, as its smallest id may be another's, too
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold)

    def coded(batches):
        for x in batches:
            out = []
            for _, part in x.groupby(x["v"].map(len)):
                m = np.stack([np.asarray(r, np.float64) for r in part["v"]])
                c = codes(m, bits, tables)
                out.append(part.assign(codes=list(c.astype(np.int32))))
            if out:
                yield pd.concat(out)

    spread = stage(groups.withColumn("size", F.size("v")).select("rep", "n", "label", "v", "size").mapInPandas(coded, "rep long, n long, label string, v array<double>, size int, codes array<int>"))
    entry = spread.select("rep", "n", "label", "size", "codes", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "size", "table", "code"]
    sizes = entry.groupBy(*bucket).agg(F.count("*").alias("many")).where("many > 1")
    # chunk c of k meets chunks 0 to k - 1: it goes to the k pairs that it is in
    placed = entry.join(sizes, bucket).withColumn("k", F.ceil(F.col("many") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep", "table"), F.col("k")).cast("int"))
    placed = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("chunk", "mate")).withColumn("hi", F.greatest("chunk", "mate"))
    placed = placed.join(spread.select("rep", "v"), "rep").select(*bucket, "lo", "hi", "chunk", "rep", "n", "codes", "v")

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rep")
        lo, hi = int(x["lo"].iloc[0]), int(x["hi"].iloc[0])
        if lo == hi:
            for_a, _, keep = _compare(x, None, threshold)
            parts = [(x, for_a)]
        else:
            a, b = x[x["chunk"] == lo], x[x["chunk"] == hi]
            if a.empty or b.empty:
                return pd.DataFrame({"rep": [], "links": [], "mate": []})
            for_a, for_b, keep = _compare(a, b, threshold)
            parts = [(a, for_a), (b, for_b)]
        found = pd.concat([pd.DataFrame({"rep": t["rep"].to_numpy(), "links": s, "mate": -1}) for t, s in parts])
        links = pd.DataFrame(keep, columns=["rep", "mate"]).assign(links=0)
        return pd.concat([found[found["links"] > 0], links])[["rep", "links", "mate"]]

    met = stage(placed.groupBy(*bucket, "lo", "hi").applyInPandas(meet, "rep long, links long, mate long"))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = met.where("mate <> -1").select(F.col("rep").alias("a"), F.col("mate").alias("b"))
    comps = components(spread.select(F.col("rep").alias("id")), edges)
    per = groups.select("digest", "rep", "n", "low").join(counts, "rep", "left").join(comps, F.col("rep") == F.col("id"))
    named = per.groupBy("component").agg(F.min("low").alias("component_id"))
    per = per.join(named, "component").select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id", F.lit(True).alias("known"))
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = rows.select("vec_id", "digest").join(per, "digest", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out

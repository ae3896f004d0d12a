"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact verification, connected components.

A document is a weighted set of shingles (runs of five words; A-Z as a-z; a text of one to four words is one shingle).
DartMinHash throws hashed darts at the plane of weight and rank over each element. A region of that plane is a dyadic
range of weights by a dyadic range of ranks; the element and the region alone decide how many darts fall there (a Poisson number) and
where. Darts under the element's weight count. Each has a hashed coordinate of the signature; the one with the lowest rank
stays. Regions of low rank come first, so large sets are done after few darts: a document's work is its number of shingles
plus about k log k. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Equal texts are one class from the start (null is the empty text), so a group of copies costs one row. Classes that agree in all
rows of a band are candidates. First each is compared with its band's head, the least of them. What a head joins needs no comparison
among itself; the other members of a band are compared with all that they aren't joined with, in two chunks of the band at a time: a task counts
the common shingles of two chunks by a matrix product and returns a spanning forest of the links that it finds. So every candidate
pair is decided exactly, but pairs are never made as rows. Components come from all links at the end. Texts without a word equal
only each other.

Rows without a doc_id are left out; repeated rows are copies of each other. An id may have several texts, each in a class
of its own; classes and components go by their smallest doc_id, so two of them may then have one name. Texts may have any length; other
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import components, drop, lookup, map_blocks, small_batches, stage, text_bytes

WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^4)^24, 3 in a million.
BANDS, ROWS = 24, 4
#: Members of a chunk, about, and bytes of their sets; items that a matrix product takes at once.
CHUNK, CHUNK_BYTES, COLUMNS = 512, 16 << 20, 4096

_U64 = np.uint64
_ALL = (1 << 64) - 1
#: Ranks below 2^BASE are one region; a set of 5,000 shingles needs no more.
BASE = -3


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(11)).astype(np.float64) * 2.0**-53


def _throw(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, level: int, k: int) -> tuple[np.ndarray, ...]:
    """Darts of one rank level for all elements: owner, coordinate, rank, id.

    Level l covers ranks from 2^(l-1) to 2^l, the lowest one (BASE) all ranks below 2^BASE. Weight ranges are 0 to 1, 1 to 2, 2 to
    4, 4 to 8 and so on. A region's area is its expected number of darts; one of area over 1 is cut into cells of area 1.
    """
    found = []
    top = int(np.ceil(np.log2(max(1.0, float(weight.max(initial=1.0))))))
    low, high = (0.0 if level == BASE else 2.0 ** (level - 1)), 2.0**level
    for band in range(top + 1):
        w_low, w_high = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0**band)
        some = np.flatnonzero(weight > w_low) if band else np.arange(len(weight))
        if not len(some):
            continue
        area = (high - low) * (w_high - w_low)
        cells = max(1, int(np.ceil(area)))
        steps = np.cumsum(np.exp(-area / cells) * (area / cells) ** np.arange(20) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 20.0))]))
        for cell in range(cells):
            salt = (level - BASE) * 64 + band + 1
            h = T.mix(element[some] + _U64(salt * 0xD1342543DE82EF95 & _ALL) + _U64(cell * 0xA24BAED4963EE407 & _ALL))
            u = _uniform(h)
            hit = np.flatnonzero(u >= steps[0])
            who, h = some[hit], h[hit]
            count = np.searchsorted(steps, u[hit], "right")
            for dart in range(int(count.max(initial=0))):
                has = count > dart
                at, g = who[has], T.mix(h[has] + _U64((dart + 1) * 0x9FB21C651E98DF25 & _ALL))
                rank = low + (cell + _uniform(g)) * ((high - low) / cells)
                under = w_low + _uniform(T.mix(g + _U64(1))) * (w_high - w_low) < weight[at]
                coordinate = (T.mix(g + _U64(2)) % _U64(k)).astype(np.int64)
                found.append((owner[at[under]], coordinate[under], rank[under], g[under]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, _U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k dart ids, from the elements (64-bit hashes, weights, index of the set) of n sets; 0 for empty sets."""
    out = np.zeros((n, k), _U64)
    rank = np.full((n, k), np.inf)
    left = np.bincount(owner, weight, n) > 0
    level = BASE
    while left.any():
        pick = left[owner]
        if not pick.all():
            element, weight, owner = element[pick], weight[pick], owner[pick]
        who, at, r, g = _throw(element, weight, owner, level, k)
        order = np.lexsort((r, who * k + at))
        who, at, r, g = who[order], at[order], r[order], g[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1])
        who, at, r, g = who[first], at[first], r[first], g[first]
        better = r < rank[who, at]
        rank[who[better], at[better]] = r[better]
        out[who[better], at[better]] = g[better]
        left &= ~np.isfinite(rank).all(axis=1)
        level += 1
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and the index of its text; sorted by text and shingle."""
    starts, ends, first = T.spans(data, offsets)
    value, first = T.shingles(T.hash_spans(data, starts, ends), first, WORDS)
    owner = T.owners(first)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])) if len(value) else np.zeros(0, np.int64)
    return value[new], np.diff(np.append(new, len(value))), owner[new]


def band_keys(data: np.ndarray, offsets: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """A row of BANDS keys for each text, and whether it has shingles."""
    value, times, owner = shingle_sets(data, offsets)
    n = len(offsets) - 1
    weight = times.astype(np.float64) if weighted else np.ones(len(value))
    sig = signatures(value, weight, owner, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15), (n, BANDS)).copy()
    for r in range(ROWS):
        keys = T.mix(keys + sig[:, :, r])
    return keys.view(np.int64), np.bincount(owner, minlength=n) > 0


def _items(data: np.ndarray, offsets: np.ndarray, weighted: bool) -> list[np.ndarray]:
    """Each text's shingles; weighted: the k-th occurrence of a shingle is an item of its own, so weights are counts of items."""
    value, times, owner = shingle_sets(data, offsets)
    if weighted:
        first = np.cumsum(times) - times
        nth = np.arange(int(times.sum())) - np.repeat(first, times)
        value, owner = T.mix(np.repeat(value, times) + nth.astype(_U64) * _U64(0xA24BAED4963EE407)), np.repeat(owner, times)
    cut = np.searchsorted(owner, np.arange(len(offsets)))
    return [value[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _sets(docs: DataFrame, weighted: bool) -> DataFrame:
    """id and items (8 bytes each) of docs(id, text)."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        items = _items(*text_bytes(block.column("text")), weighted)
        return pa.record_batch({"id": block.column("id"), "items": pa.array([x.tobytes() for x in items], pa.binary())})

    return map_blocks(docs, run, "id long, items binary")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, _U64) for x in column.to_pylist()]


def like_head(head: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of head with each of members (arrays of distinct items)."""
    sizes = np.array([len(x) for x in members], np.int64)
    owner = np.repeat(np.arange(len(members)), sizes)
    both = np.bincount(owner, np.isin(np.concatenate(members), head), len(members)) if len(owner) else np.zeros(len(members))
    return both / np.maximum(1, len(head) + sizes - both)


def near_matrix(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Whether the Jaccard similarity of each of left with each of right is at least least; common items are counted by matrix products."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    value = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    item = np.cumsum(new) - 1
    often = np.bincount(item)[item] > 1 if len(item) else new
    new, owner = new[often], owner[often]
    item = np.cumsum(new) - 1
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
        a, b = np.searchsorted(item, [low, low + COLUMNS])
        marks = np.zeros((len(left) + len(right), int(item[b - 1]) + 1 - low), np.float32)
        marks[owner[a:b], item[a:b] - low] = 1
        both += marks[: len(left)] @ marks[len(left) :].T
    return both >= least * (sizes[0][:, None] + sizes[1][None, :] - both)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (row, column) of the links that near marks."""
    rows_left, columns_left, out = near.any(axis=1), near.any(axis=0), []
    while rows_left.any():
        rows = [int(rows_left.argmax())]
        rows_left[rows] = False
        while rows:
            columns = []
            for i in rows:
                hit = np.flatnonzero(near[i] & columns_left)
                columns_left[hit] = False
                columns += hit.tolist()
                out += [(i, j) for j in hit.tolist()]
            rows = []
            for j in columns:
                hit = np.flatnonzero(near[:, j] & rows_left)
                rows_left[hit] = False
                rows += hit.tolist()
                out += [(i, j) for i in hit.tolist()]
    return out


def _with_heads(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) whose similarity is at least least. The members of a head are dealt in parts of about CHUNK."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"), F.count("*").alias("many"))
    members = lookup(pairs, parts, "a", ["parts"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"), F.lit(False).alias("head"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"), F.lit(True).alias("head"))

    def meet(x: pa.Table) -> pa.Table:
        x = x.sort_by([("head", "descending")])
        items, ids = _arrays(x.column("items")), x.column("id").to_numpy()
        near = np.flatnonzero(like_head(items[0], items[1:]) >= least) + 1 if x.column("head")[0].as_py() else []
        return pa.table({"a": pa.array(np.repeat(ids[:1], len(near)), pa.int64()), "b": pa.array(ids[near], pa.int64())})

    return members.unionByName(heads).join(sets, "id").groupBy("a", "part").applyInArrow(meet, "a long, b long")


def _among_members(shared: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of a band, heads aside, that links doesn't join through a common head.

    Members of a band are the larger side (those with the band's most frequent head) and the rest. Both are cut into chunks; the rest's chunks meet
    all chunks. A task compares two chunks and returns a spanning forest of the links between them.
    """
    label = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("low"))
    label = stage(sets.select("id", F.length("items").alias("bytes")).join(label, "id", "left").select("id", "bytes", F.least("low", "id").alias("label")))
    marked = stage(shared.where("id <> head").join(label, "id").select("key", "id", "label", "bytes"))
    sides = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    bands = sides.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"), F.max_by("bytes", F.struct("n", "label")).alias("most_bytes"), F.sum("n").alias("many"), F.sum("bytes").alias("bytes")).where("many > most")

    def chunks(n: str, size: str):
        return F.greatest(F.ceil(F.expr(n) / CHUNK), F.ceil(F.expr(size) / CHUNK_BYTES)).cast("int")

    bands = stage(bands.select("key", "major", "many", chunks("most", "most_bytes").alias("majors"), chunks("many - most", "bytes - most_bytes").alias("minors")))
    placed = lookup(marked, bands, "key", ["major", "majors", "minors"])
    is_major = F.col("label") == F.col("major")
    placed = placed.withColumn("chunk", F.when(is_major, F.pmod(F.xxhash64("id"), F.col("majors"))).otherwise(F.col("majors") + F.pmod(F.xxhash64("id"), F.col("minors"))).cast("int"))
    mates = F.when(is_major, F.sequence(F.col("majors"), F.col("majors") + F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("majors") + F.col("minors") - 1))
    placed = placed.withColumn("mate", F.explode(mates)).select("key", F.least("chunk", "mate").alias("lo"), F.greatest("chunk", "mate").alias("hi"), "chunk", "id", "label")

    def meet(x: pa.Table) -> pa.Table:
        items, ids, labels = _arrays(x.column("items")), x.column("id").to_numpy(), x.column("label").to_numpy()
        lo, hi, chunk = x.column("lo")[0].as_py(), x.column("hi")[0].as_py(), x.column("chunk").to_numpy()
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        links: list[tuple[int, int]] = []
        if len(left) and len(right) and (labels != labels[0]).any():
            near = near_matrix([items[i] for i in left], [items[j] for j in right], least) & (labels[left][:, None] != labels[right][None, :])
            links = forest(near)
        return pa.table({"a": pa.array([ids[left[i]] for i, _ in links], pa.int64()), "b": pa.array([ids[right[j]] for _, j in links], pa.int64())})

    found = stage(placed.join(sets, "id").groupBy("key", "lo", "hi").applyInArrow(meet, "a long, b long"))
    for x in (label, marked, bands):
        drop(x)
    return found


def _grouped(docs: DataFrame, weighted: bool, least: float) -> DataFrame:
    """doc_id, digest, class_id, component_id, best (the digest of the text that stands for the component) of each row with a doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text"))
    rows = stage(slim.select("doc_id", "digest"))
    # a number for each distinct text, so that an id with several texts doesn't tie them together
    classes = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).withColumn("node", F.monotonically_increasing_id()))
    spread = F.unhex(F.md5(F.col("doc_id").cast("string")))

    def keyed(block: pa.RecordBatch) -> pa.RecordBatch:
        keys, has = band_keys(*text_bytes(block.column("text")), weighted)
        n, has_words = BANDS * int(has.sum()), pa.array(has)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, BANDS), pa.int32()), pa.array(keys[has].ravel()))
        return pa.record_batch({"doc_id": block.column("doc_id").filter(has_words), "digest": block.column("digest").filter(has_words), "keys": lists})

    banded = map_blocks(slim.where("text is not null"), keyed, "doc_id long, digest binary, keys array<long>")
    entries = stage(lookup(banded, classes, "digest", ["first", "node"], spread).where("doc_id = first").select(F.col("node").alias("id"), F.explode("keys").alias("key")))
    heads = stage(entries.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("many")).where("head < last"))
    shared = stage(lookup(entries, heads, "key", ["head"]).distinct())
    drop(entries)
    pool = classes.join(shared.select(F.col("id").alias("node")).distinct(), "node").select("digest", F.col("first").alias("doc_id"), F.col("node").alias("id"))
    sets = stage(_sets(slim.join(pool, ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select("id", "text"), weighted))
    links = stage(_with_heads(shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), sets, least))
    more = _among_members(shared, links, sets, least)
    for x in (heads, shared, sets):
        drop(x)
    edges = stage(links.unionByName(more))
    linked = components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
    named = stage(linked.join(classes, F.col("id") == F.col("node")).select("digest", "first", "component"))
    best = named.groupBy("component").agg(F.min(F.struct("first", "digest")).alias("least"), F.count("*").alias("many"))
    best = lookup(named, stage(best.select("component", "many", F.col("least.first").alias("component_id"), F.col("least.digest").alias("best"))), "component", ["component_id", "best"])
    of_class = classes.join(best.drop("first", "component"), "digest", "left").select("digest", "many", F.col("first").alias("class_id"), F.coalesce("component_id", "first").alias("component_id"), F.coalesce("best", "digest").alias("best"))
    return lookup(rows, stage(of_class), "digest", ["class_id", "component_id", "best"], spread)


def near_duplicates(docs: DataFrame, weighted: bool = False, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id with the same text), component_id (the smallest doc_id that links lead to),
    kept (doc_id = component_id) of each row of docs(doc_id, text) whose doc_id is not null.

    Links join texts whose similarity is at least least. weighted: shingles weigh as often as they occur, else all the same.
    """
    out = _grouped(docs, weighted, least)
    return out.select("doc_id", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each near-duplicate group stays: that with the smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat a doc_id and text one stays. Of an id's texts in one group that with the least MD5 stays.
    """
    number, mark = (f"_{uuid.uuid4().hex}" for _ in range(2))
    kept = _grouped(docs, False, least).where("doc_id = component_id and digest = best").select(F.col("doc_id").alias(number), F.col("digest").alias(mark)).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    keyed = docs.where("doc_id is not null").withColumn(number, F.col("doc_id").cast("long")).withColumn(mark, digest)
    return docs.where("doc_id is null").unionByName(keyed.join(kept, [number, mark], "left_semi").dropDuplicates([number, mark]).select(*docs.columns))

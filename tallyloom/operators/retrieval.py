"""Retrieval: chunks, sections, vector search with filters, relative score floor, keyed upserts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.operators import products

# fixed values: hits for a query; share of the best score that a hit must have; characters of an excerpt
TOP_K, FLOOR, EXCERPT = 5, 0.78, 300
#: Parts that chunks of equal values are dealt to; components of vectors that are spread to columns, at most.
PARTS, SPREAD = 16, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    """The vector at length 1, so a cosine is one product; null values for one of length 0."""
    # the length stands in an array of one, as within the inner lambda it would be made for each component
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda size: F.transform(v, lambda x: F.try_divide(x.cast("double"), size))), F.lit(0))


def search(queries: DataFrame, chunks: DataFrame, on: list[str], k: int = TOP_K, floor: float | None = FLOOR) -> DataFrame:
    """The k best chunks of each query among those with equal values in the columns on: query_id, chunk_id, score, rank.

    queries(query_id, vector, on), chunks(chunk_id, vector, on). Ties go to the smaller chunk_id. With a floor, hits below that share of the query's best
    score are dropped, unless the best is not positive. Without columns on, blocks of queries and of chunks are multiplied as matrices, which tell the few pairs whose scores are then
    ranked; with them each query's chunks are ranked where they are read, in parts, before the parts' best are ranked together.
    """
    c, q = chunks.withColumn("cv", unit(F.col("vector"))).drop("vector"), queries.withColumn("qv", unit(F.col("vector"))).drop("vector")
    if on:
        return _floored(_best(_scored(q, c, on), k), floor)
    pairs = products.best_pairs(q.where(products.whole(F.col("qv"))), c.where(products.whole(F.col("cv"))), [], k, chunks.count(), queries.count())
    return _floored(_best(pairs.withColumn("score", F.round("score", 6)), k), floor)


def _scored(q: DataFrame, c: DataFrame, on: list[str]) -> DataFrame:
    """query_id, chunk_id, score of all pairs with equal values in on; rows are dealt to PARTS tasks for each of these values.

    Vectors of one length are spread to columns, so that a product is a plain expression instead of a function of arrays.
    """
    c = c.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    low, high = c.where(products.whole(F.col("cv"))).agg(F.min(F.size("cv")), F.max(F.size("cv"))).first()
    if low is None or low != high or not 0 < low <= SPREAD:
        return c.join(q, [*on, "part"]).select("query_id", "chunk_id", F.round(dot(F.col("qv"), F.col("cv")), 6).alias("score")).where("score is not null")

    def spread(df: DataFrame, vector: str, *ids: str) -> DataFrame:
        rows = df.where(products.whole(F.col(vector)) & (F.size(vector) == low))
        return rows.select(*ids, *on, "part", *[F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).alias(f"{vector}{i}") for i in range(low)])

    score = F.lit(0.0)
    for i in range(low):
        score = score + F.col(f"qv{i}") * F.col(f"cv{i}")
    return spread(c, "cv", "chunk_id").join(spread(q, "qv", "query_id"), [*on, "part"]).select("query_id", "chunk_id", F.round(score, 6).alias("score"))


#: Lists of an index, at most; lists that a query reads before bounds are looked at.
LISTS, FIRST = 1024, 4


@dataclass(frozen=True)
class Lists:
    """Chunks in lists around centroids: chunks(chunk_id, list, cv, on), of unit length, and lists(list, centroid, radius, many), with the largest angle of a chunk to its centroid."""

    chunks: DataFrame
    lists: DataFrame


def inverted(chunks: DataFrame, on: list[str], lists: int | None = None) -> Lists:
    """An index of chunks(chunk_id, vector, on), staged: each chunk is in the list of the centroid that is nearest to it.

    Centroids are the chunks with the smallest hashes of their ids: as many as the square root of the number of chunks, but at most LISTS, so all of them fit a task. Chunks
    without a direction (null, empty or zero vectors, or null components) are in no list, as search() never finds them.
    """
    rows = chunks.select("chunk_id", unit(F.col("vector")).alias("cv"), *on)
    rows = rows.where((F.size("cv") > 0) & F.forall("cv", lambda x: x.isNotNull()))
    many = lists or max(1, min(LISTS, math.isqrt(rows.count())))
    chosen = rows.select("chunk_id", "cv").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(many)
    centroids = [r["cv"] for r in chosen.orderBy("chunk_id").collect()]  # at most LISTS
    kept = ["chunk_id", "cv", *on]

    def place(batch, near):
        import numpy as np

        near = np.where(np.isnan(near), -1.0, near)
        best = near.argmax(axis=1)
        return {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {"list": best.astype("int32"), "angle": np.arccos(np.clip(near[np.arange(len(best)), best], -1.0, 1.0))}

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    placed = staging.stage(products.against(rows, "cv", centroids, f"{fields}, list int, angle double", place))
    ends = placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("many"))
    named = chunks.sparkSession.createDataFrame(list(enumerate(centroids)), "list int, centroid array<double>")
    return Lists(placed.drop("angle"), staging.stage(named.join(ends, "list")))


def search_lists(queries: DataFrame, index: Lists, on: list[str], k: int = TOP_K, floor: float | None = FLOOR) -> tuple[DataFrame, DataFrame]:
    """The hits of search() over the chunks of an index, and how many lists each query read: query_id, read, lists.

    No chunk of a list is nearer to a query than the angle to the centroid less the list's radius. A query reads the FIRST lists by that bound, then those whose bound isn't below its k-th best
    score; the rest can't change the result. A row for each query and list is made, without vectors; chunks of lists that a query doesn't read are not multiplied with it.
    """
    q = queries.select("query_id", unit(F.col("vector")).alias("qv"), *on).where((F.size("qv") > 0) & F.forall("qv", lambda x: x.isNotNull()))
    q = staging.stage(q)
    lists = index.lists.select("list", "centroid", "radius").orderBy("list").collect()  # at most LISTS rows
    names, radii = [r["list"] for r in lists], [r["radius"] for r in lists]

    def bound(batch, near):
        import numpy as np

        # scores are rounded to six places, so bounds are that much wider
        angle = np.arccos(np.clip(np.where(np.isnan(near), -1.0, near), -1.0, 1.0))
        bounds = np.cos(np.maximum(0.0, angle - np.array(radii))) + 2e-6
        order = np.argsort(-bounds, axis=1, kind="stable")
        ids = batch.column(batch.schema.get_field_index("query_id")).take(np.repeat(np.arange(batch.num_rows), len(names)))
        return {"query_id": ids, "list": np.array(names, dtype="int32")[order].ravel(), "bound": np.take_along_axis(bounds, order, axis=1).ravel(), "turn": np.tile(np.arange(1, len(names) + 1, dtype="int32"), batch.num_rows)}

    kind = dict(q.dtypes)["query_id"]
    bounded = staging.stage(products.against(q, "qv", [r["centroid"] for r in lists], f"query_id {kind}, list int, bound double, turn int", bound))
    many = index.chunks.count(), q.count()

    def hits(pairs: DataFrame) -> DataFrame:
        asked = pairs.groupBy("query_id").agg(F.collect_list("list").alias("asked"))  # at most LISTS
        found = products.best_pairs(q.join(asked, "query_id"), index.chunks, on, k, *many)
        return _best(found.withColumn("score", F.round("score", 6)), k)

    first = staging.stage(hits(bounded.where(F.col("turn") <= FIRST)))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    later = bounded.where(F.col("turn") > FIRST).join(enough, "query_id", "left").where(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("kth")))
    later = staging.stage(later.drop("n", "kth"))
    found = _floored(_best(first.drop("rank").unionByName(hits(later).drop("rank")), k), floor)
    read = bounded.where(F.col("turn") <= FIRST).select("query_id").unionByName(later.select("query_id")).groupBy("query_id").agg(F.count("*").alias("read"))
    return found, read.withColumn("lists", F.lit(len(lists)))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of scored(query_id, chunk_id, score) with their rank, ties to the smaller chunk_id; ranked in parts before the parts' best meet."""
    order = [F.desc("score"), F.asc("chunk_id")]
    part = scored.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _floored(ranked: DataFrame, floor: float | None) -> DataFrame:
    """ranked without hits below that share of their query's best score, unless that isn't positive."""
    if floor is None:
        return ranked
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("best", best).where((F.col("best") <= 0) | (F.col("score") >= F.col("best") * floor)).drop("best")


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """Chunks of at most size words of docs(document, text): document, chunk_index from 0, text, words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    many = F.ceil(F.size("words") / size).cast("int")
    parts = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice("words", i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))
    return docs.select("document", words.alias("words")).select("document", F.posexplode(parts).alias("chunk_index", "part")).select("document", "chunk_index", F.array_join("part", " ").alias("text"), F.size("part").alias("words"))


def sections(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Page ranges of sections: each ends before the next begins, the last at the document's end. headings(keys, page, title, pages)."""
    after = F.lead("page").over(Window.partitionBy(*keys).orderBy("page", "title"))
    return headings.withColumn("last_page", F.coalesce(after - 1, F.col("pages"))).withColumnRenamed("page", "first_page").drop("pages")


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: the one with the highest version, new before stored."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = stored.columns
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("row"))
    return best.select("row.*")


def excerpt(c: Column, length: int = EXCERPT) -> Column:
    return F.substring(c, 1, length)


def heading_pages(pages: DataFrame, pattern: str) -> DataFrame:
    """document, label, page: the last page of each heading whose line matches the pattern's first group; pages(document, page, text).

    The pattern is matched line by line; of a page its first match counts.
    """
    label = F.regexp_extract("text", f"(?m){pattern}", 1)
    return pages.withColumn("label", F.trim(label)).where("label <> ''").groupBy("document", "label").agg(F.max("page").alias("page"))


def original_pages(pages: Column, offset: Column) -> Column:
    """Sorted distinct page numbers of a slice, as they are in the whole document."""
    return F.array_sort(F.array_distinct(F.transform(pages, lambda p: p + offset)))


def contexts(hits: DataFrame, by: str = "\n\n---\n\n") -> DataFrame:
    """query_id, context (the hits' texts by rank) and sources (document, pages, excerpt by rank) of hits(query_id, rank, text, document, pages)."""
    every = F.array_sort(F.collect_list(F.struct("rank", "text", "document", "pages")))
    rows = hits.groupBy("query_id").agg(every.alias("h"))
    sources = F.transform("h", lambda x: F.struct(x["document"].alias("document"), x["pages"].alias("pages"), excerpt(x["text"]).alias("excerpt")))
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: x["text"]), by).alias("context"), sources.alias("sources"))

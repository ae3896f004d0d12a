"""Products of blocks of queries with blocks of chunks: the pairs that may be among a query's best, with their exact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks and queries of a block, on the average; queries that are multiplied at once. A task holds two blocks and a matrix of STEP x CHUNKS scores.
CHUNKS, QUERIES, STEP = 16_384, 16_384, 256
#: Scores are compared once rounded to six places; matrix products may add in another order.
MARGIN = 3e-6


def numbers(column):
    """For each length of the lists of an Arrow column: the places of the rows that have it, and their matrix. No list or item is null."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[int(size)] = rows, (flat.reshape(len(sizes), -1) if len(rows) == len(sizes) else flat[starts[rows, None] + np.arange(size)])
    return out


def candidates(scores, k: int):
    """Places (row, column) of a matrix of scores that the k best of a row may be at, once rounded; -inf is no score. NaN is above all."""
    import numpy as np

    scores[np.isnan(scores)] = np.inf
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None] - MARGIN if scores.shape[1] > k else -np.inf
    return np.nonzero((scores >= least) & (scores > -np.inf))


def _pairs(q, c, k: int):
    """Rows of q and c, which are Arrow tables, and scores of all pairs that may be among a row of q's k best."""
    import numpy as np

    chunks, found = numbers(c["cv"]), []
    lists = c["list"].to_numpy() if "list" in c.column_names else None
    for size, (rows, x) in numbers(q["qv"]).items():
        if size not in chunks:
            continue
        places, y = chunks[size]
        bounds = None
        if lists is not None:  # chunks of a list side by side, each list in the order of ids
            order = np.argsort(lists[places], kind="stable")
            places, y = places[order], y[order]
            names, begins = np.unique(lists[places], return_index=True)
            bounds = list(zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(places)], strict=True))
        for at in range(0, len(rows), STEP):
            part, a = rows[at : at + STEP], x[at : at + STEP]
            if bounds is None:
                scores = a @ y.T
            else:
                asked = q["asked"].take(part)
                asked = asked.combine_chunks() if hasattr(asked, "combine_chunks") else asked
                readers, read = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
                order = np.argsort(read, kind="stable")
                readers, read = readers[order], read[order]
                scores = np.full((len(part), len(places)), -np.inf)
                for name, begin, end in bounds:
                    who = readers[np.searchsorted(read, name) : np.searchsorted(read, name, "right")]
                    if len(who):
                        scores[who, begin:end] = a[who] @ y[begin:end].T
            i, j = candidates(scores, k)
            exact = np.zeros(len(i))
            for n in range(size):  # in the order of the components, as a sum over an array adds
                exact += a[i, n] * y[j, n]
            # of equal scores only the k smallest ids can be hits; chunks come by their ids
            order = np.lexsort((places[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])]) if len(i) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            keep = np.arange(len(i)) - np.repeat(first, np.diff([*first, len(i)])) < k
            found.append((part[i[keep]], places[j[keep]], exact[keep]))
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else none


def best_pairs(queries: DataFrame, chunks: DataFrame, on: list[str], k: int, chunks_count: int, queries_count: int) -> DataFrame:
    """query_id, chunk_id, score (not rounded) of pairs with equal values in on, among which are the k best of each query by score rounded to six places and the smaller id.

    queries(query_id, qv, on), chunks(chunk_id, cv, on): vectors of doubles without nulls, whose product is the score; others of another length are never compared. With a column asked (array of
    numbers) of queries and list of chunks only chunks of the lists that a query asks for are compared. Rows are dealt by hashes of their ids to a grid, whose cells are multiplied each by itself: a
    chunk goes to as many cells as there are blocks of queries, a query to as many as blocks of chunks.
    """
    across, down = max(1, -(-chunks_count // CHUNKS)), max(1, -(-queries_count // QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = lambda df: df.where(" and ".join(f"{c} is not null" for c in on)) if on else df
    keys, tasks = [*on, "across", "down"], min(4096, 4 * across * down)
    left = there(queries).withColumn("down", deal("query_id", down)).withColumn("across", every(across)).repartition(tasks, *keys)
    right = there(chunks).withColumn("across", deal("chunk_id", across)).withColumn("down", every(down)).repartition(tasks, *keys)
    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]

    def run(q, c):
        import pyarrow as pa

        c = c.sort_by("chunk_id")
        i, j, score = _pairs(q, c, k)
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "chunk_id": c["chunk_id"].take(pa.array(j)), "score": pa.array(score)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def against(rows: DataFrame, vector: str, fixed: list[list[float]], schema: str, make) -> DataFrame:
    """What make(batch, products) tells of each batch of rows, as columns of schema; products has a column for each of the fixed vectors, NaN where lengths differ."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sizes = np.array([len(f) for f in fixed])
        sides = {n: (np.flatnonzero(sizes == n), np.array([f for f in fixed if len(f) == n])) for n in set(sizes.tolist())}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                products = np.full((part.num_rows, len(fixed)), np.nan)
                for size, (which, x) in numbers(part.column(part.schema.get_field_index(vector))).items():
                    if size in sides:
                        places, y = sides[size]
                        products[np.ix_(which, places)] = x @ y.T
                yield pa.RecordBatch.from_pydict(make(part, products))

    return rows.mapInArrow(run, schema)


def whole(vector: Column) -> Column:
    """Whether a vector is there and has no null component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())

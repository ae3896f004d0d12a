"""Vector codes and centroid clusters against plain versions and against their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import clusters, codes, queries


def plain_books(rows, parts, entries, rounds, scale):
    """rows: (vec_id, label, vector) of whole vectors. Codebooks, then each row's indexes and error."""
    ints = [(i, [math.floor(scale * x) for x in v]) for i, _, v in rows]
    size = len(ints[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v in ints]
    start = sorted(range(len(ints)), key=lambda i: (ints[i][0] is None, ints[i]))[:entries]
    books = [[cut[i][p] for i in start] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [c[p] for c, k in zip(cut, of, strict=True) if k == e]) else b for e, b in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found]


def odd_rows(width, seed):
    """Whole vectors with ties, copies and repeated and null ids; and rows that are no vectors."""
    r = np.random.default_rng(seed)
    good = [(i, int(i % 3) if i % 7 else None, [float(x) for x in np.float32(r.normal(0, 0.2, width))]) for i in range(160)]
    good += [(200 + i, 1, [float(x) for x in r.integers(-2, 3, width) / 4]) for i in range(120)]  # many ties
    good += [(400 + i, 2, good[3][2]) for i in range(40)] + [(5, 0, good[9][2]), (None, 0, good[8][2]), (None, None, good[7][2]), (500, 1, [0.0] * width)]
    bad = [(600, 1, None), (601, 1, [float("nan")] * width), (602, 0, [1.0] * (width - 1) + [float("inf")]), (603, None, [None] + [0.5] * (width - 1))]
    return good, bad


def frame(spark, rows):
    return spark.createDataFrame([(i, e, n, f"x{i}", 0) for i, n, e in rows], "vec_id long, embedding array<float>, label int, code string, place int")


@pytest.mark.parametrize("entries", [1, 7, 64])
def test_the_tree_finds_the_nearest_and_the_lowest_of_equal_ones(entries):
    r = np.random.default_rng(entries)
    for book, x in (
        (r.integers(-300, 300, (entries, 4)), r.integers(-300, 300, (500, 4))),
        (r.integers(0, 3, (entries, 3)), r.integers(0, 3, (500, 3))),
        (np.zeros((entries, 2), int), r.integers(-2, 2, (50, 2))),
        (r.integers(-(2**26), 2**26, (entries, 4)), r.integers(-(2**26), 2**26, (200, 4))),
    ):
        index, d, _ = codes.Tree(book).nearest(x)
        every = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert index.tolist() == every.astype(float).argmin(axis=1).tolist() or all(every[i, k] == min(every[i]) and k == list(every[i]).index(min(every[i])) for i, k in enumerate(index))
        assert d.tolist() == [min(e) for e in every]


def test_the_tree_leaves_out_far_entries():
    r = np.random.default_rng(5)
    book = r.integers(-2000, 2000, (64, 4))
    x = book[r.integers(0, 64, 1000)] + r.integers(-20, 21, (1000, 4))
    assert codes.Tree(book).nearest(x)[2] < 0.4 * 64 * 1000  # both walks together


def test_codes(spark):
    good, bad = odd_rows(32, 1)
    books, plain = plain_books(good, 16, 64, 2, 256)
    odd = [(700, 1, [0.25] * 48), (701, 1, []), (702, 0, [1e30] * 32)]
    df = frame(spark, [*good, *bad, *odd]).repartition(3)
    found = codes.train(df)
    assert found.tolist() == books
    rows = codes.with_label_error(codes.compress(df, found)).collect()
    sums = {}
    for (_, label, _), (_, error) in zip(good, plain, strict=True):
        sums[label] = sums.get(label, 0) + error
    want = sorted((str(i), c, e, sums[n]) for (i, n, _), (c, e) in zip(good, plain, strict=True))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows if r.code) == want
    assert sorted(r.vec_id for r in rows if r.code is None) == [700, 701, 702] and all(r.error is None for r in rows if r.code is None)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert codes.digest(found) == hashlib.sha256(text.encode()).hexdigest()
    back = {r.vec_id: r.embedding for r in codes.decompress(codes.compress(df, found).where("vec_id = 3"), found).collect()}
    assert sum((math.floor(256 * a) - math.floor(256 * b)) ** 2 for a, b in zip(back[3], good[3][2], strict=True)) == plain[3][1]


def test_codes_of_few_vectors_and_none(spark):
    few = [(9, 0, [0.1] * 16), (4, None, [0.1] * 16), (7, 0, [-0.3] * 16)]
    df = frame(spark, few)
    books, plain = plain_books(few, 16, 64, 2, 256)
    assert codes.train(df).tolist() == books
    assert sorted((r.vec_id, r.code, r.error) for r in codes.compress(df, codes.train(df)).collect()) == sorted((i, *p) for (i, *_), p in zip(few, plain, strict=True))
    for rows in ([], [(1, 0, None)]):
        none = frame(spark, rows)
        assert codes.with_label_error(codes.compress(none, codes.train(none))).count() == 0


def plain_clusters(rows, k, rounds, scale):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, _, v in rows]
    key = [(i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in ints]
    centroids = [ints[j][1] for j in sorted(range(len(ints)), key=key.__getitem__)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in ints]

    for _ in range(rounds):
        of = assigned()
        centroids = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), (_, n) in zip(ints, of, strict=True) if n == c]) else old for c, old in enumerate(centroids)]
    return centroids, assigned()


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    good, bad = odd_rows(64, 2)
    centroids, plain = plain_clusters(good, 16, 3, 64)
    df = frame(spark, [*good, *bad, (700, 1, [0.25] * 63), (701, 1, []), (702, 0, [1e30] * 64)]).repartition(3)
    first = clusters.first_centroids(df)
    found, final = clusters.cluster(df, first)
    assert final.tolist() == centroids
    rows = clusters.with_inertia(found, final).collect()
    total = {n: sum(d for d, m in plain if m == n) for _, n in plain}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = sorted((str(i), n, d, total[n], sum(total.values()), digests[n]) for (i, *_), (d, n) in zip(good, plain, strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows) == want


def test_cover_tree():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-500, 500, (20, 5))[r.integers(0, 20, 700)] + r.integers(-9, 10, (700, 5)), np.zeros((100, 5), int)])
    tree, order = clusters.build(x)
    assert sorted(order.tolist()) == list(range(800)) and (tree.points == x[order]).all()
    for n in range(len(tree.radius)):
        own = tree.points[tree.begin[n] : tree.end[n]]
        assert np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max() <= tree.radius[n]
        kids = range(tree.children[n], tree.children_end[n])
        if kids:
            assert [tree.begin[k] for k in kids] == [tree.begin[n], *[tree.end[k] for k in kids][:-1]] and tree.end[kids[-1]] == tree.end[n]
            centres = np.array([tree.points[tree.begin[k]] for k in kids])
            scale = 2.0 ** (math.ceil(math.log2(np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max())) - 1)
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert apart.min() > scale
    number = np.arange(40)
    centroids, at = clusters.build(np.concatenate([x[:38], x[:2]]), leaf=1)  # two centroids twice
    whole, rows, to, compared = clusters.assign(tree, centroids, number[at])
    got = np.full(800, -1)
    got[rows] = number[at][to]
    for nodes, c in whole:
        for n, k in zip(nodes, c, strict=True):
            got[tree.begin[n] : tree.end[n]] = number[at][k]
    every = ((tree.points[:, None] - np.concatenate([x[:38], x[:2]])[None]) ** 2).sum(axis=2)
    assert got.tolist() == every.argmin(axis=1).tolist()
    assert compared < 0.3 * every.size


def test_clusters_of_few_vectors_and_none(spark):
    few = [(1, 0, [0.5] * 64), (2, 0, [0.5] * 64), (3, 0, [-1.0] * 64)]
    centroids, plain = plain_clusters(few, 16, 3, 64)
    df = frame(spark, few)
    found, final = clusters.cluster(df, clusters.first_centroids(df))
    assert final.tolist() == centroids and sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted((i, n, d) for (i, *_), (d, n) in zip(few, plain, strict=True))
    none = frame(spark, [(1, 0, None)])
    assert clusters.with_inertia(*clusters.cluster(none, clusters.first_centroids(none))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tmp_path, name):
    good, bad = odd_rows(64, 4)
    rows = [x for n, x in enumerate(good) if x[0] is not None and x[0] not in [y[0] for y in good[:n]]] + bad
    df = frame(spark, rows).select("vec_id", "embedding", "label")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    said = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in said.description]
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(said.fetchall())


def test_queries_name_their_columns(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int").select("vec_id", "embedding", "label", F.lit(1).alias("vec"))
    assert codes.train(none).size == 0 and clusters.first_centroids(none).shape == (0, 64)

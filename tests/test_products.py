"""Search by blocks of products against the scan of pairs, on odd vectors, and its plan."""

import math

import numpy as np
import pytest

from tallyloom.operators import products, retrieval

ODD = [(900, None), (901, [0.0] * 6), (902, [None] * 6), (903, [1.0, 2.0]), (904, []), (905, [1.0, None, 0.0, 0.0, 0.0, 0.0])]


def frames(spark, odd):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 6))
    x[:30] = x[30]  # copies: ties go to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(*o, 0) for o in odd]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, p int").repartition(3)
    asked = [(i, x[5 * i].tolist(), 0) for i in range(40)] + [(*o, 0) for o in odd]
    return spark.createDataFrame(asked, "query_id long, vector array<double>, p int"), chunks


def plain(queries, chunks, k, floor):
    pairs = chunks.withColumn("cv", retrieval.unit(chunks.vector)).drop("vector").join(queries.withColumn("qv", retrieval.unit(queries.vector)).drop("vector"), ["p"])
    scored = pairs.selectExpr("query_id", "chunk_id", "round(aggregate(zip_with(qv, cv, (a, b) -> a * b), 0d, (s, x) -> s + x), 6) as score").where("score is not null")
    return retrieval._floored(retrieval._best(scored, k), floor)


def hits(df):
    return sorted((r.query_id, r.chunk_id, "nan" if math.isnan(r.score) else r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize("odd", [ODD, [], [(906, [math.nan] * 6)]])
@pytest.mark.parametrize("k, floor", [(5, 0.78), (40, None)])
def test_search_is_the_scan_of_pairs(spark, monkeypatch, odd, k, floor):
    monkeypatch.setattr(products, "CHUNKS", 100)
    monkeypatch.setattr(products, "QUERIES", 20)
    queries, chunks = frames(spark, odd)
    want = hits(plain(queries, chunks, k, floor))
    assert hits(retrieval.search(queries, chunks, ["p"], k, floor)) == want
    assert hits(retrieval.search(queries.drop("p"), chunks.drop("p"), [], k, floor)) == want


def test_no_row_is_made_for_each_pair(spark):
    queries, chunks = frames(spark, ODD)
    plan = retrieval.search(queries.drop("p"), chunks.drop("p"), [])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    filtered = retrieval.search(*(df.where("size(vector) = 6") for df in (queries, chunks)), ["p"])._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in filtered.split("Join")[0]  # products of pairs are plain expressions


def test_a_length_is_computed_once(spark):
    """Not for each component: the sum stands in no lambda over the components."""
    df = spark.range(1).selectExpr("array(3d, 4d) as v")
    assert df.select(retrieval.unit(df.v).alias("u")).first().u == [0.6, 0.8]
    plan = df.select(retrieval.unit(df.v))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.index("sqrt") < plan.index("try_divide")

"""Search through lists around centroids against the full scan."""

import numpy as np
import pytest

from tallyloom.operators import retrieval


@pytest.mark.parametrize("on", [[], ["p"]])
def test_lists_give_the_hits_of_a_full_scan(spark, on):
    r = np.random.default_rng(6)
    base = r.standard_normal((12, 8))
    x = base[r.integers(0, 12, 600)] + 0.1 * r.standard_normal((600, 8))
    x[:40] = x[40]  # copies: ties go to the smaller id
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 1), (902, [None] * 8, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, p int").repartition(4)
    asked = [(i, (x[5 * i] + 0.05 * r.standard_normal(8)).tolist(), i % 3) for i in range(25)] + [(50, [0.0] * 8, 0), (51, (-x[3]).tolist(), 1), (52, x[0].tolist(), None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, p int")
    index = retrieval.inverted(chunks, on, lists=24)
    for k, floor in ((5, 0.78), (8, None)):
        found, read = retrieval.search_lists(queries, index, on, k, floor)
        want = sorted(map(tuple, retrieval.search(queries, chunks, on, k, floor).select("query_id", "chunk_id", "score", "rank").collect()))
        assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == want
    many = {q.query_id: q.read for q in read.collect()}
    assert all(q.lists <= 24 for q in read.collect()) and np.mean([many[i] for i in range(25)]) < (14 if on else 10)
    none = retrieval.inverted(chunks.where("chunk_id >= 900"), on)
    assert retrieval.search_lists(queries, none, on)[0].count() == 0

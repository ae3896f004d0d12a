"""Substring dedup: rows as documents, passages that several later documents share, inserted words."""

import numpy as np
import pyarrow as pa

from tallyloom.llm import blocks as B
from tallyloom.llm import passages

rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(900)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def spans(df):
    return sorted((r.start_word, r.end_word, r.copy) for r in df.collect())


def test_two_equal_rows_keep_one(spark):
    text = prose(60)
    df = frame(spark, [(7, text), (7, text)])
    assert spans(passages.repeated(df)) == [(0, 60, False), (0, 60, True)]
    assert [tuple(r) for r in passages.without_copies(df).collect()] == [(7, text)]


def test_one_id_with_two_texts(spark):
    clean, first, own, passage = prose(200), prose(30), prose(40), prose(80)
    df = frame(spark, [(1, f"{first} {passage}"), (2, clean), (2, f"{own} {passage}")])
    left = sorted(tuple(r) for r in passages.without_copies(df).collect())
    assert [(i, t.split()) for i, t in left] == sorted((i, t.split()) for i, t in [(1, f"{first} {passage}"), (2, clean), (2, own)])


def test_null_ids_are_rows_of_their_own(spark):
    a, b, clean = prose(60), prose(70), prose(150)
    heads = [prose(20) for _ in range(2)]
    df = frame(spark, [(None, f"{heads[0]} {a}"), (None, clean), (None, f"{heads[1]} {a}"), (None, b), (None, b)])
    assert spans(passages.repeated(df)) == [(0, 70, False), (0, 70, True), (20, 80, False), (20, 80, True)]
    left = sorted(r.text.split() for r in passages.without_copies(df).collect())
    assert left == sorted(t.split() for t in (f"{heads[0]} {a}", clean, heads[1], b))


def test_words_missing_or_inserted_next_to_one_anchor():
    a = np.arange(60, dtype=np.uint32)
    for at in range(8, 53):
        longer = np.insert(a, at, 999).astype(np.uint32)
        assert passages.alike(longer, a, [(2, 2)]) == [(0, 61, 0, 60)], at
        assert passages.alike(longer, a, [(59, 58)]) == [(0, 61, 0, 60)], at
        assert passages.alike(a, longer, [(2, 2)]) == [(0, 60, 0, 61)], at
        twice = np.insert(a, at, a[at - 1]).astype(np.uint32)
        assert passages.alike(twice, a, [(2, 2)]) == [(0, 61, 0, 60)], at


def blocks_of(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    rows = list(range(len(raw)))
    return pa.table({"block": [0], "rows": [rows], "ids": [rows], "offsets": [B.pack(offsets)], "data": [B.pack(np.frombuffer(b"".join(raw), np.uint8))]})


def test_run_hashes_tell_runs_apart():
    words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    words[300:360] = words[20:80]
    got = passages._run_hashes(words)
    assert len(got) == 351 and (got[300:311] == got[20:31]).all() and len(set(got.tolist())) == 340


def test_later_documents_meet_past_an_earlier_one_with_less():
    none = pa.table({"block": pa.array([], pa.int64())})
    for _ in range(150):
        passage = prose(50)
        less = " ".join(passage.split()[:49])
        texts = [f"{prose(30)} {less} {prose(30)}", f"{prose(25)} {passage} {prose(25)}", f"{prose(20)} {passage} {prose(20)}"]
        found = {(r["row"], r["start"], r["end"], r["copy"]) for r in passages._verify(none, blocks_of(texts)).to_pylist()}
        assert any(r == 2 and s <= 20 and e >= 70 and c for r, s, e, c in found)
        assert any(r == 1 and s <= 25 and e >= 75 and not c for r, s, e, c in found)


def test_later_documents_meet_past_an_earlier_one_in_other_blocks(spark):
    passage = prose(50)
    less = " ".join(passage.split()[:49])
    rows = [(1, f"{prose(30)} {less} {prose(30)}"), (2, f"{prose(25)} {passage} {prose(25)}"), (3, f"{prose(20)} {passage} {prose(20)}")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    found = [(r.doc_id, r.start_word <= 25, r.end_word >= 70, r.copy) for r in passages.repeated(df).collect()]
    assert sorted(found) == [(2, True, True, False), (3, True, True, True)]

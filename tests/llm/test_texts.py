"""MinHash near-dedup, substring dedup, fingerprints, BPE and packing against plain versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, fingerprints, minhash, packing, passages, tokens
from tallyloom.llm.common import text_bytes

from . import brute

NAME = "word_bpe_49k.json"
rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(text, every):
    return " ".join("edit" if k % every == every - 1 else w for k, w in enumerate(text.split(" ")))


@pytest.fixture(scope="module")
def texts():
    base, passage = [prose(120) for _ in range(6)], prose(70)
    out = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "One  TWO", 5: "one two", 10: prose(30_000)}
    for k, t in enumerate(base):
        out[20 + k] = t
        out[40 + k] = t.upper()
        out[60 + k] = edited(t, 100)
        out[80 + k] = f"{prose(40)} {passage} {prose(40)}"
    out |= {100 + k: base[0] for k in range(20)}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, "x", "y") for i, t in texts.items()] + [(None, "no id", "en", 1, "x", "y"), (20, texts[20], "en", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, key string, first string").repartition(3)


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(NAME))
    t.no_truncation()
    t.no_padding()
    return t


def test_near_duplicates_match_brute_force(docs, texts):
    rows = minhash.near_duplicates(docs).collect()
    want = brute.near_groups({i: t or "" for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in rows} == want
    assert len(rows) == len(texts) + 1 and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_keep_one_keeps_columns_and_one_of_each_group(docs, texts):
    kept = minhash.keep_one(docs)
    want = brute.near_groups({i: t or "" for i, t in texts.items()})
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1


def test_chain_that_the_smallest_id_does_not_join(spark):
    # b and c are alike, both share bands with a but are less like it
    w = prose(400).split(" ")
    rows = [(1, " ".join(w)), (2, " ".join(w[55:] + VOCABULARY[:55])), (3, " ".join(w[55:] + VOCABULARY[:50]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_groups(dict(rows))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want and want[3] == 2


def test_ids_with_two_texts_and_repeated_rows(spark):
    a, b = prose(90), prose(90)
    rows = [(5, a), (5, b), (7, a), (8, b), (8, b), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("d")).withColumn("best", F.lit(1))
    out = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id, r.component_id, r.kept) for r in out) == [(5, 5, 5, True), (5, 5, 5, True), (7, 5, 5, False), (8, 5, 5, False), (8, 5, 5, False)]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (0, a)])
    # an edit of one text doesn't lead to the other one's group
    more = df.unionByName(spark.createDataFrame([(4, edited(a, 80))], "doc_id long, text string"), allowMissingColumns=True)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(more).collect()} == {(4, 4), (5, 4), (5, 5), (7, 4), (8, 5)}


@pytest.mark.parametrize("weighted", [False, True])
def test_large_band_of_many_groups(spark, monkeypatch, weighted):
    # texts around one base that share bands with it, in groups that link among themselves only
    monkeypatch.setattr(minhash, "CHUNK", 4)
    base = prose(300).split(" ")
    rows, k = [], 0
    for group in range(12):
        own = list(base)
        for at in rng.choice(60, 14, False):
            own[at * 5] = f"group{group}"
        for _ in range(4):
            text = list(own)
            text[int(rng.integers(300))] = f"doc{k}"
            rows.append((k, " ".join(text + ["again"] * 30)))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_groups(dict(rows), weighted=weighted)
    assert len(set(want.values())) > 4
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, weighted).collect()} == want


def test_chunks_compare_exactly_and_forests_span():
    r = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([r.choice(40, 34, False), r.integers(1000, 10_000, r.integers(0, 6))])).astype(np.uint64) for _ in range(30)] + [np.zeros(0, np.uint64)] * 2
    near = minhash.near_matrix(sets[:18], sets[18:], 0.65)
    plain = np.array([[len(np.intersect1d(x, y)) >= 0.65 * len(np.union1d(x, y)) for y in sets[18:]] for x in sets[:18]])
    assert (near == plain).all() and near.any() and not near.all()
    pairs = [(i, 18 + j) for i, j in zip(*np.nonzero(near), strict=True)]
    spanning = [(i, 18 + j) for i, j in minhash.forest(near)]
    assert set(spanning) <= set(pairs) and brute.united(range(32), spanning) == brute.united(range(32), pairs)
    head = minhash.like_head(sets[0], sets)
    assert (head >= 0.65).tolist() == [len(np.intersect1d(sets[0], y)) >= 0.65 * len(np.union1d(sets[0], y)) for y in sets]


def test_weighted_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(5)
    items = r.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = r.integers(1, 9, 60).astype(float), r.integers(1, 9, 60).astype(float)
    sig = minhash.signatures(np.concatenate([items, items]), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert (sig > 0).all()


def test_repeated_passages_cover_brute_force(docs, texts):
    rows = passages.repeated(docs).collect()
    got = {i: [False] * len(brute.words(t)) for i, t in texts.items()}
    for r in rows:
        assert r.n_words == r.end_word - r.start_word
        for k in range(r.start_word, r.end_word):
            got[r.doc_id][k] = True
    for i, want in brute.repeated_words(texts).items():
        assert all(g for g, w in zip(got[i], want, strict=True) if w), i
        if not any(want) and i < 60:
            assert not any(got[i]), i


def test_copies_go_and_the_first_stays(docs, texts):
    left = {r.doc_id: r.text for r in passages.without_copies(docs).where("doc_id is not null").collect()}
    many = [brute.words(t) for t in left.values()]
    shared = brute.words(texts[80])[40:110]
    assert sum(any(w[k : k + 70] == shared for k in range(len(w) - 69)) for w in many) == 1
    assert {0, 1, 2, 3, 4, 5, 10, 80, 85} <= set(left) and left[10] == texts[10]
    assert len(set(left) & {20, 40, 60, *range(100, 120)}) == 1  # that which Spark reads first


def test_near_equal_passages():
    a = np.arange(200, dtype=np.uint32)
    b = np.concatenate([np.arange(5000, 5030), np.arange(40, 70), [7], np.arange(71, 160)]).astype(np.uint32)
    assert passages.alike(a, b, [(50, 40)]) == [(40, 160, 30, 150)]
    assert passages.alike(a, b[:70], [(50, 40)]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab '.<|>endoftxsrIİıσΣ\n\t é́", max_size=60)), max_size=6))
def test_encoding_equals_the_library(many):
    many = [t.encode("utf-8", "ignore").decode() for t in many]
    t = tokenizer()
    want = [t.encode(x, add_special_tokens=False).ids for x in many]
    ids, first = bpe.encode_texts(*text_bytes(pa.array(many, pa.string())), NAME)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    ids, first = tokens.encoder(NAME).encode_many(many, 2)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [[*w, 2] for w in want]
    assert [bpe.decoder(NAME)(w) for w in want] == [t.decode(w, skip_special_tokens=False) for w in want]


def test_round_trip_rows(docs, texts):
    t = tokenizer()
    rows = {r.doc_id: r for r in bpe.round_trip(docs, NAME).collect()}
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_is_whole_and_full(docs, texts):
    t = tokenizer()
    rows = packing.pack(docs, NAME, 256).collect()
    assert len({(r.doc_id, r.start, r.sequence_id, r.offset) for r in rows}) == len(rows)
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        mine = mine[::2] if i == 20 else mine  # that row is there twice
        at = 0
        for start, length, crc, total in mine:
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids), i
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n & (n - 1) == 0 and n <= 256 for n in sequences.values())


def test_neighbours_come_next():
    a, b = np.arange(100, 160), np.arange(300, 360)
    order = list(packing.in_order([a, b, a + 0, b + 0], 120, 120))
    assert order == [0, 2, 1, 3]


def test_neighbours_are_those_of_plain_bm25(monkeypatch):
    r = np.random.default_rng(15)
    docs = [r.choice(400, r.integers(5, 120), p=(w := 1 / np.arange(1, 401)) / w.sum()) for _ in range(80)]
    monkeypatch.setattr(packing, "BEST", 5)
    index, mean = packing.Index(docs), np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))
    for seed in range(0, 80, 7):
        index.unused[:] = True
        index.unused[[seed, 3, 4]] = False
        score = {}
        for i, d in enumerate(docs):
            times = Counter(d.tolist())
            s = sum(np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * times[t] * (packing.K1 + 1) / (times[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in set(docs[seed].tolist()) if times[t])
            if s and i not in (seed, 3, 4):
                score[i] = s
        found = list(index.neighbours(seed))
        assert sorted(found) == sorted(score)
        ranked = [score[i] for i in found]
        assert all(a >= b - 1e-4 * a for a, b in zip(ranked, ranked[1:], strict=False))


def test_fingerprints_are_sums_over_paragraphs(docs, texts):
    fp = fingerprints.fingerprint
    assert fp("a b\nc d\na b") == fp("c d\na b\na b") != fp("c d\na b")
    assert fingerprints.insert(fp("c d\na b"), "a b") == fp("a b\na b\nc d")
    assert fingerprints.delete(fp("a b\na b\nc d"), "c d") == fp("a b\na b")
    assert fingerprints.likeness(fp(""), fp(None)) == 1.0
    rows = fingerprints.compared_with_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edit = own[: len(own) - half] + after[:half]
        r = next(r for r in rows if r.doc_id == i)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.fingerprint == fp(own) and r.edited_fingerprint == fp(edit)
        assert r.near_next == pytest.approx(fingerprints.likeness(fp(own), fp(after))) and 0 <= r.near_edited <= 1


def plain_likeness(a, b):
    def counted(text):
        out = Counter()
        for line in (text or "").split("\n"):
            seen = Counter()
            w = brute.words(line)
            for pair in zip([None, *w], w, strict=False):
                out[pair, seen[pair]] += 1
                seen[pair] += 1
        return out

    x, y = counted(a), counted(b)
    return 2 * sum(n * y[k] for k, n in x.items()) / max(1, sum(n * n for n in x.values()) + sum(n * n for n in y.values()))


def test_likeness_is_near_the_plain_one():
    fp, some = fingerprints.fingerprint, prose(300)
    line = prose(12)
    cases = [("buy now " * 1000, "buy now " * 900), ("BUY!!! NOW!!! " * 40, "BUY!!! NOW!!! " * 30), (some, edited(some, 10)), (some, some[:900]), (some, prose(300)), (f"{line}\n" * 50, f"{line}\n" * 40 + prose(40)), (some, some), ("a", "b"), ("", some)]
    for a, b in cases:
        assert fingerprints.likeness(fp(a), fp(b)) == pytest.approx(plain_likeness(a, b), abs=0.2), (a[:30], b[:30])


def test_order_of_outlying_equal_and_null_ids(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(1 << 60, "far")] + [(150, f"u{k}") for k in range(200)] + [(None, f"n{k}") for k in range(200)] + [(7, "t7")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("part", F.lit("x"))
    ordered = [(r.part, r.copy, r.doc_id, r.text) for r in fingerprints.in_order(df.select("doc_id", "text")).collect()]
    sizes = Counter(p for p, copy, *_ in ordered if not copy)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 180
    out = {(r.doc_id, r.fingerprint): r for r in fingerprints.compared_with_edits(df).collect()}
    follows = sorted((i for i, _ in rows if i is not None), reverse=True)
    assert len(follows) + 200 == len(rows)
    after = {r.edited_sha256 for k, r in out.items() if k[0] == 1 << 60}
    assert after == {hashlib.sha256(b"fat").hexdigest()}
    assert {r.edited_sha256 for k, r in out.items() if k[0] == 0} <= {hashlib.sha256(b"tn").hexdigest()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert passages.repeated(none).count() == 0 and passages.without_copies(none).count() == 0
    assert packing.pack(none, NAME).count() == 0 and bpe.round_trip(none, NAME).count() == 0
    assert fingerprints.compared_with_edits(none).count() == 0


def test_only_documents_with_a_term_in_common_are_neighbours():
    docs = [np.array(x) for x in ([5, 6, 2], [2], [5, 7, 2], [8, 2], [6, 5, 9, 2], [2])]
    index = packing.Index(docs, ended=True)
    assert sorted(index.neighbours(0)) == [0, 2, 4] and list(index.neighbours(1)) == list(index.neighbours(3)) == []
    assert sorted(packing.in_order(docs, 4, 4, ended=True)) == list(range(6))
    assert sorted(packing.in_order([np.array([2])] * 3, 4, 4, ended=True)) == [0, 1, 2]

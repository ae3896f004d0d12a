"""Huffman codes and files of token ids: optimal lengths, exact round trips, damage."""

import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import huffman, idfiles

NAME = "word_bpe_49k.json"


def plain_bits(counts):
    """Bits of all ids by an unlimited Huffman code."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def plain_limited(counts, limit):
    """Fewest bits of any prefix code with no length over limit, by trying all multisets of lengths."""
    n = len(counts)
    fits = (x for x in itertools.combinations_with_replacement(range(1, limit + 1), n) if sum(2.0**-k for k in x) <= 1)
    return min(sum(a * b for a, b in zip(sorted(counts, reverse=True), x, strict=True)) for x in fits)


def test_lengths():
    r = np.random.default_rng(1)
    for n in (2, 3, 40, 3000):
        counts = np.zeros(n + 5, np.int64)
        counts[r.permutation(n + 5)[:n]] = r.zipf(1.5, n).clip(1, 10**6)
        x = huffman.lengths(counts, 30)
        assert (counts * x).sum() == plain_bits(counts.tolist()) and ((x > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(k) for k in x if k) == 1
    for _ in range(20):
        counts = (2 ** r.integers(0, 12, 6)).astype(np.int64)
        for limit in (3, 4, 5):
            x = huffman.lengths(counts, limit)
            assert x.max() <= limit and (counts * x).sum() == plain_limited(counts.tolist(), limit)
    assert huffman.lengths(np.array([0, 7]), 18).tolist() == [0, 1] and huffman.lengths(np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        huffman.lengths(np.ones(9, np.int64), 3)


def test_codes_are_canonical_and_free_of_prefixes():
    r = np.random.default_rng(2)
    length = huffman.lengths(r.zipf(1.3, 500).clip(1, 10**7), 12)
    code = huffman.codes(length)
    texts = sorted(f"{c:0{n}b}" for c, n in zip(code.tolist(), length.tolist(), strict=True))
    assert all(not b.startswith(a) for a, b in itertools.pairwise(texts))
    order = np.lexsort((np.arange(500), length))
    assert all((f"{code[a]:0{length[a]}b}" < f"{code[b]:0{length[b]}b}") for a, b in itertools.pairwise(order.tolist()))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    r = np.random.default_rng(n)
    counts = np.bincount(r.zipf(1.2, 4000).clip(0, 900), minlength=901)
    coder = huffman.Coder(huffman.lengths(counts, 14))
    ids = r.choice(np.nonzero(counts)[0], n)
    bits, gaps = coder.encode(ids)
    assert "".join(f"{b:08b}" for b in bits).startswith("".join(f"{coder.code[i]:0{coder.length[i]}b}" for i in ids))
    assert coder.decode(bits, gaps, n).tolist() == ids.tolist() and len(gaps) == -(-n // huffman.STEP)


def texts():
    r = np.random.default_rng(3)
    words = ["the", "Müller", "naïve", "x1", "don't", "<|endoftext|>", "日本", "a", "of"]
    many = [" ".join(r.choice(words, r.integers(0, 80))) for _ in range(80)]
    return [None, "", " \n", "the " * 30_000, *many, *many[:5]]


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK", 1500)
    monkeypatch.setattr(idfiles, "FILE_BLOCKS", 2)
    rows = [(i * 7919 % 1009, t, "x", 1) for i, t in enumerate(texts())] + [(5, "the end", "", 2), (5, "the end", "", 3), (5, "another", "", 3), (None, "of none", "", 4), (None, None, "", 5), (-4, "below", "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(5)
    idfiles.write(df, NAME, 1, f"{tmp_path}/f")
    got = idfiles.read(spark, f"{tmp_path}/f").collect()
    whole = Tokenizer.from_file(public_tokenizers.path(NAME))
    whole.no_truncation()
    plain = [(d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, *_ in rows]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), x) for d, x in plain)
    start, before = 0, -(10**9)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and before <= (-(10**9) if r.doc_id is None else r.doc_id)
        start, before = start + len(r.ids) // 4, -(10**9) if r.doc_id is None else r.doc_id
    assert start == sum(len(x) // 4 for _, x in plain)


def test_files_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    idfiles.write(none, NAME, 1, f"{tmp_path}/f")
    assert idfiles.read(spark, f"{tmp_path}/f").count() == 0
    only = spark.createDataFrame([(3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in idfiles.round_trip(only, NAME, 1).collect()] == [(3, 0, b"\1\0\0\0")]


def test_damage_is_noticed():
    coder = huffman.Coder(huffman.lengths(np.array([5, 3, 2, 1]), 18))
    record = idfiles.block_bytes(coder, 2, 0, 10, [7, None], np.array([3, 2]), np.array([0, 1, 2, 3, 0]))
    assert [x[:4] for x in idfiles.heads(record + b"\n")] == [(2, 10, 2, 5)]
    doc_ids, many, ids = idfiles.read_block(coder, record, 0)
    assert (doc_ids, many.tolist(), ids.tolist()) == ([7, None], [3, 2], [0, 1, 2, 3, 0])
    for at in (40, 60, len(record) - 6):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            idfiles.read_block(coder, bytes(broken), 0)

"""Nested sections against a plain version; chunks that fit, with the text kept whole."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.operators import chunking

GRADE, THEME = r"^\s*(G\d+)\s*$", r"^\s*THEME: (.+?)\s*$"


def plain_sections(pages):
    """pages: {page: text} of one document, its first page 1."""

    def heads(first, last, pattern):
        at = {}
        for p in range(first, last + 1):
            if m := re.search(pattern, pages.get(p, ""), re.MULTILINE):
                at[m[1].strip()] = p
        found = sorted((p, label) for label, p in at.items())
        ends = [p - 1 for p, _ in found[1:]] + [last][: len(found)]
        return [(label, p, e) for (p, label), e in zip(found, ends, strict=True)] or [(None, first, last)]

    last = max(pages)
    return sorted((str((g, t, a, b))) for g, x, y in heads(1, last, GRADE) for t, a, b in heads(x, y, THEME))


def test_nested_sections(spark):
    r = np.random.default_rng(8)
    docs = {}
    for d in range(40):
        some, n = r.random() < 0.8, int(r.integers(1, 30))
        docs[d] = {p: "x\n" + (f"G{r.integers(0, 4)}\n" if some and r.random() < 0.2 else "") + (f" THEME: t{r.integers(0, 3)} \n" if r.random() < 0.4 else "") + "G9 inside a line\ny" for p in range(1, n + 1)}
    rows = [(d, p, t, "x") for d, pages in docs.items() for p, t in pages.items()]
    df = spark.createDataFrame([*rows, (None, 3, "G1", "x"), (0, None, "G1", "x")], "document long, page int, text string, grade string").repartition(5)
    got = {}
    for r in chunking.nested_sections(df, GRADE, THEME).collect():
        got.setdefault(r.document, []).append(str((r.grade, r.theme, r.first_page, r.last_page)))
    assert {d: sorted(x) for d, x in got.items()} == {d: plain_sections(pages) for d, pages in docs.items()}
    assert chunking.nested_sections(df.where("false"), GRADE, THEME).count() == 0


def words(text):
    return len(text.split())


@pytest.mark.parametrize("limit", [4, 10, 60])
def test_segments(limit):
    r = np.random.default_rng(limit)
    parts = ["# one two\n", "## three\n", "#### four five six\n", "\n", "  \n", "a b c d e f g h i j k\n", "w " * 30 + "\n", "x", "ü" * 50 + "\r\n", "\t", "end."]
    for _ in range(150):
        text = "".join(r.choice(parts, r.integers(0, 25)))
        found = list(chunking.segments(text, words, limit))
        assert "".join(t for _, t, _ in found) == text
        assert all(words(whole) <= limit and t for _, t, whole in found)
        assert all(whole == "\n".join([*above, t]) for above, t, whole in found)
        for (a, s, w), (b, t, _) in zip(found, found[1:]):  # no chunk could have taken the line after it
            line = t.splitlines(keepends=True)[0]
            headed = [x.strip().startswith("#") for x in (s, t)]
            assert any(headed) or a != b or words(w + line) > limit or not line.strip() or len(line.split()) + 1 > limit - words("\n".join(a)), (s, t)


def test_headings_are_above_what_follows():
    text = "intro\n# A\na\n## B\nb\n# C\nc"
    assert [(above, t) for above, t, _ in chunking.segments(text, words)] == [([], "intro\n"), ([], "# A\n"), (["A"], "a\n"), (["A"], "## B\n"), (["A", "B"], "b\n"), ([], "# C\n"), (["C"], "c")]
    long = "# " + "x " * 40 + "\ny z"
    assert all(words(w) <= 10 for _, _, w in chunking.segments(long, words, 10)) and list(chunking.segments(long, words, 10))[-1][0] == []


def test_characters_are_cut_where_words_do_not_fit():
    assert [t for _, t, _ in chunking.segments("abcdefgh", len, 3)] == ["ab", "cd", "ef", "gh"]


def test_token_chunks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    r = np.random.default_rng(3)
    texts = [None, "", " \n\n", "word " * 3000, "# Head\n" + "\n".join("some words of a line, Ünïcode" for _ in range(400)), "x" * 9000, *[" ".join(r.choice(["the", "of", "Straße", "1999", "\n", "## b\n"], 700)) for _ in range(5)]]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "document long, text string, headings string").repartition(3)
    got = {}
    for c in chunking.token_chunks(df, path).collect():
        got.setdefault(c.document, {})[c.chunk_index] = c
        ids = len(whole.encode(c.contextualized_text, add_special_tokens=False).ids)
        assert ids == c.tokens <= 512
    for i, t in enumerate(texts):
        chunks = got.get(i, {})
        assert sorted(chunks) == list(range(len(chunks))) and "".join(chunks[k].text for k in sorted(chunks)) == (t or "")


def test_additive_counts_cut_alike_and_each_word_is_counted_few_times():
    text = "# A\n" + "".join(f"w{i} x{i}y \u2028 z\n" if i % 7 else f"## H {i}\n" + "long " * 40 + "q" * 90 + "\n" for i in range(120))
    seen = []

    def count(s):
        seen.append(len(s))
        return sum(1 + len(w) // 8 for w in s.split())

    plain = list(chunking.segments(text, count, 30))
    before = sum(seen)
    seen.clear()
    assert list(chunking.segments(text, count, 30, additive=True)) == plain
    assert sum(seen) < 0.5 * before and "".join(said for _, said, _ in plain) == text

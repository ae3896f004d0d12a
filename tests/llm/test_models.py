"""Quality, language model, licences, URL rules and embeddings."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import embeddings, licences, lm, quality, urls
from tallyloom.llm.eliasfano import EliasFano

from . import brute


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 5), (1000, 100), (1000, 1 << 40), (3000, 1 << 63)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano(v, universe)
    assert (e[np.arange(n)] == v).all()
    q = np.concatenate([v, r.integers(0, universe, 200, dtype=np.uint64), np.array([0, universe - 1], np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    low = r.integers(0, n // 2 + 1, len(q))
    high = low + r.integers(0, n // 2 + 1, len(q))
    assert (e.successor(q, low, high) == np.clip(np.searchsorted(v, q), low, high)).all()


def plain_lm(texts, strengths):
    """n_tokens, n_known, train_tokens, base_score and score of each text; every context after the text's start takes its own strength."""
    w = [[*brute.words(t), None] for t in texts]
    train = [i for i in range(len(w)) if zlib.crc32(str(i).encode()) % 7 != 2]
    n = Counter(x for i in train for x in w[i])
    pairs = Counter(p for i in train for p in zip(["<s>", *w[i]], w[i], strict=False))
    after = Counter({**n, "<s>": len(train)})
    total = sum(n.values())
    own = {y: (n[y] + 1) / (total + len(n) + 1) for x in w for y in x}
    follows = {}
    for (c, y), k in pairs.items():
        follows.setdefault(c, []).append((y, k))

    def strength(c):
        if c not in follows or after[c] * lm.HOT >= total or c == "<s>":
            return strengths[0]
        likely = [sum(k * math.log((k - 1 + m * own[y]) / (after[c] - 1 + m)) for y, k in follows[c]) for m in strengths]
        return next(m for m, v in zip(strengths, likely, strict=True) if v >= max(likely) - 1e-9 * abs(v))

    m = {c: strength(c) for x in w for c in ["<s>", *x]}
    return [
        (len(x), sum(n[y] > 0 for y in x), total, sum(math.log10(own[y]) for y in x), sum(math.log10((pairs[c, y] + m[c] * own[y]) / (after[c] + m[c])) for c, y in zip(["<s>", *x], x, strict=False)))
        for x in w
    ]


@pytest.mark.parametrize("strengths", [(3.0,), lm.STRENGTHS])
def test_lm_matches_the_formula(spark, monkeypatch, strengths):
    monkeypatch.setattr(lm, "HOT", 20)
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["the", "The", "a", "b", "c", "dd", "é", *"qrstuvw"], r.integers(0, 60))) for _ in range(60)] + [None, "", "zz zz", "the " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string").repartition(3)
    rows = {x.doc_id: x for x in lm.score(df, quality.in_fold("doc_id", 7, 2), strengths).collect()}
    for i, (tokens, known, total, base, score) in enumerate(plain_lm(texts, strengths)):
        row = rows[i]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (tokens, known, total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(score, abs=0.003 * tokens + 1e-9)


def test_lm_of_long_repeated_and_unnamed_rows_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(r.choice(words, 20_000)) for _ in range(6)] + ["w1 w2", "w1 w2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (7, "w1 w2")], "doc_id long, text string")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((x.doc_id is None, x.doc_id, x.n_tokens, round(x.score, 6)) for x in lm.score(df.repartition(int(n)), quality.in_fold("doc_id", 7, 2)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert found[0] == found[1] and len(found[0]) == 10
    # repeated rows count in training, so the plain model has them too; the null id is of no fold and trains
    assert len({s for *_, n, s in found[0] if n == 3}) == 1


def test_lm_of_nothing(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), quality.in_fold("doc_id", 7, 2)).count() == 0


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(2)
    return licences.fit([" ".join(r.choice(["the", "of", "work", "is", "and", "blue", "version", "free", "copy", "stone", "or"], 12)) for _ in range(300)])


def test_licences(spark, model):
    texts = [None, "", "prose of the day\nReleased under the MIT License.\nmore prose", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "the license of the work is free", "x\n" * 5000 + "Licensed under CC BY-NC 4.0.", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "Licensed under CC BY-SA 4.0."]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(2, texts[2], "a")], "doc_id long, text string, found string")
    rows = licences.scan(df, model).collect()
    assert {r.doc_id: r.families for r in rows} == dict(enumerate(["", "", "mit", "apache,proprietary", "", "cc-by-nc", "gpl", "cc-by"]))
    assert len(rows) == len(texts) + 1
    assert next(r for r in rows if r.doc_id == 2).found[0].line == 1
    assert {r.doc_id: r.n_paragraphs for r in rows}[5] == 5001


def test_licence_examples_are_told_apart(model):
    texts, classes = licences.examples(seed=99)
    which, z = model.logits(*licences._of(texts))
    right = sum(classes[i] == c for i, c in zip(which, z.argmax(axis=1), strict=True))
    assert right / len(texts) > 0.93


def test_url_rules(spark):
    given = ["http://Example.ORG/es/1", "https://a.example.org/en/1x?q=/de/", "http://org/fr/", "x://b.com/fr", "x://b.com/fr/#a", "x://com/de/9", "none", None, "x://notcom/de/", "x://b.net?a#b", "x://y://z.org/q"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    fixed = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    none = spark.createDataFrame([], "rule_id string, items array<string>, support double, confidence double")
    rows = {r.page_id: r for r in urls.judge(df, none, fixed).collect()}

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, None
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = brute.lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in fixed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    for i, u in enumerate(given):
        host, path, rule, verdict = plain(u)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_mined_rules(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.net/{'ads' if i % 2 == 0 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 2)], "page_id long, block boolean")
    rules = urls.mine(pages, labels, 0.05, 0.9, 1.2)
    found = [r["items"] for r in rules.collect()]
    assert ["h=bad"] in found and not any(len(x) > 1 and "h=bad" in x for x in found)
    judged = {r.page_id: r.verdict for r in urls.judge(pages, rules, []).collect()}
    assert all(judged[i] == ("block" if i % 4 == 0 else "allow") for i, _ in rows)
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, urls.mine(none, labels.limit(0)), []).count() == 0


def plain_rules(rows, labels, support, confidence, lift, count):
    """All sets of up to three tokens that are rules by counting, without those implied by one token fewer; tokens in the same pages count once."""
    known = {}
    for i, b in labels:
        known[i] = known.get(i, False) or b
    pages = [(frozenset(t), known[i]) for i, t in rows if i in known]
    blocked = sum(b for _, b in pages)
    least = max(count, support * len(pages))
    where = {x: tuple(k for k, (t, _) in enumerate(pages) if x in t) for t, _ in pages for x in t}
    names = sorted({min(y for y in where if where[y] == w) for x, w in where.items()})
    found = {}
    for size in (1, 2, 3):
        for s in itertools.combinations(names, size):
            hit = [b for t, b in pages if t >= set(s)]
            if sum(hit) >= least and sum(hit) / len(hit) >= max(confidence, lift * blocked / len(pages)):
                found[s] = sum(hit) / len(hit)
    return {s: c for s, c in found.items() if not any(found.get(tuple(x for x in s if x != y), -1) >= c for y in s if len(s) > 1)}


def test_mined_rules_match_brute_force(spark):
    r = np.random.default_rng(12)
    rows = [(i, f"http://{r.choice(['a', 'b', 'c'])}.{r.choice(['net', 'io'])}/{r.choice(['ads', 'news', 'x'])}/{r.choice(['p', 'q'])}/{i}") for i in range(300)]
    labels = [(i, bool("ads" in u and "a." in u and r.random() < 0.9 or r.random() < 0.1)) for i, u in rows if i % 2]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("r")).withColumn("items", F.lit("i"))
    tokens = {x.page_id: x.items for x in pages.select("page_id", urls.tokens(F.col("url")).alias("items")).collect()}
    rules = urls.mine(pages, spark.createDataFrame(labels, "page_id long, block boolean"), 0.02, 0.5, 1.2)
    got = {tuple(x["items"]): x.confidence for x in rules.collect()}
    want = plain_rules([(i, tokens[i]) for i, _ in rows], labels, 0.02, 0.5, 1.2, urls.COUNT)
    assert {k: v for k, v in got.items() if len(k) <= 3} == pytest.approx(want) and len(want) > 1
    best = {i: max((c for k, c in got.items() if set(k) <= set(t)), default=None) for i, t in tokens.items()}
    judged = urls.judge(pages, rules, []).collect()
    assert {x.page_id: x.rule_confidence for x in judged} == pytest.approx(best)
    assert all(x.verdict == ("allow" if best[x.page_id] is None else "block") for x in judged)


def test_rules_of_three_tokens_in_long_urls(spark):
    r = np.random.default_rng(21)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(40)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        path = [*r.choice(words[3:], int(r.integers(7, 13)), replace=False), *(words[:3] if bad else r.permutation(words[:3])[:2])]
        rows.append((i, "http://site.net/" + "/".join(r.permutation(path))))
        labels.append((i, bad))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = urls.mine(pages, spark.createDataFrame(labels, "page_id long, block boolean"))
    judged = {x.page_id: x.verdict for x in urls.judge(pages, rules, []).collect()}
    assert all(judged[i] == "block" for i, bad in labels if bad)
    assert sorted(f"p={w}" for w in words[:3]) in [x["items"] for x in rules.collect()]


def test_rules_in_long_urls_match_brute_force(spark):
    r = np.random.default_rng(22)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(32)]
    rows = [(i, "http://" + "/".join(["x.net", *r.choice(words, int(r.integers(12, 30)), replace=False)])) for i in range(60)]
    labels = [(i, bool(words[0] in u and words[1] in u and words[2] in u or r.random() < 0.15)) for i, u in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    tokens = {x.page_id: x.items for x in pages.select("page_id", urls.tokens(F.col("url")).alias("items")).collect()}
    got = {tuple(x["items"]): x.confidence for x in urls.mine(pages, spark.createDataFrame(labels, "page_id long, block boolean"), 0.12, 0.7, 1.2).collect()}
    want = plain_rules([(i, tokens[i]) for i, _ in rows], labels, 0.12, 0.7, 1.2, urls.COUNT)
    assert {k: v for k, v in got.items() if len(k) <= 3} == pytest.approx(want) and len(want) > 1


def test_long_urls_and_few_labels(spark):
    r = np.random.default_rng(13)
    words = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(200)]
    rows = [(i, "http://long.net/" + "/".join(r.permutation(words)[: 200 - 3 * i])) for i in range(12)] + [(20 + i, f"http://ok.net/{i}") for i in range(8)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 20) for i, _ in rows[:5] + rows[12:]], "page_id long, block boolean")
    judged = urls.judge(pages, urls.mine(pages, labels), []).collect()
    assert len(judged) == 21 and all(x.verdict == ("block" if x.page_id < 20 else "allow") for x in judged)


def test_transactions_keep_each_two_tokens(spark):
    df = spark.createDataFrame([([f"t{k:02}" for k in range(n)],) for n in (1, 9, 10, 11, 33)], "items array<string>")
    for n in (1, 9, 10, 11, 33):
        found = [set(x["items"]) for x in urls.transactions(df.where(F.size("items") == n)).collect()]
        assert all(len(x) <= 10 for x in found) and (n > 10 or len(found) == 1)
        assert all(any({f"t{a:02}", f"t{b:02}"} <= x for x in found) for a in range(n) for b in range(a, n))


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.08 * r.standard_normal((20, 16)), base[:5], np.repeat(base[:1], 30, axis=0), base[3:4] * 1e-30, base[4:5] * 1e30])
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, base[0].tolist(), None), (904, [], 1), (905, [1.0, None], 1)]
    df = spark.createDataFrame([(*t, "z") for t in rows + odd], "vec_id long, embedding array<double>, label int, digest string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([t[2] for t in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    comp = brute.united(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near), strict=True)])
    out = {t.vec_id: t for t in embeddings.near_duplicates(df).collect()}
    assert len(out) == len(rows) + len(odd)
    for i in range(len(x)):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[i].sum() - 1, comp[i], comp[i] == i)
    assert all((out[i].n_links, out[i].component_id) == (0, i) for i, *_ in odd)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    given = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, None), (4, [0.0, 0.0]), (None, [-1.0, 0.0]), (9, [-1.0, -1.0]), (8, [-1.0, -1.0]), (9, [1.0, -1.0])]
    rows = [(i, v, 1, "x") for i, v in given]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, digest string").repartition(3)).collect()
    fine = [k for k, (_, v) in enumerate(given) if v and any(v)]
    unit = {k: np.array(given[k][1]) / np.linalg.norm(given[k][1]) for k in fine}
    links = [(a, b) for a in fine for b in fine if a != b and unit[a] @ unit[b] >= 0.93]
    comp = brute.united(range(len(given)), links)
    low = {c: min((given[k][0] for k in range(len(given)) if comp[k] == c and given[k][0] is not None), default=None) for c in comp.values()}
    want = [(i, sum(a == k for a, _ in links), low[comp[k]], i == low[comp[k]]) for k, (i, _) in enumerate(given)]
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in out))) == sorted(map(str, want))


def test_table_plan_keeps_recall_at_every_size():
    for largest in (1, 1000, 10**5, 10**9):
        bits, tables = embeddings.plan(largest)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= embeddings.MISS


def test_quality_learns_and_scores_everything(spark):
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdef"), r.integers(2, 8))) for _ in range(300)]
    texts = [(" ".join(r.choice(words, 80)) if i % 3 else "BUY!!! " * int(r.integers(5, 60))) for i in range(300)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(rows[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300)]) > 0.95
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.learn(docs, labels.limit(0)).score(np.zeros((1, len(quality.NAMES))))[0] == 0.5


def test_trees_match_a_plain_walk():
    r = np.random.default_rng(14)
    x = r.standard_normal((400, 6))
    forest = quality.grow(x, ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float))
    scores = forest.score(x)
    for row, score in zip(x, scores, strict=True):
        margin = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < len(forest.feature[t]):
                node = 2 * node + (2 if row[forest.feature[t][node]] > forest.threshold[t][node] else 1)
            margin += forest.leaf[t][node - len(forest.feature[t])]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)))
    assert ((scores > 0.5) == ((x[:, 0] > 0.2) ^ (x[:, 3] > 0))).mean() > 0.95


def test_quality_of_repeated_ids_and_long_texts(spark):
    rows = [(1, "a b c"), (1, "x " * 200_000), (1, "a b c"), (2, "BUY!!! " * 50), (None, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit("z")).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    scored = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(scored) == 6 and len({round(x.score, 12) for x in scored}) >= 1
    assert quality.learn(docs, labels, 1).score(np.zeros((1, len(quality.NAMES)))).shape == (1,)

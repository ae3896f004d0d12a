"""Folds against unicodedata on every code point of the basic plane and on mixed texts; terms of answers."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text, unicode
from tallyloom.operators import textguard

squeezed = lambda x: " ".join(x.split())


def plain_compare(x):
    low = "".join({"I": "ı", chr(0x130): "i"}.get(c, c) for c in x).lower().replace("ı", "i")
    return squeezed(re.sub("[^a-z0-9]+", " ", re.sub("[" + chr(0x300) + "-" + chr(0x36F) + "]", "", unicodedata.normalize("NFD", low))))


PLAIN = {
    "course": (text.course_fold, lambda x: squeezed(unicodedata.normalize("NFKC", x).replace("I", "ı").replace(chr(0x130), "i").casefold())),
    "catalog": (text.catalog_fold, lambda x: squeezed(unicodedata.normalize("NFKC", x).casefold())),
    "compare": (text.compare_fold, plain_compare),
    "skill": (lambda c: F.array_join(text.skill_folds(F.array(c, c)), "|"), None),
    "case": (unicode.CASE, str.casefold),
}


def plain_skill(x):
    kept = "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
    return re.sub("[ \t\n\x0b\f\r]+", " ", kept).strip(" ")


PLAIN["skill"] = (PLAIN["skill"][0], lambda x: "|".join([plain_skill(x)] * 2))


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_folds(spark, name):
    r = np.random.default_rng(1)
    fold, plain = PLAIN[name]
    points = [chr(n) for n in range(1, 0x10000) if not 0xD800 <= n < 0xE000]
    some = ["a", "I", "İ", "i", "ı", "ß", "ﬁ", "Ş", "é", "é", "̇", " ", "\xa0", " ", "9", "-", "Σ", "K", "ǅ", "ŉ", "一", "𝐀", "ｱ", "Ĳ"]
    texts = [f"a{c}b" for c in points] + ["".join(r.choice(some, 8)) for _ in range(2000)] + ["", " ", "İ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {x.i: x.f for x in df.select("i", fold(F.col("t")).alias("f")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:5]


def test_latin_texts_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("Türk Dili ve Edebiyatı - ÇĞÖŞÜÂÎÛ 9",), ("Straße",), ("日",), ("ﬁ",)], "t string")
    for fold in (unicode.COURSE, unicode.CATALOG, unicode.COMPARE, unicode.CASE):
        quick = [r[0] for r in df.select(F.col("t").rlike(fold.latin)).collect()]
        assert quick[0] and not any(quick[2:]) and quick[1] == (fold is unicode.COMPARE), fold.rule


def test_evidence(spark):
    rows = [
        ('```json\n{"evidenceTerms": ["Söz Sanatları", " \\"ana-fikir\\". "]}\n``` and more', ["söz  sanat-\nları ve ANA - FİKİR", "x"]),
        ('{"evidenceTerms": ["a", "A"]}', ["a"]), ('{"evidenceTerms": ["a"]}', ["a"]), ('{"evidenceTerms": ["a", ""]}', ["a"]), ("none", ["a"]), (None, ["a"]),
        ('{"evidenceTerms": ["a", "' + "b" * 91 + '"]}', ["a"]), ('{"evidenceTerms": ["Straße", "yok"]}', ["STRASSE"]), ('{"evidenceTerms": ["Straße", "ana fikir"]}', ["STRASSE ana", "fikir"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, e array<string>").withColumn("t", textguard.evidence_terms(F.col("a")))
    got = {r.i: (r.t, r.g) for r in df.select("i", "t", textguard.grounded(F.col("t"), F.col("e")).alias("g")).collect()}
    assert got[0] == (["Söz Sanatları", "ana-fikir"], False)  # the dotted capital I has a mark of its own once folded
    assert [got[i][0] for i in range(1, 7)] == [None] * 6 and not any(got[i][1] for i in range(1, 8))
    assert got[8] == (["Straße", "ana fikir"], True)


def test_scope_looks_at_both_descriptions_without_case(spark):
    df = spark.createDataFrame([("ETKİNLİK".replace("İ", "i"), None, None), ("YAZMA BECERİ ss", None, None), ("Yazma\xa0becerisi ", "x", "YAZMA becerisi"), ("okuma becerisi", "x", None), ("TDE1.2 iyi", None, None)], "a string, d string, p string")
    fits = textguard.in_scope(F.col("a"), F.lit(0.4), F.array(F.lit("tde1.1")), F.lit("Speaking"), F.col("d"), F.col("p"))
    assert [r[0] for r in df.select(fits).collect()] == [False, False, True, False, False]

"""Checks of generated text before it goes into reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import json_text, text, unicode

# fixed values: forms that prescribe, claims that rates can't prove, words of action, words of other skills, codes, most words and characters of a term
PRESCRIBES = r"(?iu)öneri|tavsiye|telafi|gerekmekte|gerekiyor|\bgerekir\b|gereklid[ıi]r|ihtiyaç duyul|şartt[ıi]r|mal[ıi]d[ıi]r\b|melid[ıi]r\b|giderme|giderilme|gidermek|giderilmesi"
UNPROVEN = ["temel neden", "temel sebep", "nedeni", "sebebi", "kaynaklan", "öğrencilerin say", "öğrenci say", "yetersiz bilgi"]
ACTION = ["etkinlik", "aktivite", "alıştırma", "uygulama çalış", "telafi", "önerilir", "tavsiye", "yapılmalı", "verilmeli", "geliştirilmeli", "desteklenmeli", "gerekmektedir", "gereklidir", "ihtiyaç duyul"]
OTHER_SKILLS = {
    "listening": ["okuma beceri", "okuma strateji", "yazma beceri", "konuşma beceri", "mülakat yap", "mülakatta konuş", "söyleşi yap", "sözlü anlatım"],
    "speaking": ["okuma beceri", "yazma beceri", "dinleme/izleme beceri", "dinleme beceri"],
}
CODE = r"(?i)\b(TDE\d+(?:\.\d+)+)\b"
WEAK_WORDS, STRONG_WORDS, WEAK, TERM = 70, 60, 0.70, 90


def sentences(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")


def without_sentences(c: Column, pattern: str = PRESCRIBES) -> tuple[Column, Column]:
    """The text without sentences that match, and how many went."""
    every = sentences(c)
    kept = F.filter(every, lambda s: ~s.rlike(pattern))
    return F.trim(F.array_join(kept, " ")), F.size(every) - F.size(kept)


def in_scope(answer: Column, rate: Column, codes: Column, component: Column, *descriptions: Column) -> Column:
    """Whether an answer keeps the contract: length, no unproven claims or prescribed action, no foreign codes or skills.

    Words of other skills may stand where one of the outcome's descriptions (its own, its parent's) has them.
    """
    folded = text.case_fold(answer)
    chosen = text.case_fold(F.concat_ws(" ", *descriptions))
    short = text.word_count(answer) <= F.when(F.coalesce(rate, F.lit(0.0)) < WEAK, WEAK_WORDS).otherwise(STRONG_WORDS)
    has = lambda words: any_of([F.contains(folded, F.lit(w)) for w in words])
    other = F.lit(False)
    for name, words in OTHER_SKILLS.items():
        other = other | ((F.lower(component) == name) & any_of([F.contains(folded, F.lit(w)) & ~F.contains(chosen, F.lit(w)) for w in words]))
    return short & ~has(UNPROVEN + ACTION) & (F.size(foreign_codes(answer, codes)) == 0) & ~F.coalesce(other, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def foreign_codes(answer: Column, codes: Column, pattern: str = CODE) -> Column:
    """Codes that an answer mentions and that aren't among codes, in capitals, each once."""
    return F.array_except(F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), F.upper), F.transform(codes, F.upper))


def evidence_terms(answer: Column) -> Column:
    """The two terms of an answer's first JSON object, cleaned; null unless it has exactly two, of 1 to TERM characters, that differ.

    Code fences around the object and text after it are ignored.
    """
    terms = F.from_json(json_text.first_object(answer), "evidenceTerms array<string>")["evidenceTerms"]
    clean = F.transform(terms, lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^[ .,:;\"']+|[ .,:;\"']+$", ""))
    fine = (F.size(terms) == 2) & F.forall(clean, lambda t: F.coalesce((t != "") & (F.length(t) <= TERM), F.lit(False))) & (F.size(F.array_distinct(text.each_folded(clean, unicode.CASE))) == 2)
    return F.when(fine, clean)


def grounded(terms: Column, excerpts: Column) -> Column:
    """Whether terms are two distinct ones that the excerpts have, but for case, hyphens, line breaks and spaces."""
    every = text.evidence_fold(F.array_join(excerpts, " "))
    folded = F.array_distinct(text.evidence_folds(terms))
    there = F.zip_with(folded, F.array_repeat(every, F.size(folded)), lambda t, e: (t != "") & F.contains(e, t))  # a fold can't stand in a lambda
    return F.coalesce((F.size(terms) == 2) & (F.size(folded) == 2) & F.forall(there, lambda x: x), F.lit(False))


def findings(answers: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """The first most lines "- Soru n: text" of answers(exam, answer) whose question is in questions(exam, number), as one text."""
    lines = answers.select("exam", F.posexplode(F.split("answer", r"\r?\n")).alias("place", "line"))
    pattern = r"(?iu)^\s*-\s*Soru\s+(\d+)\s*:\s*(.+?)\s*$"
    parsed = lines.select("exam", "place", F.regexp_extract("line", pattern, 1).try_cast("int").alias("number"), F.regexp_extract("line", pattern, 2).alias("said")).where("number is not null")
    known = parsed.join(questions.select("exam", "number").distinct(), ["exam", "number"], "left_semi")
    first = known.withColumn("rank", F.row_number().over(Window.partitionBy("exam").orderBy("place"))).where(F.col("rank") <= most)
    line = F.concat(F.lit("- Soru "), F.col("number").cast("string"), F.lit(": "), F.col("said"))
    return first.groupBy("exam").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("findings"))

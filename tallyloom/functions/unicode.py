"""Folds that need Unicode's normal forms and full case folding, exact on all texts.

A text of Latin letters is folded in the JVM by one table, built by the fold's own rule for single characters; only other texts go to Python, in Arrow batches. A fold is given
as a function of a text, which must treat the table's characters one by one.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters below it are folded by table, but for those that a fold makes none or several of.
LATIN = 0x250
#: White space of a text as Python's split() sees it within the table's characters.
SPACE = r"[\s\x1c-\x1f\x85\xa0]+"


def course(text: str) -> str:
    """NFKC, Turkish capital I to dotless i, full case folding."""
    return unicodedata.normalize("NFKC", text).translate({ord("I"): "ı", 0x130: "i"}).casefold()


def catalog(text: str) -> str:
    """NFKC and full case folding, without the Turkish rule."""
    return unicodedata.normalize("NFKC", text).casefold()


def skill(text: str) -> str:
    """NFKD, full case folding, no combining marks; the dotless i stays."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def compare(text: str) -> str:
    """Turkish lower case, both i alike, NFD without the marks of its first block; other than a-z and 0-9 to spaces."""
    low = text.translate({ord("I"): "ı", 0x130: "i"}).lower().replace("ı", "i")
    return re.sub(r"[^a-z0-9]", " ", re.sub(r"[\u0300-\u036f]", "", unicodedata.normalize("NFD", low)))


def case(text: str) -> str:
    """Full case folding alone."""
    return text.casefold()


class Fold:
    """A fold as a Column expression; squeeze: runs of white space become one space, outer ones go."""

    def __init__(self, rule: Callable[[str], str], squeeze: bool = True):
        self.rule, self.squeeze = rule, squeeze
        single = {c: f for c in map(chr, range(LATIN)) if len(f := rule(c)) == 1}
        self.table = {c: f for c, f in single.items() if c != f}
        odd = "".join(f"\\x{{{n:x}}}" for n in range(LATIN) if chr(n) not in single)
        self.latin = rf"^[\x{{0}}-\x{{{LATIN - 1:x}}}&&[^{odd}]]*$" if odd else rf"^[\x{{0}}-\x{{{LATIN - 1:x}}}]*$"

    def of(self, text: str) -> str:
        """The fold of one text."""
        return " ".join(self.rule(text).split()) if self.squeeze else self.rule(text)

    def __getstate__(self):
        return {"rule": self.rule, "squeeze": self.squeeze}  # what a task needs

    @functools.cached_property
    def exact(self):
        """The fold in Python; made when it is first used, as that needs a session."""
        of = self.of

        def run(texts: pd.Series) -> pd.Series:
            done = {None: None}
            return texts.map(lambda t: done[t] if t in done else done.setdefault(t, of(t)))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "string")

    def __call__(self, c: Column) -> Column:
        plain = c.rlike(self.latin)
        quick = F.translate(c, "".join(self.table), "".join(self.table.values()))
        if self.squeeze:
            quick = F.trim(F.regexp_replace(quick, SPACE, " "))
        return F.when(plain, quick).otherwise(self.exact(F.when(~plain, c)))


COURSE, CATALOG, SKILL, COMPARE, CASE = Fold(course), Fold(catalog), Fold(skill, squeeze=False), Fold(compare), Fold(case, squeeze=False)

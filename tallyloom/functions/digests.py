"""Digests, content ids and checksums as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import json_text

# fixed value: the name space of chunk ids
CHUNKS = uuid.UUID("59b00b86-86ac-5690-b5e5-af5ffc2604d1")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as 8 hexadecimal digits."""
    return json_text.fnv1a_texts(text)


def uuid5(name: Column, space: uuid.UUID = CHUNKS) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), name.cast("binary")))
    digit = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), digit, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(program: Column, document: Column, index: Column, text: Column) -> Column:
    return uuid5(F.concat_ws("|", program, document, index.cast("string"), text))


def national_id(c: Column) -> Column:
    """Whether a text is an 11-digit Turkish identity number: no leading zero, both check digits right."""
    d = [F.substring(c, i, 1).try_cast("int") for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    tenth, last = F.pmod(odd * 7 - even, F.lit(10)), (odd + even + d[9]) % 10
    return F.coalesce(c.rlike(r"^[1-9]\d{10}$") & (d[9] == tenth) & (d[10] == last), F.lit(False))


def full_name(c: Column) -> Column:
    """Whether a cell looks like a person's name: no digits, two words or more, five letters or more."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.coalesce(~c.rlike(r"\d") & (F.size(words) >= 2) & (F.length(F.array_join(words, "")) >= 5), F.lit(False))

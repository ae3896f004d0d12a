"""Text and number functions of assessment data, as Column expressions.

Each fold serves one comparison; they differ on purpose in how they treat the Turkish i and may not be exchanged. Unless said
otherwise null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import unicode

# fixed values: letters that folds map, and heading labels after label_fold
TURKISH, ASCII = "ÇĞİÖŞÜçğıöşü", "CGIOSUcgiosu"
STUDENT_NUMBER = ["okul no", "okul numarasi", "ogrenci no", "ogrenci numarasi", "numara", "no"]
NAME = ["ad soyad", "adi soyadi", "ogrenci ad soyad", "ogrenci adi soyadi"]
NATIONAL_ID = ["tc kimlik no", "t c kimlik no", "tc kimlik numarasi", "t c kimlik numarasi", "tckn"]


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def label_fold(c: Column) -> Column:
    """Turkish letters to ASCII, lower case, other than a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, TURKISH, ASCII)), "[^a-z0-9]+", " "))


def course_fold(c: Column) -> Column:
    """Turkish case folding (I to dotless i) of compatibility forms, and single spaces; null is empty."""
    return unicode.COURSE(F.coalesce(c, F.lit("")))


def catalog_fold(c: Column) -> Column:
    """Case folding of compatibility forms without the Turkish rule, and single spaces; null is empty."""
    return unicode.CATALOG(F.coalesce(c, F.lit("")))


def compare_fold(c: Column) -> Column:
    """Turkish lower case, accents dropped, both i alike, other than a-z and 0-9 to single spaces."""
    return unicode.COMPARE(c)


def each_folded(texts: Column, fold: Callable[[Column], Column]) -> Column:
    """The texts of an array folded by a fold that can't stand in a lambda; the texts have no U+0000, and null ones are empty."""
    return F.when(F.size(texts) > 0, F.split(fold(F.array_join(texts, "\x00", "")), "\x00")).otherwise(F.array().cast("array<string>"))


def skill_folds(skills: Column) -> Column:
    """An array of skills without case, accents and outer or repeated spaces; the dotless i stays."""
    return F.transform(each_folded(skills, unicode.SKILL), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def theme_upper(c: Column) -> Column:
    """Theme without its leading number ("1. Tema: x"), in Turkish upper case."""
    return F.upper(F.translate(F.trim(F.regexp_replace(c, r"(?i)^\s*\d+\.\s*Tema\s*:\s*", "")), "iı", "İI"))


def theme_key(c: Column) -> Column:
    """Upper case without any white space: PDF text has stray spaces in themes."""
    return F.regexp_replace(F.upper(c), r"\s+", "")


def grade_label(c: Column) -> Column:
    """The number of a heading like "9. SINIF"; the preparatory class otherwise."""
    found = F.regexp_extract(c, r"(?iu)^\s*(\d+)\.\s*s[ıi]n[ıi]f", 1)
    return F.when(found != "", found).otherwise(F.lit("hazırlık"))


def grade_base(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?iu)\.\s*s[ıi]n[ıi]f$", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def question_number(label: Column) -> Column:
    """Of a folded heading like "s 3" or "soru 3"; else null."""
    return F.nullif(F.regexp_extract(label, r"^(?:s|soru)\s*(\d+)\b", 1), F.lit("")).cast("int")


def max_score(heading: Column) -> Column:
    """Of a heading like "Soru 3 (25p)" or "12,5 puan"; else null."""
    found = F.regexp_extract(heading, r"(?i)(?:\(|\b)(\d+(?:[.,]\d+)?)\s*(?:p|puan)\b", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def lenient_number(c: Column) -> Column:
    """The first number in a text, comma or point; null without one."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"-?\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def strict_number(c: Column) -> Column:
    """The number that a whole text is, comma or point; else null."""
    clean = F.replace(F.trim(c), F.lit(","), F.lit("."))
    return F.when(clean.rlike(r"^-?\d+(\.\d+)?$"), clean.try_cast("double"))


def given_number(c: Column, default: Column | None = None) -> Column:
    """A number with comma or point; default for null and blank; null for what isn't a finite number."""
    value = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)
    return F.when(F.coalesce(c, F.lit("")) == "", default if default is not None else F.lit(None).cast("double")).otherwise(value)


def is_student_number(label: Column) -> Column:
    return label.isin(STUDENT_NUMBER)


def is_name(label: Column) -> Column:
    return label.isin(NAME)


def is_national_id(label: Column) -> Column:
    return label.isin(NATIONAL_ID)


def is_total(label: Column) -> Column:
    return (label == "puan") | label.startswith("toplam") | (label == "genel toplam")


def percent_text(rate: Column) -> Column:
    """%dd.dd."""
    return F.format_string("%%%.2f", rate * 100)


def turkish_number(c: Column, places: int = 2) -> Column:
    """Point between thousands, comma before the fraction; the fraction only where there is one."""
    text = F.translate(F.format_number(c, places), ",.", ".,")
    return F.when(F.abs(c - F.round(c)) > 0.001, text).otherwise(F.translate(F.format_number(c, 0), ",", "."))


def turkish_percent(c: Column) -> Column:
    """A rate (at most 1 in size) or a percentage, with % before it."""
    return F.concat(F.lit("%"), turkish_number(F.round(F.when(F.abs(c) <= 1, c * 100).otherwise(c), 2)))


def duration_text(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.translate(F.format_number(ms / 1000, 1), ",.", ".,"), F.lit(" sn"))).otherwise(F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit(" ms")))


def any_date(c: Column) -> Column:
    """A date given as yyyy-MM-dd or as dd.MM.yyyy with points, slashes or hyphens."""
    turned = F.regexp_replace(F.trim(c), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", "$3-$2-$1")
    return turned.try_cast("date")


def turkish_date(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def word_count(c: Column) -> Column:
    """Words of letters and digits of any script, an apostrophe and what follows it included."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\w+(?:['’]\w+)?\b"))


def evidence_fold(c: Column) -> Column:
    """Without case and hyphens (with the white space around them, as at line ends), single spaces."""
    return _squeezed(F.regexp_replace(unicode.CASE(c), r"(?U)\s*-\s*", ""))


def evidence_folds(texts: Column) -> Column:
    """evidence_fold() of each text of an array."""
    return F.transform(each_folded(texts, unicode.CASE), lambda t: _squeezed(F.regexp_replace(t, r"(?U)\s*-\s*", "")))


def case_fold(c: Column) -> Column:
    """Full case folding, and single spaces."""
    return _squeezed(unicode.CASE(c))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def suffix(c: Column) -> Column:
    """The extension in lower case, without its point; empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]+)$", 1))


def useful(c: Column) -> Column:
    """Has a letter or digit and is no placeholder."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~F.lower(F.trim(c)).isin("null", "undefined", "nan", "none"), F.lit(False))


def institution(c: Column) -> Column:
    """Trimmed; empty for what isn't useful or is only a number."""
    return F.when(useful(c) & ~F.trim(c).rlike(r"^\d+$"), F.trim(c)).otherwise(F.lit(""))


def first_useful(*columns: Column) -> Column:
    return F.coalesce(*[F.when(useful(c), F.trim(c)) for c in columns])


def joined(columns: list[Column], by: str = " — ") -> Column:
    """The non-empty ones, joined."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in columns]), lambda x: x != ""), by)


def clamp(c: Column, low: int = 1, high: int = 20) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def outcome_key(key: Column, theme: Column, code: Column, number: Column) -> Column:
    """A given key, else theme and code joined by a bar (blank ones left out), else "Soru" and the number."""
    pair = F.array_join(F.filter(F.array(F.trim(F.coalesce(theme, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))), lambda x: x != ""), " | ")
    return F.coalesce(blank_to_null(key), F.nullif(pair, F.lit("")), F.concat(F.lit("Soru "), number.cast("string")))


def checked_option(c: Column) -> Column:
    """What stands after a ticked box; null if no box is ticked."""
    return blank_to_null(F.regexp_extract(c, r"[☒☑✓✔■]\s*([^☐☒☑✓✔■□]+)", 1))

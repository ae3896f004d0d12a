"""Rules with a code and a severity over rows, and what they find; quality verdicts and file checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import digests, text

# fixed values: form of student references; largest gap between a total and the sum of its scores; files taken
STUDENT_REF = r"^Ö-\d{3,}$"
TOLERANCE = 0.01
SUFFIXES = ["csv", "docx", "jpeg", "jpg", "pdf", "png", "xls", "xlsx"]
MAX_BYTES, MAX_FILES = 20 * 1024 * 1024, 10


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    broken: Column


def issues(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row (keys, code, severity) for each rule that a row breaks; a rule that is null for a row isn't broken."""
    found = F.filter(F.array(*[F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("issue")).select(*keys, "issue.code", "issue.severity")


def student_rules(scores: str = "scores", most: str = "max_scores", total: str = "total", ref: str = "student_ref") -> list[Rule]:
    """Rules for approved rows: reference, number of scores, their range, the total."""
    outside = F.exists(F.zip_with(scores, most, lambda s, m: s.isNull() | F.isnan(s) | (s < 0) | (s > m)), lambda x: F.coalesce(x, F.lit(True)))
    added = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return [
        Rule("STUDENT_REF", "error", ~F.coalesce(F.col(ref).rlike(STUDENT_REF), F.lit(False))),
        Rule("SCORE_COUNT", "error", F.size(scores) != F.size(most)),
        Rule("SCORE_RANGE", "error", outside),
        Rule("TOTAL_MISMATCH", "error", F.abs(F.col(total) - added) > TOLERANCE),
    ]


def repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose keys an earlier row in the order has."""
    if set(rows.columns) == set(keys):  # rows of a key are alike: they are counted, not put in order
        again = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
        return again.select(*rows.columns, F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("_place")).drop("_place")
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place > 1").drop("_place")


def unknown(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows that refer to nothing in known."""
    return rows.join(known, on, "left_anti")


def file_issues(files: DataFrame) -> DataFrame:
    """Issues of files(name, size): extension, size, emptiness."""
    ok = text.suffix(F.col("name")).isin(SUFFIXES)
    return issues(files, ["name"], [Rule("EXTENSION", "error", ~ok), Rule("TOO_LARGE", "error", F.col("size") > MAX_BYTES), Rule("EMPTY", "error", F.col("size") == 0)])


def verdict(errors: Column, warnings: Column) -> Column:
    """State of a document from whether it has errors and warnings."""
    return F.when(errors, "manual-completion-required").when(warnings, "teacher-review-required").otherwise(F.lit("ready-for-teacher-review"))


def quality(students: DataFrame) -> DataFrame:
    """Per document: rows, empty cells, totals off by more than the tolerance, kinds of personal data found, state.

    students(document, scores array<double>, total, calculated_total, findings array<string>).
    """
    empty = F.sum(F.size(F.filter("scores", lambda x: x.isNull())))
    off = F.count_if(F.abs(F.col("total") - F.col("calculated_total")) > TOLERANCE)
    out = students.groupBy("document").agg(F.count("*").alias("row_count"), empty.alias("empty_cells"), off.alias("mismatches"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"))  # sets of kinds are few
    return out.withColumn("state", verdict(F.col("row_count") == 0, (F.col("empty_cells") > 0) | (F.col("mismatches") > 0) | (F.size("findings") > 0)))


def without_personal_data(cells: Column) -> tuple[Column, Column]:
    """Cells of a row without national ids and names, and which kinds were there."""
    is_id, is_name = lambda c: digests.national_id(F.regexp_replace(c, r"\D", "")), lambda c: digests.full_name(c)
    safe = F.filter(cells, lambda c: ~is_id(c) & ~is_name(c))
    found = F.filter(F.array(F.when(F.exists(cells, is_id), F.lit("TCKN")), F.when(F.exists(F.filter(cells, lambda c: ~is_id(c)), is_name), F.lit("AD_SOYAD"))), lambda x: x.isNotNull())
    return safe, found


def positional_rows(rows: DataFrame) -> DataFrame:
    """Rows (row_id, student_no, scores, total, calculated_total, findings) from rows(row_id, cells): personal data goes before positions count."""
    safe, found = without_personal_data(F.col("cells"))
    kept = rows.select("row_id", safe.alias("safe"), found.alias("findings")).where(F.size("safe") >= 2)
    scores = F.transform(F.slice("safe", 2, F.size("safe") - 2), text.strict_number)
    out = kept.select("row_id", F.trim(F.element_at("safe", 1)).alias("student_no"), scores.alias("scores"), text.strict_number(F.element_at("safe", -1)).alias("total"), "findings")
    added = F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 2)
    blank = (F.col("student_no") == "") & F.col("total").isNull() & F.forall("scores", lambda x: x.isNull())
    return out.where(~blank).withColumn("calculated_total", added)


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Paths of columns, nested ones too, with one of names."""
    found: list[str] = []

    def walk(schema, path: str) -> None:
        for field in getattr(schema, "fields", []):
            at = f"{path}.{field.name}".lstrip(".")
            if field.name in names:
                found.append(at)
            kind = field.dataType
            while hasattr(kind, "elementType"):
                kind = kind.elementType
            walk(kind, at)

    walk(df.schema, "")
    return found

"""Uploads of an exam: how files are read, what several uploads say together, who took part, and what a report carries on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import ordered
from tallyloom.operators.rules import STUDENT_REF

# fixed values: suffixes of images and of files with readable tables; characters that make a text layer, in so many first pages; attendance that means absent; fields that make a known form
IMAGES, TABLES = ["jpg", "jpeg", "png"], ["docx", "xlsx"]
LAYER, PAGES = 40, 3
ABSENT = ["g", "girmedi", "katılmadı", "katilmadi", "yok"]
KNOWN_FIELDS = 5


def text_layers(pages: DataFrame) -> DataFrame:
    """path, layer: whether the first PAGES pages of pages(path, page from 1, text) have LAYER characters or more that aren't white space."""
    many = F.sum(F.when(F.col("page") <= PAGES, F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+", ""))).otherwise(0))
    return pages.groupBy("path").agg((many >= LAYER).alias("layer"))


def routed(files: DataFrame, layers: DataFrame) -> DataFrame:
    """upload, kind, needs_ocr, can_read of uploads with files(upload, path): image-group if all are images; of single files native-table-document, text-pdf or scanned-pdf (by layers(path, layer)); else
    other-document."""
    suffix = text.suffix(F.coalesce("path", F.lit("")))
    rows = files.select("upload", "path", suffix.alias("suffix")).join(layers, "path", "left")
    out = rows.groupBy("upload").agg(F.count("*").alias("n"), F.bool_and(F.col("suffix").isin(IMAGES)).alias("images"), F.max("suffix").alias("suffix"), F.max(F.coalesce("layer", F.lit(False))).alias("layer"))
    one = F.col("n") == 1
    kind = F.when(F.col("images"), "image-group").when(one & F.col("suffix").isin(TABLES), "native-table-document").when(one & (F.col("suffix") == "pdf"), F.when(F.col("layer"), "text-pdf").otherwise(F.lit("scanned-pdf"))).otherwise(F.lit("other-document"))
    return out.select("upload", kind.alias("kind"), kind.isin("image-group", "scanned-pdf").alias("needs_ocr"), (kind != "scanned-pdf").alias("can_read"))


def merged_fields(uploads: DataFrame, fields: str = "fields") -> DataFrame:
    """exam, field, value of uploads(exam, place, fields map<string, string>): of equal fields that of the latest upload, also where it is null or empty."""
    rows = uploads.select("exam", "place", F.explode(fields).alias("field", "value"))
    return rows.groupBy("exam", "field").agg(F.max_by(F.struct("value"), "place").alias("s")).select("exam", "field", "s.value")


def merged_students(uploads: DataFrame) -> DataFrame:
    """exam, number (from 1), student, source of uploads(exam, place, file, students array<struct<student: string, source: string>>): one after the other; a student without a source is of its upload's file."""
    rows = uploads.select("exam", "place", "file", F.posexplode("students").alias("row", "s"))
    rows = ordered.running(rows, ["exam"], ["place", "row"], F.lit(1), "number")
    return rows.select("exam", "number", F.col("s.student").alias("student"), F.coalesce(text.blank_to_null(F.col("s.source")), F.col("file")).alias("source"))


def participating(students: DataFrame, attendance: str = "attendance") -> DataFrame:
    """students without those whose attendance says that they weren't there; a blank one was."""
    said = F.lower(F.translate(F.trim(F.regexp_replace(F.coalesce(F.col(attendance), F.lit("")), r"\s+", " ")), "Iİ", "ıi"))
    return students.where(~said.isin(ABSENT))


def document_type(fields: list[Column], mode: Column) -> Column:
    """What an upload is: a known form if KNOWN_FIELDS of its exam's fields say anything, else by how it came: an unrecognized-template, a handwritten-table or a score-table."""
    known = sum((F.when(text.useful(f), 1).otherwise(0) for f in fields), F.lit(0))
    return F.when(known >= KNOWN_FIELDS, "template").when(mode == "template", "unrecognized-template").when(mode == "manual", "handwritten-table").otherwise(F.lit("score-table"))


def titled(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """documents(program, override) with title: the override, trimmed, else that of titles(program, title); a document that has neither fails the job before anything is indexed.

    titles has one row for each program and is a small dimension.
    """
    known = F.broadcast(titles.select(F.col("program").alias("_p"), text.blank_to_null(F.col("title")).alias("_t")))
    rows = documents.join(known, F.col("program") == F.col("_p"), "left")
    title = F.coalesce(text.blank_to_null(F.col("override")), F.col("_t"))
    missing = F.raise_error(F.concat(F.lit("no title for program "), F.coalesce("program", F.lit("null"))))
    return rows.withColumn("title", F.when(title.isNull(), missing.cast("string")).otherwise(title)).drop("_p", "_t")


def cohort_evidence(students: DataFrame) -> DataFrame:
    """exam, cohort (student_ref, total, sorted) of students(exam, student_ref, total): what a report carries on of its students, which is nothing of those without a pseudonym or a finite total."""
    ref = F.trim(F.regexp_replace("student_ref", r"\s+", " "))
    kept = students.select("exam", ref.alias("student_ref"), "total").where(F.col("student_ref").rlike(STUDENT_REF) & F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < float("inf")))
    return kept.groupBy("exam").agg(F.array_sort(F.collect_list(F.struct("student_ref", "total"))).alias("cohort"))  # an exam's students


def portable(exams: DataFrame, students: DataFrame, fields: dict[str, list[str]], schema: str, version: int = 1) -> DataFrame:
    """exam, report (JSON): of exams(exam, ...) the fields (each the first of its aliases that says anything, else empty) and cohort_evidence(); other columns stay behind."""
    names = {c.lower(): c for c in exams.columns}

    def value(aliases: list[str]) -> Column:
        held = [F.col(names[a.lower()]).cast("string") for a in aliases if a.lower() in names]
        return F.coalesce(text.first_useful(*held), F.lit("")) if held else F.lit("")

    rows = exams.join(cohort_evidence(students), "exam", "left")
    body = F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("schemaVersion"), F.struct(*[value(a).alias(k) for k, a in fields.items()]).alias("exam"), F.struct(F.coalesce("cohort", F.array().cast("array<struct<student_ref: string, total: double>>")).alias("cohortEvidence")).alias("analysis"))
    return rows.select("exam", F.to_json(body).alias("report"))


def titles(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(known.items()), "program string, title string")

"""Routing, merging and typing of uploads, titles, and what reports carry on."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import uploads


def test_routing(spark):
    pages = [("a.pdf", 1, "x" * 39), ("a.pdf", 4, "y" * 99), ("b.PDF", 1, " x \n" * 20), ("b.PDF", 3, "z" * 20), ("c.pdf", 1, None)]
    layers = uploads.text_layers(spark.createDataFrame(pages, "path string, page int, text string"))
    assert {r.path: r.layer for r in layers.collect()} == {"a.pdf": False, "b.PDF": True, "c.pdf": False}
    files = [(1, "a.pdf"), (2, "b.PDF"), (3, "x.png"), (3, "y.JPG"), (4, "x.png"), (4, "y.docx"), (5, "y.docx"), (6, "z.xls"), (7, None), (8, "d.pdf")]
    got = {r.upload: (r.kind, r.needs_ocr, r.can_read) for r in uploads.routed(spark.createDataFrame(files, "upload int, path string"), layers).collect()}
    other = ("other-document", False, True)
    assert got == {1: ("scanned-pdf", True, False), 2: ("text-pdf", False, True), 3: ("image-group", True, True), 4: other, 5: ("native-table-document", False, True), 6: other, 7: other, 8: ("scanned-pdf", True, False)}


def test_merging(spark):
    rows = [("e", 2, "g", {"a": "2", "b": ""}, [("s3", None)]), ("e", 1, "f", {"a": "1", "c": "x"}, [("s1", " "), ("s2", "own")]), ("f", 1, "h", {}, []), ("e", 3, "k", None, None)]
    df = spark.createDataFrame(rows, "exam string, place int, file string, fields map<string, string>, students array<struct<student: string, source: string>>")
    assert sorted(map(tuple, uploads.merged_fields(df).collect())) == [("e", "a", "2"), ("e", "b", ""), ("e", "c", "x")]
    assert sorted((r.number, r.student, r.source) for r in uploads.merged_students(df).collect()) == [(1, "s1", "f"), (2, "s2", "own"), (3, "s3", "g")]


def test_attendance_and_types(spark):
    df = spark.createDataFrame([("G",), (" KATILMADI",), ("Katılmadı",), ("YOK",), ("girdi",), (None,), ("",)], "attendance string")
    assert sorted(str(r[0]) for r in uploads.participating(df).collect()) == ["", "None", "girdi"]
    one = lambda n, mode: spark.range(1).select(uploads.document_type([F.lit("x")] * n + [F.lit("null"), F.lit(None)], F.lit(mode))).first()[0]
    assert [one(5, None), one(4, "template"), one(4, "manual"), one(0, None)] == ["template", "unrecognized-template", "handwritten-table", "score-table"]


def test_titles(spark):
    known = uploads.titles(spark, {"p": " The book ", "q": " "})
    docs = spark.createDataFrame([("p", " "), ("p", " Mine "), ("q", "Own"), (None, "z")], "program string, override string")
    assert sorted(r.title for r in uploads.titled(docs, known).collect()) == ["Mine", "Own", "The book", "z"]
    with pytest.raises(Exception, match="no title for program q"):
        uploads.titled(spark.createDataFrame([("q", None)], "program string, override string"), known).collect()


def test_portable_reports(spark):
    exams = spark.createDataFrame([("a", "null", "Fizik", "secret"), ("b", None, None, "s")], "exam string, courseName string, course string, fullName string")
    students = spark.createDataFrame([("a", " Ö-002", 5.0), ("a", "Ö-001", 7.0), ("a", "Ali", 3.0), ("a", "Ö-003", float("nan")), ("a", "Ö-004", None), ("a", None, 1.0)], "exam string, student_ref string, total double")
    got = {r.exam: json.loads(r.report) for r in uploads.portable(exams, students, {"courseName": ["courseName", "course"], "term": ["term"]}, "x").collect()}
    assert got["a"] == {"schema": "x", "schemaVersion": 1, "exam": {"courseName": "Fizik", "term": ""}, "analysis": {"cohortEvidence": [{"student_ref": "Ö-001", "total": 7.0}, {"student_ref": "Ö-002", "total": 5.0}]}}
    assert got["b"]["analysis"]["cohortEvidence"] == [] and "secret" not in json.dumps(got)

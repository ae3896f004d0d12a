"""Three types of documents, from real files to exams, questions, students and warnings."""

import io
import zipfile

import pytest

from tallyloom.sources import readers, semantic

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*tables):
    cell = lambda c: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in c.split("\n")) + "</w:tc>"
    body = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


EXAM = [["İl", "Ankara", "İlçe", "Çankaya"], ["Okul Adı", " X\nLisesi ", "Ders", ""], ["Dersin Adı", "Fizik", "Dönem", "☐ 1. ☒ 2."], ["Sınav Türü", "Yazılı", "Toplam Puan", "100,5"], ["İl", "Bursa", "alone"]]
HEAD = ["Sıra No", "Okul No", "Adı Soyadı", "Soru 1", "S2 (10p)", "TOPLAM"]


@pytest.fixture(scope="module")
def found(spark):
    files = {
        "class.docx": docx([["nothing", "here"]], EXAM, [["Soru No", "Kod", "Öğrenme Çıktısı", "Azami Puan"], ["1", "K1", "", "10"], ["", "", "çıktı", "12,5"], ["", "", "", ""], ["0", "", "", "5"]], [HEAD, ["1", "101", "Ali Veli", "8", "7,5", "15.5"], ["", "", "Gizli Ad", "", "", ""], ["x", "", "", "", "3", "4"]]),
        "heads.docx": docx([["No", "Soru 2", "Soru 1", "T.C. Kimlik No"], ["7", "1", "2", "10000000146"], ["8", "", "5", ""]]),
        "sheet.docx": docx([["Öğrencinin Adı Soyadı", "Gizli Ad", "Öğrenci Okul No", "202"]], [["Sorular", "Soru 1", "Soru 2", "Toplam"], ["Azami Puan", "40", "60"], ["Öğrencinin Aldığı Puan", "30", "", "35"]]),
        "sheet2.docx": docx([["Sorular", "Soru 1"], ["Azami Puan", "40"], ["Öğrencinin Aldığı Puan", ""]]),
        "other.docx": docx([["a", "b"], ["c"]]),
        "empty.docx": docx(),
        "broken.docx": b"no zip",
    }
    cells = readers.cells(spark.createDataFrame(list(files.items()), "path string, content binary"))
    read = semantic.read(semantic.documents(cells)).cache()
    return {r.path: r for r in read.collect()}, {p: sorted((r.code, r.place or 0) for r in semantic.warnings(read).where(f"path = '{p}'").collect()) for p in files}


def numbers(r):
    return [(q.number, q.outcome_code, q.outcome_description, q.max_score) for q in r.questions]


def test_class_document(found):
    r, warned = found[0]["class.docx"], found[1]["class.docx"]
    assert r.document_type == "class-score-template"
    e = r.exam
    assert (e.province, e.district, e.schoolName, e.course, e.term, e.examType, e.totalMaxScore, e.teacherName) == ("Bursa", "Çankaya", "X Lisesi", "Fizik", "2.", "Yazılı", 100.5, "")
    assert e.verified == ["province", "district", "schoolName"]
    assert numbers(r) == [(1, "K1", "", 10.0), (2, "", "çıktı", 12.5), (3, "", "", 5.0)]
    assert [(s.row_number, s.student_no, s.scores, s.total, s.calculated_total) for s in r.students] == [(1, "101", [8.0, 7.5], 15.5, 15.5), (None, "", [None, 3.0], 4.0, 3.0)]
    assert "Gizli" not in repr(r) and "Ali" not in repr(r)
    assert warned == [("NAME_LEFT_OUT", 0), ("NO_OUTCOME", 3), ("TOTAL_MISMATCH", 0)]


def test_questions_from_headings(found):
    r, warned = found[0]["heads.docx"], found[1]["heads.docx"]
    assert numbers(r) == [(2, "", "", None), (1, "", "", None)] and {q.source for q in r.questions} == {"score-column-heading"}
    assert [(s.row_number, s.student_no, s.scores, s.total) for s in r.students] == [(1, "7", [1.0, 2.0], None), (2, "8", [None, 5.0], None)]
    assert warned == [("MAXIMA_NOT_IN_SHEET", 0), ("NATIONAL_ID_LEFT_OUT", 0), ("NO_COURSE", 0), ("OUTCOMES_NOT_IN_SHEET", 0)]


def test_sheets_of_one_student(found):
    r, warned = found[0]["sheet.docx"], found[1]["sheet.docx"]
    assert r.document_type == "single-student-score-sheet" and numbers(r) == [(1, "", "", 40.0), (2, "", "", 60.0)]
    assert [(s.row_number, s.student_no, s.scores, s.total, s.calculated_total) for s in r.students] == [(1, "202", [30.0, None], 35.0, 30.0)]
    assert "Gizli" not in repr(r) and warned == [("NAME_LEFT_OUT", 0), ("NO_COURSE", 0), ("OUTCOMES_NOT_IN_SHEET", 0), ("TOTAL_MISMATCH", 1)]
    assert found[0]["sheet2.docx"].students == []


def test_other_documents(found):
    for name in ("other.docx", "empty.docx", "broken.docx"):
        r = found[0][name]
        assert (r.document_type, r.questions, r.students, r.exam.course) == ("unclassified", [], [], "")
        assert found[1][name] == [("NOT_TOLD_APART", 0), ("NO_COURSE", 0), ("NO_QUESTIONS", 0), ("NO_STUDENTS", 0)]

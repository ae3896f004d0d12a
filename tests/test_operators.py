"""Measures, rules, reports, corrections, retrieval, guards, sources and streams over small tables with known results."""

import base64
import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import bands, digests, json_text, text
from tallyloom.operators import backups, corrections, measure, programs, reports, retrieval, rules, textguard
from tallyloom.sources import readers, tables
from tallyloom.streaming import events


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def values(spark, many, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(many)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


# four questions with a maximum of 10, three students: 17, 21, 18 and 24 of 30
SCORES = [(8, 6, 7, 5), (6, 6, 7, 9), (3, 9, 4, 10)]


@pytest.fixture(scope="module")
def exam(spark):
    scores = spark.createDataFrame([("e", s, q, float(v)) for s, row in enumerate(SCORES) for q, v in zip((2, 5, 8, 9), row, strict=True)], "exam string, student int, question int, score double")
    questions = spark.createDataFrame([("e", q, 10.0, ["OB3"] if q == 9 else ["OB2"]) for q in (2, 5, 8, 9)], "exam string, question int, max_score double, outcomes array<string>")
    students = spark.createDataFrame([("e", s) for s in range(3)], "exam string, student int")
    return scores, questions, students


def test_golden_exam(exam):
    scores, questions, students = exam
    totals = measure.question_totals(scores, questions, students)
    assert [(r.question, r.earned, r.possible) for r in totals.orderBy("question").collect()] == [(2, 17.0, 30.0), (5, 21.0, 30.0), (8, 18.0, 30.0), (9, 24.0, 30.0)]
    links = measure.equal_links(questions)
    outcomes = {r.outcome: r for r in measure.outcome_totals(totals, links).collect()}
    assert (outcomes["OB2"].earned, outcomes["OB2"].possible, outcomes["OB3"].earned) == (56.0, 90.0, 24.0)
    assert outcomes["OB3"].level == "Beklenen düzeyde gelişmiş"
    corrected = exam[0].sparkSession.createDataFrame([("e", 2, 2), ("e", 9, 1)], "exam string, question int, cells int")
    found = {r.outcome: r for r in measure.evidence(totals, links, corrected).collect()}
    assert [q.question for q in found["OB2"].questions] == [2, 5, 8] and found["OB2"].corrected_cells == 2
    assert sum(q.earned for q in found["OB2"].questions) == 56.0
    summary = measure.class_summary(measure.student_totals(scores), F.lit(40.0)).first()
    assert round(summary.average, 2) == 26.67 and summary.least == 26.0 and summary.passed == 3


def test_two_outcomes_share_a_question(spark):
    questions = spark.createDataFrame([("e", 1, 50.0, ["A", "B"]), ("e", 2, 50.0, ["A"])], "exam string, question int, max_score double, outcomes array<string>")
    scores = spark.createDataFrame([("e", s, q, float(v)) for s, q, v in [(1, 1, 40), (1, 2, 30), (2, 1, 20), (2, 2, 10)]], "exam string, student int, question int, score double")
    students = spark.createDataFrame([("e", 1), ("e", 2)], "exam string, student int")
    out = measure.outcome_totals(measure.question_totals(scores, questions, students), measure.equal_links(questions))
    assert {r.outcome: (r.earned, r.possible) for r in out.collect()} == {"A": (70.0, 150.0), "B": (30.0, 50.0)}


def test_questions_without_scores_or_students(spark):
    questions = spark.createDataFrame([("e", 1, 5.0), ("empty", 1, 5.0)], "exam string, question int, max_score double")
    scores = spark.createDataFrame([("e", 1, 1, None)], "exam string, student int, question int, score double")
    students = spark.createDataFrame([("e", 1), ("e", 2)], "exam string, student int")
    out = {r.exam: r for r in measure.question_totals(scores, questions, students).collect()}
    assert (out["e"].earned, out["e"].possible, out["e"].rate) == (0.0, 10.0, 0.0) and out["empty"].rate == 0.0


def test_answer_keys(spark):
    questions = spark.createDataFrame([("e", q, k, 10.0) for q, k in ((1, "B"), (2, "A"), (3, "C"))], "exam string, question int, answer_key string, max_score double")
    students = spark.createDataFrame([("e", s) for s in (1, 2, 3)], "exam string, student int")
    answers = [("e", s, q, a) for s, row in ((1, "bAC"), (2, "BC "), (3, "AAC")) for q, a in enumerate(row, 1)]
    scores = measure.answer_scores(spark.createDataFrame(answers, "exam string, student int, question int, answer string"), questions, students)
    rates = {r.question: r.rate for r in measure.question_totals(scores, questions, students).collect()}
    assert rates == {1: 2 / 3, 2: 2 / 3, 3: 2 / 3}


def test_composites(spark):
    rows = [("c", s, k, float(v)) for s, many in (("s1", (80, 100, 60)), ("s2", (60, 80, 100))) for k, v in zip(("written", "listening", "speaking"), many, strict=True)] + [("c", "s3", "written", 50.0)]
    df = spark.createDataFrame(rows, "class string, student string, component string, total double")
    out = {r.student: r.composite for r in measure.composite(df, {"written": 0.7, "listening": 0.15, "speaking": 0.15}).collect()}
    assert out == {"s1": 80.0, "s2": 69.0}
    assert [(r.student, r.missing) for r in measure.cohort_mismatch(df, ["listening", "speaking", "written"]).collect()] == [("s3", ["listening", "speaking"])]


def test_folds(spark):
    assert values(spark, ["Öğrenci  Numarası", "T.C. Kimlik No", "S.3 (25p)"], text.label_fold) == ["ogrenci numarasi", "t c kimlik no", "s 3 25p"]
    assert values(spark, ["IĞDIR  İli", None], text.course_fold) == ["ığdır ili", ""]
    assert values(spark, ["1. Tema: Sözün İnceliği", "ışık"], text.theme_upper) == ["SÖZÜN İNCELİĞİ", "IŞIK"]
    assert values(spark, ["Y API"], text.theme_key) == ["YAPI"]
    assert values(spark, ["9. SINIF TEMALARI", "HAZIRLIK SINIFI"], text.grade_label) == ["9", "hazırlık"]
    assert values(spark, ["Türkçe - İ ı", "É"], text.compare_fold) == ["turkce i i", "e"]


def test_numbers(spark):
    assert values(spark, ["s 3", "soru 12 x", "toplam"], text.question_number) == [3, 12, None]
    assert values(spark, ["Soru 1 (25p)", "12,5 puan", "x"], text.max_score) == [25.0, 12.5, None]
    assert values(spark, ["a -3,5b", "", "x"], text.lenient_number) == [-3.5, None, None]
    assert values(spark, ["7,5", "7x", "nan"], text.strict_number) == [7.5, None, None]
    assert values(spark, ["7,5", "", "nan", "inf"], text.given_number) == [7.5, None, None, None]
    assert [value(spark, text.turkish_number(F.lit(v))) for v in (1050.0, 710.5)] == ["1.050", "710,50"]
    assert [value(spark, text.turkish_percent(F.lit(v))) for v in (0.72, 1.0, 61.255)] == ["%72", "%100", "%61,26"]
    assert values(spark, ["3/4/2024", "2024-04-03", "x"], lambda c: F.date_format(text.any_date(c), "yyyy-MM-dd")) == ["2024-04-03", "2024-04-03", None]


def test_levels(spark):
    assert [value(spark, bands.level(F.lit(r))) for r in (0.85, 0.7, 0.5, 0.49)] == [x[1] for x in bands.ANALYSIS]
    assert [value(spark, bands.early_level(F.lit(r))) for r in (0.8, 0.5, 0.1)] == ["Güçlü", "Geliştirilmeli", "Kritik"]
    assert [value(spark, bands.severity(F.lit(r))) for r in (0.2, 0.6)] == ["critical", "medium"]


def test_digests(spark):
    assert values(spark, ["abc", ""], digests.fnv1a) == ["1a47e90b", "811c9dc5"]
    assert values(spark, ["x", "ç"], digests.uuid5) == [str(uuid.uuid5(digests.CHUNKS, v)) for v in ("x", "ç")]
    assert value(spark, digests.chunk_id(F.lit("tde-9-tymm"), F.lit("tdeogr.pdf"), F.lit(0), F.lit("Sözün İnceliği"))) == "74dd1935-7f09-5563-831b-e57bfe01d01e"
    assert values(spark, ["10000000146", "12345678901", "0", None], digests.national_id) == [True, False, False, False]
    assert values(spark, ["Ayşe Yılmaz", "Ayşe", "A1 Bcdef", None], digests.full_name) == [True, False, False, False]


def test_positional_rows(spark):
    rows = spark.createDataFrame([(1, ["123", "10000000146", "Ayşe Yılmaz", "8", "7", "15"]), (2, ["x"]), (3, ["7", "", "3,5", "3"])], "row_id int, cells array<string>")
    out = {r.row_id: r for r in rules.positional_rows(rows).collect()}
    assert set(out) == {1, 3}
    assert (out[1].student_no, out[1].scores, out[1].total, out[1].findings) == ("123", [8.0, 7.0], 15.0, ["TCKN", "AD_SOYAD"])
    assert out[3].scores == [None, 3.5] and out[3].calculated_total == 3.5


def test_student_rules_and_quality(spark):
    rows = spark.createDataFrame([("Ö-001", [1.0, 2.0], [5.0, 5.0], 3.0), ("x", [9.0], [5.0, 5.0], 1.0)], "student_ref string, scores array<double>, max_scores array<double>, total double")
    assert sorted(r.code for r in rules.issues(rows, ["student_ref"], rules.student_rules()).collect()) == ["SCORE_COUNT", "SCORE_RANGE", "STUDENT_REF", "TOTAL_MISMATCH"]
    docs = spark.createDataFrame([("clean", [1.0], 1.0, 1.0, []), ("off", [None, 1.0], 40.0, 10.0, ["AD_SOYAD"])], "document string, scores array<double>, total double, calculated_total double, findings array<string>")
    out = {r.document: r for r in rules.quality(docs).collect()}
    assert out["clean"].state == "ready-for-teacher-review" and out["off"].state == "teacher-review-required"
    assert (out["off"].empty_cells, out["off"].mismatches, out["off"].findings) == (1, 1, ["AD_SOYAD"])
    files = spark.createDataFrame([("a.PDF", 5), ("b.exe", 0), ("c.png", 30_000_000)], "name string, size long")
    assert sorted((r.name, r.code) for r in rules.file_issues(files).collect()) == [("b.exe", "EMPTY"), ("b.exe", "EXTENSION"), ("c.png", "TOO_LARGE")]
    assert rules.forbidden_columns(rows.select(F.struct(F.struct("total").alias("fullName")).alias("a")), ["fullName"]) == ["a.fullName"]


def test_reports(spark):
    pages = spark.createDataFrame([(1, p) for p in (90, 67, 66, 66, 71, 72, 0)] + [(2, 66), (2, 71)], "doc int, page int")
    assert {r.doc: r.ranges for r in reports.page_ranges(pages, ["doc"]).collect()} == {1: "66-67, 71-72, 90", 2: "66, 71"}
    hits = spark.createDataFrame([("o", "D", [4, 3], 2), ("o", "D", [3, -1], 1), ("o", "E", None, 3), ("o", " ", [1], 4)], "o string, document string, pages array<int>, place int")
    merged = reports.merged_sources(hits, ["o"])
    assert {r.document: (r.pages, r.place) for r in merged.collect()} == {"D": ([3, 4], 1), "E": ([], 3)}
    assert {r.document: r.label for r in reports.citation_labels(merged, ["o"]).collect()} == {"D": "K1", "E": "K2"}
    assert value(spark, reports.citation(F.lit("K1"), F.lit("66-67"))) == "(K1, s. 66-67)" and value(spark, reports.citation(F.lit(""), F.lit(""))) == ""
    broken = spark.createDataFrame([(1, base64.b64encode(b"{").decode()), (2, base64.b64encode(b'{"schema":"s","schemaVersion":2}').decode())], "k int, manifest string")
    assert [r.valid for r in reports.read_manifest(broken, "s", "a: int").collect()] == [False, False]


def test_corrections(spark):
    schema = "exam string, row_id string, position int, scores array<double>"
    original = spark.createDataFrame([("e", "a", 0, [1.0, None, 3.0]), ("e", "b", 1, [4.0, 5.0, 6.0])], schema)
    approved = spark.createDataFrame([("e", "b", 0, [4.0, None, 6.00001]), ("e", "z", 0, [2.0, 7.0, 3.0])], schema)
    assert {r.question: r.cells for r in corrections.corrected_cells(original, approved).collect()} == {0: 1, 1: 1}
    raw = spark.createDataFrame([({"0": "2", "3": "1", "-1": "4", "x": "1", "5": "0"},)], "m map<string,string>")
    assert raw.select(corrections.clean_counts(F.col("m"))).first()[0] == {0: 2, 3: 1}
    maps = spark.createDataFrame([("e", {0: 2}), ("e", {0: 1, 3: 1})], "exam string, cells map<int,int>")
    assert {r.question: r.cells for r in corrections.merged(maps).collect()} == {0: 3, 3: 1}


def test_relative_floor(spark):
    def kept(scores):
        chunks = spark.createDataFrame([(i, [s, (1 - s * s) ** 0.5]) for i, s in enumerate(scores)], "chunk_id int, vector array<double>")
        queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
        return [r.chunk_id for r in retrieval.search(queries, chunks, [], k=8).orderBy("rank").collect()]

    assert kept([0.9424, 0.8601, 0.7609, 0.7471, 0.6634, 0.6578, 0.6266, 0.6144]) == [0, 1, 2, 3]
    assert len(kept([0.8706, 0.80, 0.7256])) == 3 and len(kept([-0.1, -0.9])) == 2


def test_sections_chunks_and_upserts(spark):
    heads = spark.createDataFrame([("d", 3, "a", 20), ("d", 9, "b", 20)], "d string, page int, title string, pages int")
    assert [(r.first_page, r.last_page) for r in retrieval.sections(heads, ["d"]).orderBy("first_page").collect()] == [(3, 8), (9, 20)]
    docs = spark.createDataFrame([("d", " a b\nc "), ("e", None)], "document string, text string")
    assert [(r.document, r.chunk_index, r.text) for r in retrieval.chunks(docs, 2).orderBy("chunk_index").collect()] == [("d", 0, "a b"), ("d", 1, "c")]
    rows = spark.createDataFrame([("k", 1, "old")], "id string, v int, body string")
    assert retrieval.upsert(rows, rows.withColumn("body", F.lit("new")), "id", "v").first().body == "new"


def test_guards(spark):
    kept, dropped = textguard.without_sentences(F.lit("Bu analiz becerisi gerektirir. Telafi yapılmalıdır. Oran düşüktür."))
    assert value(spark, F.struct(kept.alias("a"), dropped.alias("b"))) == ("Bu analiz becerisi gerektirir. Oran düşüktür.", 1)
    scope = lambda a, component="written": value(spark, textguard.in_scope(F.lit(a), F.lit(0.4), F.array(F.lit("TDE1.2")), F.lit(component), F.lit("")))
    assert scope("kısa metin TDE1.2") and not scope("metin TDE9.9") and not scope("bir etkinlik") and not scope("söz " * 71)
    assert not scope("okuma beceri alanı", "listening") and scope("okuma beceri alanı")
    ground = lambda *t: value(spark, textguard.grounded(F.array(*[F.lit(x) for x in t]), F.array(F.lit("ana dü-\nşünce ve yan"), F.lit("x"))))
    assert ground("Ana düşünce", "yan") and not ground("ana düşünce", "yok") and not ground("yan", "YAN")
    answers = spark.createDataFrame([("e", "- Soru 2: bir\nserbest\n- soru 9 : iki \n- Soru 3: üç\n- Soru 4: dört\n- Soru 5: beş")], "exam string, answer string")
    known = spark.createDataFrame([("e", n) for n in (2, 3, 4, 5)], "exam string, number int")
    assert textguard.findings(answers, known).first().findings == "- Soru 2: bir\n- Soru 3: üç\n- Soru 4: dört"


def test_backups(spark):
    rows = backups.sealed(spark.createDataFrame([("a", 1, '{"x":1}'), ("b", 2, "{}"), ("c", 3, "{}"), ("d", 2, '{"fullName":"n"}')], "record_id string, version int, workspace string"))
    rows = rows.unionByName(rows.where("record_id = 'b'").withColumns({"record_id": F.lit("e"), "digest": F.lit("0")}))
    assert {r.record_id: r.status for r in backups.inspected(rows, ["fullName"]).collect()} == {"a": "old", "b": "ok", "c": "newer", "d": "private", "e": "broken"}
    out = {r.record_id: r for r in backups.migrated(rows, ["fullName"]).collect()}
    assert set(out) == {"a", "b"} and out["a"].version == 2 and "questionApprovals" in out["a"].workspace


def docx(rows):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
        z.writestr("customXml/report.xml", f"<r>{base64.b64encode(b'{}').decode()}</r>")
    return out.getvalue()


def test_tables_of_files(spark, tmp_path):
    rows = [["Adı Soyadı", "TCKN", "Okul No", "S1 (25p)", "S2 (25p)", "Toplam (50p)", ""], ["A B", "10000000146", "9999", "20", "15", "35", ""], [""] * 7]
    (tmp_path / "a.docx").write_bytes(docx(rows))
    (tmp_path / "b.html").write_text("<table><tr><th>Soru 1</th></tr><tr><td> 4,5 </td></tr></table>")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    cells = readers.cells(readers.files(spark, str(tmp_path)))
    assert cells.where("error is not null").count() == 1
    clean = tables.clean(cells.where("error is null"), ["path", "table_ix"])
    found = tables.scores(clean, ["path", "table_ix"])
    assert sorted((r.path.rpartition("/")[2], r.question, r.max_score, r.score) for r in found.collect()) == [("a.docx", 1, 25.0, 20.0), ("a.docx", 2, 25.0, 15.0), ("b.html", 1, None, 4.5)]
    assert [r.total for r in tables.totals(clean, ["path", "table_ix"]).collect()] == [35.0]
    manifests = {r.path.rpartition("/")[2]: r for r in readers.manifests(readers.files(spark, str(tmp_path), "*.docx"), "customXml/report.xml").collect()}
    assert manifests["a.docx"].error is None and manifests["c.docx"].manifest is None


def test_exam_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿question_no,question_text,correct_answer,points\n1, Ne? ,B,10\nx,Ne?,A,10\n3,,A,10\n4,Ne?,A,\"12,5\"\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_text("no,text\n1,a\n")
    rows = readers.exam_csv(spark, str(tmp_path)).collect()
    assert sorted((r.number or 0, r.error or "") for r in rows if r.path.endswith("good.csv")) == [(0, "question_no"), (1, ""), (3, "question_text"), (4, "points")]
    assert all(r.error == "header" for r in rows if r.path.endswith("bad.csv"))


def test_streams_equal_their_twins(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:{m:02d}:00") for u in (1, 2) for m in (0, 1, 5, 6, 11, 30)]
    df = spark.createDataFrame(rows, "user int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, events.throttled(df, "user", "ts", 300).collect()))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    events.throttled_stream(stream, "user", "ts", 300).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("fired").collect())) == want and len(want) == 8


def _in_two_batches(spark, df, folder, stream, order):
    """Rows of the stream's sink after each of two halves of df has come; one file is one batch."""
    rows = df.orderBy(order).collect()
    for i, half in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(half, df.schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(folder / "in"))
        stream(source).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(str(folder / "out"))).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        if i == 0:
            first = spark.read.parquet(str(folder / "out")).collect()
    return first, spark.read.parquet(str(folder / "out")).collect()


def test_group_sizes_go_on_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(22)], "n long, user int")
    first, both = _in_two_batches(spark, df, tmp_path, lambda s: events.group_sizes_stream(s, "user", 4), "n")
    assert {(r.complete, r.waiting) for r in first} == {(1, 2), (1, 1)}
    best = {u: max((r.complete, r.waiting) for r in both if r.user == u) for u in (0, 1)}
    assert best == {r.user: (r.complete, r.waiting) for r in events.group_sizes(df, "user", 4).collect()}


def test_late_answers_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 5, "x"), (1, "b", 1, "y"), (2, "a", 3, "late"), (3, "b", 2, "z")], "n long, user string, seq long, said string")
    first, both = _in_two_batches(spark, df, tmp_path, lambda s: events.newest_stream(s, "user", "seq"), "n")
    assert {r.said for r in first} == {"x", "y"} and {r.said for r in both} == {"x", "y", "z"}
    assert {r.said for r in events.latest(df, "user", ["seq"]).collect()} == {"x", "z"}


def test_headings_pages_and_contexts(spark):
    pages = spark.createDataFrame([("d", 1, "x\n1. TEMA: SÖZ\ny"), ("d", 4, "1. TEMA: SÖZ"), ("d", 5, "2. TEMA: YAPI\n3. TEMA: Z"), ("d", 6, None)], "document string, page int, text string")
    assert sorted((r.label, r.page) for r in retrieval.heading_pages(pages, r"^\s*\d+\. TEMA: (.+)$").collect()) == [("SÖZ", 4), ("YAPI", 5)]
    assert value(spark, retrieval.original_pages(F.array(F.lit(2), F.lit(1), F.lit(2)), F.lit(65))) == [66, 67]
    hits = spark.createDataFrame([(1, 2, "b" * 400, "D", [3]), (1, 1, "a", "D", [1])], "query_id int, rank int, text string, document string, pages array<int>")
    row = retrieval.contexts(hits).first()
    assert row.context.startswith("a\n\n---\n\nb") and [len(s.excerpt) for s in row.sources] == [1, 300]


def test_single_student_sheet(spark):
    rows = [["Sorular", "Soru 1", "Soru 2"], ["Azami puan", "25", "10,5"], ["Alınan puan", "20", ""]]
    cells = spark.createDataFrame([("p", r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)], "path string, row_ix int, cell_ix int, text string")
    assert sorted((r.question, r.max_score, r.score) for r in tables.single_student(cells, ["path"]).collect()) == [(1, 25.0, 20.0), (2, 10.5, None)]


def test_json_texts(spark):
    assert values(spark, ['```json\n{"b": 1, "a": [2]}\n``` and more', "no", None, "{"], json_text.first_object) == ['{"b": 1, "a": [2]}', None, None, None]
    assert values(spark, ['{"b": 1, "a": {"d": "ç", "c": 2}}', "x"], json_text.canonical) == ['{"a":{"c":2,"d":"ç"},"b":1}', None]
    assert values(spark, ["☐ Evet ☒ Hayır", "☐ Evet"], text.checked_option) == ["Hayır", None]


def test_fnv1a_beyond_the_basic_plane(spark):
    def plain(s):
        h, raw = 0x811C9DC5, s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "ölçme", "a😀b", "퟿"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(digests.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts]


def test_keywords_of_any_length(spark):
    questions = spark.createDataFrame([(1, "Bir İki"), (2, "xyz abc"), (3, ""), (4, None)], "question_id long, text string")
    outcomes = spark.createDataFrame([("a", ["x", "abc"]), ("b", ["iki", "ir"]), ("c", ["", "zz"]), ("d", None)], "outcome_id string, keywords array<string>")
    got = {tuple(r) for r in programs.keyword_links(questions, outcomes, "none").collect()}
    assert got == {(1, "b"), (2, "a"), (3, "none"), (4, "none")}


def test_sheets_are_dealt_once(spark):
    from tallyloom.sources import tables

    lines = [["", "No", "", "Soru 1 (10p)", "S2 (2,5 puan)", "Toplam"], [" "] * 6, ["", "7", "", "8", None, "9"], ["", "8", "", "", "1,5", "2"]]
    cells = spark.createDataFrame([(k, r, c, t) for k in ("a", "b") for r, line in enumerate(lines) for c, t in enumerate(line)], "k string, row_ix int, cell_ix int, text string")
    out = tables.scores(tables.clean(cells, ["k"]), ["k"])
    assert sorted(map(tuple, out.where("k = 'a'").collect()), key=str) == [("a", 1, 1, 10.0, 8.0), ("a", 1, 2, 2.5, None), ("a", 2, 1, 10.0, None), ("a", 2, 2, 2.5, 1.5)]
    assert sorted(r.total for r in tables.totals(tables.clean(cells, ["k"]), ["k"]).where("k = 'b'").collect()) == [2.0, 9.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

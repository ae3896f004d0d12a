"""What exam documents say: their tables' roles by headings, and from these the exam, its questions, students and what a teacher must check.

A document is a row with its tables, which are arrays of rows of cell texts; a role is looked for in all tables and the first that has it is taken. A
document's cells meet once; all else are functions of its arrays. Names and national ids are never carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text

# fixed values: labels, once folded, that an exam table has two of, and those of other roles; fields of an exam by their labels, and those that count as verified
EXAM_LABELS = ["il", "ilce", "okul adi", "ders", "dersin adi", "sinif sube", "sinav turu", "sinav tarihi", "ogrenci okul no", "ogrencinin adi soyadi"]
QUESTION_LABELS = ["soru no", "azami puan"]
SHEET_LABELS = ["sorular", "azami puan", "ogrencinin aldigi puan"]
NUMBER_LABELS = ["okul no", "ogrenci no", "numara", "no"]
ROW_LABELS = ["sira", "sira no"]
NAME_LABELS = ["ad soyad", "adi soyadi", "ogrenci ad soyad", "ogrenci adi soyadi", "ogrencinin adi soyadi"]
FIELDS = {
    "province": ["il"], "district": ["ilce"], "schoolName": ["okul adi"], "academicYear": ["egitim ogretim yili"], "course": ["ders", "dersin adi"], "classSection": ["sinif sube"],
    "term": ["donem"], "examType": ["sinav turu"], "examDate": ["sinav tarihi"], "totalMaxScore": ["toplam puan"], "teacherName": ["ogretmenin adi soyadi"], "teachingProgram": ["ogretim programi"],
    "assessmentBasis": ["olcme ve degerlendirme dayanagi"], "scenarioInfo": ["senaryo ornek evrak"], "otherSources": ["diger dayanaklar"], "documentNo": ["belge rapor no", "belge sayfa no"],
    "approvalInfo": ["iletim onay bilgisi"], "documentPage": ["belge sayfa no"],
}
VERIFIED = ["province", "district", "schoolName", "teacherName", "academicYear", "classSection", "teachingProgram", "assessmentBasis"]
QUESTION_HEADING = r"^(?:s|soru) ?(\d+)\b"
#: Largest gap between a written total and the sum of its scores.
TOLERANCE = 0.01

_QUESTION = "array<struct<number: int, outcome_code: string, outcome_description: string, max_score: double, source: string>>"
_STUDENT = "array<struct<row_number: int, student_no: string, scores: array<double>, total: double, calculated_total: double>>"


def documents(cells: DataFrame) -> DataFrame:
    """path, tables (array of arrays of rows of texts), folded (the same as labels) of cells(path, table_ix, row_ix, cell_ix, text).

    Cells that are left out are empty texts, and a place has one cell; rows and tables that are left out aren't there. Rows of files without cells (with an error, say) give no tables. Cells are
    folded one by one, meet by path once, and come sorted, so that the places where a path, table or row begins are the offsets of nested lists.
    """
    said = F.trim(F.coalesce("text", F.lit("")))
    rows = cells.select("path", *[F.col(c).cast("int").alias(c) for c in ("table_ix", "row_ix", "cell_ix")], said.alias("v"), text.label_fold(said).alias("f"))
    dealt = rows.repartition("path").sortWithinPartitions("path", "table_ix", "row_ix", "cell_ix", "v")
    kind = "array<array<array<string>>>"
    return dealt.mapInArrow(_nested, f"path {dict(cells.dtypes)['path']}, tables {kind}, folded {kind}")


def _nested(batches: Iterator) -> Iterator:
    """Documents of sorted cells in Arrow batches; the last path of a batch waits for the next batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    other = lambda a: np.concatenate([[True], a[1:] != a[:-1]])
    flat = lambda v: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v

    def made(cells):
        path = flat(cells["path"])
        place = [pc.fill_null(cells[c], -1).to_numpy() for c in ("table_ix", "row_ix", "cell_ix")]
        there, codes = place[2] >= 0, pc.dictionary_encode(path, null_encoding="encode").indices.to_numpy()
        document = other(codes)
        starts, number = np.flatnonzero(document), np.cumsum(document) - 1
        keep = np.flatnonzero(there)
        table = other(number[keep]) | other(place[0][keep]) if len(keep) else np.zeros(0, bool)
        row = table | other(place[1][keep]) if len(keep) else table
        cell = row | other(place[2][keep]) if len(keep) else row
        # a place's first cell counts; a row has its last cell's place + 1 cells
        row_of, first = np.cumsum(row) - 1, np.flatnonzero(row)
        last = place[2][keep][np.append(first[1:], len(keep)) - 1] + 1 if len(keep) else np.zeros(0, int)
        ends = np.concatenate([[0], np.cumsum(last)]).astype("int64")
        at = np.full(ends[-1], -1, dtype="int64")
        at[ends[row_of[cell]] + place[2][keep][cell]] = keep[cell]
        of_table, of_document = np.flatnonzero(table), number[keep[table]]
        rows_at = np.append(np.searchsorted(first, of_table), len(first))
        tables_at = np.searchsorted(of_document, np.arange(len(starts) + 1))
        nest = lambda values: pa.ListArray.from_arrays(pa.array(tables_at, pa.int32()), pa.ListArray.from_arrays(pa.array(rows_at, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)))
        taken = lambda c: flat(pc.fill_null(flat(cells[c]).take(pa.array(at, mask=at < 0)), ""))
        return pa.RecordBatch.from_arrays([path.take(pa.array(starts)), nest(taken("v")), nest(taken("f"))], ["path", "tables", "folded"])

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
        begin = int(np.flatnonzero(other(codes))[-1])
        if begin == 0 and held and batch.column(0)[0] == held[0].column(0)[0]:
            held.append(batch)  # a document of many batches
            continue
        if done := [*held, *([batch.slice(0, begin)] if begin else [])]:
            yield made(pa.Table.from_batches(done))
        held = [batch.slice(begin)]
    if held:
        yield made(pa.Table.from_batches(held))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; put into a lambda by itself it would be evaluated for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """The place, from 0, of the first item that is wanted; null if none is."""
    return F.nullif(F.array_position(F.transform(items, wanted), F.lit(True)), F.lit(0)).cast("int") - 1


def _subset(labels: list[str], of: Column) -> Column:
    return F.size(F.array_intersect(of, F.array(*map(F.lit, labels)))) == len(labels)


def _cell(row: Column, place: Column | int) -> Column:
    return F.coalesce(F.get(row, F.lit(place) if isinstance(place, int) else place), F.lit(""))


def _heading(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, QUESTION_HEADING, 1), F.lit("")).try_cast("int")


def _after_first(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


def _added(scores: Column) -> Column:
    return F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 2)


def _whole(value: Column) -> Column:
    return F.floor(F.abs(value)).cast("int") * F.signum(value).cast("int")


def _roles(docs: DataFrame) -> DataFrame:
    """docs with the tables of each role (raw and folded), null where no table has it."""
    every = lambda t: F.array_distinct(F.flatten(t))
    head = lambda t: F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>"))
    places = {
        "exam": _first(F.col("folded"), lambda t: F.size(F.array_intersect(every(t), F.array(*map(F.lit, EXAM_LABELS)))) >= 2),
        "question": _first(F.col("folded"), lambda t: _subset(QUESTION_LABELS, head(t))),
        "student": _first(F.col("folded"), lambda t: F.exists(head(t), lambda c: c.isin(NUMBER_LABELS)) & F.exists(head(t), lambda c: c.rlike(QUESTION_HEADING))),
        "sheet": _first(F.col("folded"), lambda t: (F.size(t) >= 3) & _subset(SHEET_LABELS, F.transform(t, lambda r: _cell(r, 0)))),
    }
    out = docs.withColumns({f"{k}_at": p for k, p in places.items()})
    return out.withColumns({f"{k}{s}": F.get(c, F.col(f"{k}_at")) for k in places for s, c in (("", "tables"), ("_labels", "folded"))})


def _value(labels: list[str]) -> Column:
    """Of the pairs in the column pairs: the last value of the first label that has one that isn't empty, else an empty text."""
    last = lambda name: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("pairs", lambda p: p["label"] == name), lambda p: p["value"])), -1)
    return F.coalesce(*[F.nullif(last(name), F.lit("")) for name in labels], F.lit(""))


def _table_questions() -> Column:
    rows = F.transform(_after_first(F.col("question")), lambda r: F.struct(text.lenient_number(_cell(r, 0)).alias("n"), _cell(r, 1).alias("c"), _cell(r, 2).alias("d"), text.lenient_number(_cell(r, 3)).alias("m")))
    said = F.filter(rows, lambda q: (q["c"] != "") | (q["d"] != "") | q["m"].isNotNull())
    number = lambda q, i: F.coalesce(F.nullif(_whole(q["n"]), F.lit(0)), i + 1)
    return F.transform(said, lambda q, i: F.struct(number(q, i).alias("number"), q["c"].alias("outcome_code"), q["d"].alias("outcome_description"), q["m"].alias("max_score"), F.lit(None).cast("string").alias("source")))


def _headed_questions(labels: Column, most: Column, source: str) -> Column:
    """A question for each heading that names one; most has the text of the maximum at the heading's place."""
    pairs = F.zip_with(labels, most, lambda label, m: F.struct(_heading(label).alias("n"), text.lenient_number(m).alias("m")))
    blank = F.lit("")
    found = F.filter(F.slice(pairs, 1, F.size(labels)), lambda p: p["n"].isNotNull())
    return F.transform(found, lambda p: F.struct(p["n"].alias("number"), blank.alias("outcome_code"), blank.alias("outcome_description"), p["m"].alias("max_score"), F.lit(source).alias("source")))


def _row_with(label: str) -> Column:
    """The row of the sheet whose first cell has the label; an empty one if there is none."""
    return F.coalesce(F.get("sheet", _first(F.col("sheet_labels"), lambda r: _cell(r, 0) == label)), F.array().cast("array<string>"))


def _class_students() -> Column:
    def places(labels: Column) -> Column:
        number, total, row = (F.coalesce(_first(labels, w), F.lit(-1)) for w in (lambda c: c.isin(NUMBER_LABELS), lambda c: (c == "puan") | c.startswith("toplam"), lambda c: c.isin(ROW_LABELS)))
        asked = F.filter(F.transform(labels, lambda c, i: F.when(c.rlike(QUESTION_HEADING), i)), lambda i: i.isNotNull())
        return F.struct(number.alias("number"), total.alias("total"), row.alias("row"), asked.alias("asked"))

    def student(r: Column, at: Column) -> Column:
        value = lambda i: F.when(i >= 0, text.lenient_number(F.get(r, i)))
        return F.struct(value(at["row"]).alias("n"), F.when(at["number"] >= 0, _cell(r, at["number"])).otherwise(F.lit("")).alias("no"), F.transform(at["asked"], lambda i: text.lenient_number(_cell(r, i))).alias("s"), value(at["total"]).alias("t"))

    def every(at: Column) -> Column:
        rows = F.transform(_after_first(F.col("student")), lambda r: student(r, at))
        said = F.filter(rows, lambda s: (s["no"] != "") | F.exists(s["s"], lambda x: x.isNotNull()) | s["t"].isNotNull())
        place = lambda s, i: F.when(at["row"] >= 0, _whole(s["n"])).otherwise(i + 1)
        return F.transform(said, lambda s, i: F.struct(place(s, i).alias("row_number"), s["no"].alias("student_no"), s["s"].alias("scores"), s["t"].alias("total"), _added(s["s"]).alias("calculated_total")))

    return _let(places(F.get("student_labels", F.lit(0))), every)


def _sheet_student() -> Column:
    def student(x: Column) -> Column:
        scores = F.transform(F.slice(x["row"], 2, x["many"]), text.lenient_number)
        return F.struct(F.lit(1).alias("row_number"), x["number"].alias("student_no"), scores.alias("scores"), text.lenient_number(F.get(x["row"], x["many"] + 1)).alias("total"), _added(scores).alias("calculated_total"))

    parts = F.struct(_row_with(SHEET_LABELS[2]).alias("row"), F.size("sheet_questions").alias("many"), _value(["ogrenci okul no", "okul no"]).alias("number"))
    there = F.filter(F.array(parts), lambda x: F.size(x["row"]) > 0)
    return F.filter(F.transform(there, student), lambda s: (s["student_no"] != "") | F.exists(s["scores"], lambda x: x.isNotNull()) | s["total"].isNotNull())


def read(docs: DataFrame) -> DataFrame:
    """path, document_type, exam (struct of FIELDS, verified), questions, students of documents().

    A document is a class-score-template if it has a table of students with a number and a score, else a single-student-score-sheet if it has such a
    sheet's three rows, else unclassified. Questions come from the table of questions, else from the headings of scores. Fields that aren't there are empty; ticked boxes
    give term and type. Rows of questions and students that say nothing are left out. An empty document has no exam fields, questions or students.
    """
    rows = _roles(docs)
    pairs = F.flatten(F.transform(F.coalesce("exam", F.array().cast("array<array<string>>")), lambda r: F.filter(F.transform(r, lambda c, i: F.when((i % 2 == 0) & (i < F.size(r) - 1), F.struct(text.label_fold(c).alias("label"), _cell(r, i + 1).alias("value")))), lambda p: F.coalesce(p["label"] != "", F.lit(False)))))
    rows = rows.withColumn("pairs", pairs)
    question_labels = F.transform(_row_with(SHEET_LABELS[0]), lambda c, i: F.when(i > 0, text.label_fold(c)).otherwise(F.lit("")))
    rows = rows.withColumn("sheet_questions", _headed_questions(question_labels, _row_with(SHEET_LABELS[1]), "single-student-score-sheet"))
    kind = F.when(F.col("student").isNotNull(), "class-score-template").when(F.col("sheet").isNotNull(), "single-student-score-sheet").otherwise(F.lit("unclassified"))
    none = F.array().cast(_QUESTION)
    headed = F.when(F.col("student").isNotNull(), _headed_questions(F.get("student_labels", F.lit(0)), F.array().cast("array<string>"), "score-column-heading")).when(F.col("sheet").isNotNull(), F.col("sheet_questions")).otherwise(none)
    table = F.coalesce(_table_questions(), none)
    fields = {k: _value(v) for k, v in FIELDS.items()}
    for k in ("term", "examType"):
        fields[k] = F.coalesce(text.checked_option(fields[k]), fields[k])
    fields["totalMaxScore"] = text.lenient_number(fields["totalMaxScore"])
    verified = F.filter(F.array(*[F.when(fields[k] != "", F.lit(k)) for k in VERIFIED]), lambda x: x.isNotNull())
    students = F.when(F.col("student").isNotNull(), _class_students()).when(F.col("sheet").isNotNull(), _sheet_student()).otherwise(F.array().cast(_STUDENT))
    heads = F.array_distinct(F.concat(F.coalesce(F.get("student_labels", F.lit(0)), F.array().cast("array<string>")), F.coalesce(F.flatten("exam_labels"), F.array().cast("array<string>"))))
    identity = F.filter(F.array(F.when(F.exists(heads, lambda c: c.isin(text.NATIONAL_ID)), F.lit("national id")), F.when(F.exists(heads, lambda c: c.isin(NAME_LABELS)), F.lit("name"))), lambda x: x.isNotNull())
    return rows.select("path", kind.alias("document_type"), F.struct(*[c.alias(k) for k, c in fields.items()], verified.alias("verified")).alias("exam"), F.when(F.size(table) > 0, table).otherwise(headed).cast(_QUESTION).alias("questions"), students.cast(_STUDENT).alias("students"), identity.alias("identity"))


def warnings(read_documents: DataFrame) -> DataFrame:
    """path, code, place: what a teacher must look at in read() documents; place is a question's number, a student's row or null.

    Questions that come from headings have no outcomes, and perhaps no maxima, as a whole; others are named one by one.
    """
    none = F.array().cast("array<struct<code: string, place: int>>")
    one = lambda code, place=None: F.struct(F.lit(code).alias("code"), (F.lit(None) if place is None else place).cast("int").alias("place"))
    some = lambda wanted, code: F.when(wanted, F.array(one(code))).otherwise(none)
    q, s = F.col("questions"), F.col("students")
    blank = lambda x: (x["outcome_code"] == "") & (x["outcome_description"] == "")
    inferred = F.filter(q, lambda x: x["source"].isNotNull())
    named = lambda items, code, place: F.transform(items, lambda x: one(code, x[place]))
    own = F.when(F.size(inferred) > 0, F.concat(some(F.exists(inferred, blank), "OUTCOMES_NOT_IN_SHEET"), some(F.exists(inferred, lambda x: x["max_score"].isNull()), "MAXIMA_NOT_IN_SHEET"))).otherwise(
        F.concat(named(F.filter(q, blank), "NO_OUTCOME", "number"), named(F.filter(q, lambda x: x["max_score"].isNull()), "NO_MAXIMUM", "number"))
    )
    off = F.filter(s, lambda x: F.coalesce(F.abs(x["total"] - x["calculated_total"]) > TOLERANCE, F.lit(False)))
    every = F.concat(
        some(F.col("exam.course") == "", "NO_COURSE"), some(F.size(q) == 0, "NO_QUESTIONS"), some(F.size(s) == 0, "NO_STUDENTS"), own, named(off, "TOTAL_MISMATCH", "row_number"),
        some(F.array_contains("identity", "national id"), "NATIONAL_ID_LEFT_OUT"), some(F.array_contains("identity", "name"), "NAME_LEFT_OUT"), some(F.col("document_type") == "unclassified", "NOT_TOLD_APART"),
    )
    return read_documents.select("path", F.inline(every))

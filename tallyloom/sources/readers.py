"""Readers of exam files: CSV and JSON with fixed schemas, tables of DOCX, XLSX and HTML files, embedded manifests.

Files are read by Spark in parallel; a file of a zipped format is opened within the task that has it. What a file breaks is told
in a column, so one bad file doesn't stop the others.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: header of exam files, names within office files, size limits
EXAM_HEADER = ["question_no", "question_text", "correct_answer", "points"]
CELLS = "path string, table_ix int, row_ix int, cell_ix int, text string, error string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAX_MANIFEST = 2 * 1024 * 1024
#: rows of cells that a task hands on at a time
CELL_ROWS = 16384

OUTCOMES = "learning_outcomes array<struct<id: string, title: string, keywords: array<string>>>"
ANSWERS = "student_results array<struct<student_no: string, full_name: string, answers: array<struct<question_id: string, answer: string>>>>"
DOCUMENT = (
    "metadata struct<ced_version: string, created_at: string, source: string, language: string>, "
    "assessment struct<id: string, title: string, course: string, education_level: string, school_type: string, grade: string, exam_type: string, exam_date: string, question_count: int, total_score: double, component_type: string, assessment_group_id: string, weighting_profile_id: string>, "
    "questions array<struct<id: string, number: int, text: string, max_score: double, learning_outcome_ids: array<string>, learning_outcome_weights: map<string, double>, answer_key: string>>, "
    "student_results array<struct<student_no: string, full_name: string, question_scores: array<struct<question_id: string, score: double>>, answers: array<struct<question_id: string, answer: string>>, total_score: double>>, "
    "validation struct<valid: boolean, issues: array<struct<code: string, message: string, field: string, severity: string>>, warnings: array<string>>"
)


def exam_csv(spark: SparkSession, path: str) -> DataFrame:
    """Questions of exam files: path, row (the first after the header is 2), number, text, answer_key, max_score, and error: null, or the first thing wrong with the row.

    A file whose first row isn't EXAM_HEADER in that order has error "header" in all rows. A byte-order mark is skipped, quoted texts may have line breaks, rows that are blank don't count.
    """
    names = ["n", "question_text", "correct_answer", "points", "rest"]
    raw = spark.read.schema(", ".join(f"{c} string" for c in names)).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    # a file with quoted line breaks is read whole, by one task, so its rows are in order
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), *names)
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("path").orderBy("at")))
    head = F.transform(F.array(*names), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '^\ufeff|"', ""))
    fine = F.array_join(head, ",") == ",".join([*EXAM_HEADER, ""])
    header = rows.where("row = 1").select("path", fine.alias("fine"))
    number, points = F.trim("n").try_cast("int"), F.trim("points").try_cast("double")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = F.when(~F.col("fine"), "header").when(number.isNull(), "question_no").when(blank("question_text"), "question_text").when(blank("correct_answer"), "correct_answer").when(points.isNull() | F.isnan(points) | (points <= 0), "points")
    return rows.join(header, "path").where("row > 1").select("path", "row", number.alias("number"), F.trim("question_text").alias("text"), F.trim("correct_answer").alias("answer_key"), points.alias("max_score"), error.alias("error"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one document each, with what doesn't fit the schema in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def _office_cells(content: bytes, suffix: str) -> Iterator[tuple[int, int, int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        if suffix == "docx":
            tree = ElementTree.fromstring(file.read("word/document.xml"))
            for t, table in enumerate(tree.iter(f"{WORD}tbl")):
                for r, row in enumerate(table.iterfind(f"{WORD}tr")):
                    for c, cell in enumerate(row.iterfind(f"{WORD}tc")):
                        said = ("".join(x.text or "" for x in p.iter(f"{WORD}t")).strip() for p in cell.iter(f"{WORD}p"))
                        yield t, r, c, " ".join(x for x in said if x)
            return
        names = file.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(file.read("xl/sharedStrings.xml")).iterfind(f"{SHEET}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for t, name in enumerate(sheets):
            for r, row in enumerate(ElementTree.fromstring(file.read(name)).iter(f"{SHEET}row")):
                for k, cell in enumerate(row.iterfind(f"{SHEET}c")):
                    letters = re.match("[A-Z]+", cell.get("r") or "")
                    column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else k
                    value = cell.find(f"{SHEET}v")
                    inline = "".join(x.text or "" for x in cell.iter(f"{SHEET}t"))
                    yield t, r, column, shared[int(value.text)] if cell.get("t") == "s" and value is not None else inline or (value.text or "" if value is not None else "")


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


#: A tag that any parser reads alike: no attributes but quoted ones, no element whose text isn't markup.
_TAG = re.compile(r"""<(/?[tT][dDhHrR](?=>)|/[a-zA-Z][a-zA-Z0-9]*(?=>)|(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[ >])[a-zA-Z][a-zA-Z0-9]*)(?: +[a-zA-Z-]+="[^"<>]*")*>""")


def _html_rows(text: str) -> list[list[str]]:
    """Rows of cells of a page. Where each < of a page begins a plain tag it is cut at its tags, which gives what the parser gives in a fraction of the time; the parser reads all others."""
    parts = _TAG.split(text)
    if text.count("<") != len(parts) // 2:
        parser = _Rows()
        parser.feed(text)
        return parser.rows
    rows: list[list[str]] = []
    cell = None
    for tag, said in zip(parts[1::2], map(unescape, parts[2::2]) if "&" in text else parts[2::2], strict=True):
        tag = tag.lower()
        if tag == "td" or tag == "th":
            cell = said
            continue
        if tag == "tr":
            rows.append([])
        if cell is None:
            continue
        if tag == "/td" or tag == "/th":
            if not rows:
                rows.append([])
            rows[-1].append(cell.strip())
            cell = None
        else:
            cell += said
    return rows


def _html_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    for r, row in enumerate(x for x in _html_rows(content.decode("utf-8", "replace")) if any(x)):
        for c, text in enumerate(row):
            yield 0, r, c, text


def cells(files: DataFrame) -> DataFrame:
    """Table cells of files(path, content): DOCX, XLSX and HTML by extension; a file that can't be read gives one row with its error, one without cells a row without."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["path", "table_ix", "row_ix", "cell_ix", "text", "error"]

    def arrow(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        out = []
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                suffix = path.rpartition(".")[2].lower()
                try:
                    if suffix in ("docx", "xlsx"):
                        found = list(_office_cells(bytes(content), suffix))
                    elif suffix in ("html", "htm"):
                        found = _html_cells(bytes(content))
                    else:
                        raise ValueError(f"no reader for .{suffix}")
                    out += [(path, t, r, c, said, None) for t, r, c, said in found] or [(path, None, None, None, None, None)]
                except Exception as error:  # of one file: told in its row
                    out.append((path, None, None, None, None, f"{type(error).__name__}: {error}"[:200]))
                while len(out) >= CELL_ROWS:
                    yield arrow(out[:CELL_ROWS])
                    del out[:CELL_ROWS]
        if out:
            yield arrow(out)

    return files.select("path", "content").mapInArrow(run, CELLS)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def manifests(docx: DataFrame, member: str) -> DataFrame:
    """path, manifest (the base64 text in a member of DOCX files), error of files(path, content)."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as file:
                        if file.getinfo(member).file_size > MAX_MANIFEST:
                            raise ValueError("manifest too large")
                        text = "".join(ElementTree.fromstring(file.read(member)).itertext()).strip()
                    base64.b64decode(text, validate=True)
                    out.append((path, text, None))
                except Exception as error:  # of one file: told in its row
                    out.append((path, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(out, columns=["path", "manifest", "error"])

    return docx.select("path", "content").mapInPandas(run, "path string, manifest string, error string")


def list_items(html: Column) -> Column:
    """Texts of the li elements of a page, tags and outer space dropped."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def route(name: Column) -> Column:
    """Which reader a file goes to, by its extension."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(kind == "docx", "docx").when(kind == "pdf", "pdf").when(kind.isin("xlsx", "xls"), "sheet").when(kind.isin("jpg", "jpeg", "png"), "image").otherwise(F.lit("other"))


def page_slice(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first to last, both included, counted from 1."""
    return pages.where(F.col("page").between(first, last))

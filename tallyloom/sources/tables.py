"""From table cells to questions and score rows: headings decide what a column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text


def clean(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells(keys, row_ix, cell_ix, text) trimmed, without empty rows and columns, rows and columns numbered anew.

    Dealt once by keys, which serves all windows. A row that isn't empty is in a column that isn't either, so its number is told in the order that tells whether it is empty.
    """
    left = cells.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).repartition(*keys)
    for at in ("row_ix", "cell_ix"):
        left = left.withColumn("_full", F.max(F.length("text")).over(Window.partitionBy(*keys, at))).where("_full > 0")
        left = left.withColumn("_new", F.dense_rank().over(Window.partitionBy(*keys).orderBy(at)) - 1).drop(at, "_full").withColumnRenamed("_new", at)
    return left


def headings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The role of each column by the first row: student, name, national_id, total or question with its number and maximum."""
    first = cells.where("row_ix = 0").select(*keys, "cell_ix", "text", text.label_fold(F.col("text")).alias("_label"))  # folded once for all the questions about it
    return first.select(*keys, "cell_ix", *_heading(F.col("_label"), F.col("text")))


def _heading(label: Column, said: Column) -> list[Column]:
    role = F.when(text.is_national_id(label), "national_id").when(text.is_name(label), "name").when(text.is_student_number(label), "student").when(text.is_total(label), "total").when(text.question_number(label).isNotNull(), "question").otherwise(F.lit("other"))
    return [role.alias("role"), text.question_number(label).alias("question"), text.max_score(said).alias("max_score")]


def _below(cells: DataFrame, keys: list[str], role: str) -> DataFrame:
    """Cells below the first row with question and max_score of their column's heading, of columns with this role. A column has its heading in the same window, so cells aren't dealt anew."""
    labelled = cells.withColumn("_label", F.when(F.col("row_ix") == 0, text.label_fold(F.col("text"))))
    headed = labelled.withColumn("_head", F.when(F.col("row_ix") == 0, F.struct(*_heading(F.col("_label"), F.col("text"))))).drop("_label")
    down = Window.partitionBy(*keys, "cell_ix").orderBy("row_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = headed.withColumn("_head", F.first("_head").over(down)).where((F.col("row_ix") > 0) & (F.col("_head.role") == role))
    for k in keys:
        under = under.where(F.col(k).isNotNull())
    return under.select("*", "_head.question", "_head.max_score").drop("_head")


def scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Long score rows (keys, row_ix, question, max_score, score) of clean cells: names and ids never leave the table."""
    return _below(cells, keys, "question").select(*keys, "row_ix", "question", "max_score", text.lenient_number(F.col("text")).alias("score"))


def totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    return _below(cells, keys, "total").select(*keys, "row_ix", text.lenient_number(F.col("text")).alias("total"))


def pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Label and value pairs of even and odd cells; of equal labels the last one counts."""
    ordered = Window.partitionBy(*keys, "row_ix").orderBy("cell_ix")
    both = cells.withColumn("value", F.lead("text").over(ordered)).where("cell_ix % 2 = 0 and value is not null")
    return both.groupBy(*keys, text.label_fold(F.col("text")).alias("label")).agg(F.max_by("value", F.struct("row_ix", "cell_ix")).alias("value"))


def best_table(cells: DataFrame, key: str) -> DataFrame:
    """The table of each file with the most rows, the first of equal ones."""
    many = cells.groupBy(key, "table_ix").agg(F.countDistinct("row_ix").alias("rows"))
    best = many.groupBy(key).agg(F.max_by("table_ix", F.struct("rows", -F.col("table_ix"))).alias("table_ix"))
    return cells.join(best, [key, "table_ix"], "left_semi")


def single_student(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Score rows (keys, question, max_score, score) of a sheet of one student: a row of questions, one of maxima, one of scores.

    The first cell says what a row is: it begins with soru, with azami or puan degeri, or with alinan or ogrenci puan once folded.
    """
    label = text.label_fold(F.col("text"))
    kind = F.when(label.rlike(r"^(azami|puan degeri|en yuksek)"), "max").when(label.rlike(r"^(alinan|ogrenci puan|aldigi)"), "score").when(label.startswith("soru"), "question")
    rows = cells.where("cell_ix = 0").select(*keys, "row_ix", kind.alias("kind")).where("kind is not null")
    wide = cells.where("cell_ix > 0").join(rows, [*keys, "row_ix"]).groupBy(*keys, "cell_ix").pivot("kind", ["question", "max", "score"]).agg(F.first("text"))
    number = F.coalesce(text.lenient_number(F.col("question")).cast("int"), F.col("cell_ix"))
    out = wide.select(*keys, number.alias("question"), text.lenient_number(F.col("max")).alias("max_score"), text.lenient_number(F.col("score")).alias("score"))
    return out.where("max_score is not null or score is not null")

"""Groups of students as they are entered, saved and checked; files, warnings and courses around them.

Rows of an exam come in groups that are saved one after the other. Blank student numbers are no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import ordered, rules


def numbered(rows: DataFrame) -> DataFrame:
    """rows(exam, group, position) with row_number within the group and technical_id, which goes on over an exam's groups.

    A large group is numbered in ranges of positions, so it isn't dealt to one task.
    """
    sizes = rows.groupBy("exam", "group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("exam").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("exam", "group", F.coalesce(before, F.lit(0)).alias("_before"))
    return row_numbers(rows).join(starts, ["exam", "group"]).withColumn("technical_id", F.format_string("Ö-%03d", F.col("_before") + F.col("row_number"))).drop("_before")


def row_numbers(rows: DataFrame) -> DataFrame:
    """rows(exam, group, position) with row_number within the group alone."""
    return ordered.running(rows, ["exam", "group"], ["position"], F.lit(1), "row_number").withColumn("row_number", F.col("row_number").cast("int"))


def padded(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows(exam, row_number, student_no) with blank rows up to the expected number of expected(exam, expected); more rows than that stay."""
    there = rows.groupBy("exam").agg(F.count("*").alias("n"))
    short = expected.join(there, "exam", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < expected")
    blank = short.select("exam", F.explode(F.sequence(F.col("n").cast("int") + 1, F.col("expected").cast("int"))).alias("row_number"))
    return rows.select("exam", "row_number", "student_no").unionByName(blank.withColumn("student_no", F.lit("")))


def student_issues(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """exam, position, code of rows(exam, position, student_no): no number, one that saved(exam, student_no) has, or an earlier row of the group."""
    named = rows.withColumn("student_no", text.first_useful(F.col("student_no")))
    known = saved.select("exam", text.first_useful(F.col("student_no")).alias("student_no")).where("student_no is not null").distinct()
    blank = named.where("student_no is null").withColumn("code", F.lit("NO_STUDENT_NUMBER"))
    good = named.where("student_no is not null")
    before = good.join(known, ["exam", "student_no"], "left_semi").withColumn("code", F.lit("SAVED_BEFORE"))
    again = rules.repeats(good, ["exam", "student_no"], ["position"]).withColumn("code", F.lit("REPEATED"))
    pick = lambda df: df.select("exam", "position", "code")
    return pick(blank).unionByName(pick(before)).unionByName(pick(again))


def count_status(saved: Column, current: Column, expected: Column) -> tuple[Column, Column]:
    """Whether saved and current students reach the expected number (at least 1): equal, over or under; and by how many not."""
    projected, wanted = saved + current, F.greatest(F.coalesce(expected, F.lit(1)), F.lit(1))
    status = F.when(projected == wanted, "equal").when(projected > wanted, "over").otherwise(F.lit("under"))
    return status, F.abs(projected - wanted)


def selected_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files(group, name, size, modified) of both, those incoming ones left out that existing has, and whether their group has too many."""
    same = ["group", "name", "size", "modified"]
    both = existing.select(*same).unionByName(incoming.select(*same).join(existing.select(*same), same, "left_anti"))
    many = both.groupBy("group").agg((F.count("*") > rules.MAX_FILES).alias("too_many"))
    return both.join(many, "group")


def course_options(choices: DataFrame, courses: DataFrame, additions: DataFrame, other: str) -> DataFrame:
    """choice, course: distinct courses for choices(choice, stage, school_type, course_type), the school type's and the entry other with them.

    courses(stage, course_type, course), additions(school_type, course). Without stage or course type there are none.
    """
    asked = choices.where((F.coalesce("stage", F.lit("")) != "") & (F.coalesce("course_type", F.lit("")) != ""))
    base = asked.join(courses, ["stage", "course_type"]).select("choice", "course")
    added = asked.join(additions, "school_type").select("choice", "course")
    return base.unionByName(added).unionByName(asked.select("choice", F.lit(other).alias("course"))).distinct()


def resolved(warnings: DataFrame, rows: DataFrame) -> DataFrame:
    """warnings(source) with resolved: rows(source, cells array<string>) has rows of the source and all their cells are filled."""
    full = rows.groupBy("source").agg(F.bool_and(F.forall("cells", text.useful)).alias("resolved"))
    return warnings.join(full, "source", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def scoring_model(questions: DataFrame) -> DataFrame:
    """exam, total, weights (question to maximum) and answer_key_present, from questions(exam, question, max_score, answer_key), once each."""
    has = F.coalesce(F.col("answer_key"), F.lit("")) != ""
    entries = F.array_sort(F.collect_list(F.struct("question", "max_score")))
    return questions.groupBy("exam").agg(F.sum(F.col("max_score").cast("decimal(28,6)")).cast("double").alias("total"), F.map_from_entries(entries).alias("weights"), F.bool_and(has).alias("answer_key_present"))


def titled(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """links(outcome) with the title from outcomes(outcome, title); the outcome itself where it has none."""
    return links.join(outcomes.select("outcome", "title"), "outcome", "left").withColumn("title", F.coalesce("title", F.col("outcome").cast("string")))


def missing_paths(payloads: DataFrame, keys: list[str], paths: list[str]) -> DataFrame:
    """keys and path of each required path, nested ones with points, that is null or empty in a row."""
    gone = F.filter(F.array(*[F.when(F.coalesce(F.col(p).cast("string"), F.lit("")) == "", F.lit(p)) for p in paths]), lambda x: x.isNotNull())
    return payloads.select(*keys, F.explode(gone).alias("path"))


def shape(json: Column) -> tuple[Column, Column]:
    """What a JSON text is (object, array or value) and its keys, the number of its elements or its text."""
    first = F.substring(F.ltrim(json), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").otherwise(F.lit("value"))
    return kind, F.when(first == "{", F.array_join(F.json_object_keys(json), ",")).when(first == "[", F.json_array_length(json).cast("string")).otherwise(F.trim(json))


def without_program(chunks: DataFrame, program: str | None = None) -> DataFrame:
    """The chunks that stay when a program's are deleted, those without a program included; without one named none stays."""
    return chunks.where(F.lit(False)) if program is None else chunks.where(~F.col("program").eqNullSafe(program))


def found_grades(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys and their distinct grades, sorted; sections(keys, grade)."""
    return sections.groupBy(*keys).agg(F.array_sort(F.collect_set("grade")).alias("grades"))

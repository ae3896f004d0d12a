"""From approved payloads to flat tables: questions with weighted outcomes, students with checked scores, completeness.

A payload table has one row for each exam: exam (id), course, grade, component, questions array, students array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import rules

# fixed values: fields of an outcome, and fields of a report that must be there with their aliases
OUTCOME_FIELDS = ["outcomeCode", "outcomeDescription", "outcomeTheme", "outcomeSkill", "parentOutcomeCode", "parentOutcomeDescription", "outcomeKey"]
REQUIRED = {
    "school": ["schoolName", "school", "institutionName"], "teacher": ["teacherName", "teacher", "teacherFullName"], "course": ["courseName", "course"],
    "class": ["classSection", "grade", "className"], "province": ["province", "city"], "district": ["district", "town"], "year": ["academicYear", "educationYear"],
    "term": ["term"], "sequence": ["examSequence"], "date": ["examDate"], "program": ["teachingProgram", "curriculumName"],
}

_OUTCOME = "struct<" + ", ".join(f"{f}: string" for f in OUTCOME_FIELDS) + ">"
QUESTION = "number: string, maxScore: string, " + ", ".join(f"{f}: string" for f in OUTCOME_FIELDS) + f", outcomes: array<{_OUTCOME}>"
STUDENT = "rowNumber: int, studentRef: string, scores: array<double>, totalScore: double"
PAYLOAD = f"exam string, course string, grade string, component string, questions array<struct<{QUESTION}>>, students array<struct<{STUDENT}>>, correctedCells map<string, string>"


def _outcome(x: Column) -> Column:
    return F.struct(*[F.trim(F.coalesce(x[f], F.lit(""))).alias(f) for f in OUTCOME_FIELDS])


def outcomes_of(question: Column) -> Column:
    """The outcomes of a question: those of its list that say anything, else the question's own if it has code, description or key."""
    said = lambda x, names: F.exists(F.array(*[F.coalesce(x[n], F.lit("")) != "" for n in names]), lambda b: b)
    listed = F.filter(F.coalesce(question["outcomes"], F.array().cast(f"array<{_OUTCOME}>")), lambda x: said(x, OUTCOME_FIELDS))
    own = F.when(said(question, ["outcomeCode", "outcomeDescription", "outcomeKey"]), F.array(_outcome(question))).otherwise(F.array().cast(f"array<{_OUTCOME}>"))
    return F.when(F.size(listed) > 0, F.transform(listed, _outcome)).otherwise(own)


def questions(payloads: DataFrame) -> DataFrame:
    """exam, question (position from 0), number, max_score, outcomes; the number is the position from 1 where none is given."""
    rows = payloads.select("exam", F.posexplode("questions").alias("question", "q"))
    number = text.given_number(F.col("q.number"), F.col("question") + F.lit(1.0)).cast("int")
    return rows.select("exam", "question", number.alias("number"), text.given_number(F.col("q.maxScore")).alias("max_score"), outcomes_of(F.col("q")).alias("outcomes"))


def links(rows: DataFrame) -> DataFrame:
    """exam, question, outcome (key), weight, code, theme, description of questions(): equal weights; without outcomes the question itself."""
    none = F.array(F.struct(*[F.lit("").alias(f) for f in OUTCOME_FIELDS]))
    every = rows.select("exam", "question", "number", F.explode(F.when(F.size("outcomes") > 0, F.col("outcomes")).otherwise(none)).alias("o"), F.greatest(F.size("outcomes"), F.lit(1)).alias("n"))
    key = text.outcome_key(F.col("o.outcomeKey"), F.col("o.outcomeTheme"), F.col("o.outcomeCode"), F.col("number"))
    return every.select("exam", "question", key.alias("outcome"), (F.lit(1.0) / F.col("n")).alias("weight"), F.col("o.outcomeCode").alias("code"), F.col("o.outcomeTheme").alias("theme"), F.col("o.outcomeDescription").alias("description"))


def students(payloads: DataFrame) -> DataFrame:
    """exam, student (position), student_ref, scores, max_scores, total (the sum where none is given)."""
    most = F.transform("questions", lambda q: text.given_number(q["maxScore"]))
    rows = payloads.select("exam", most.alias("max_scores"), F.posexplode("students").alias("student", "s"))
    added = F.round(F.aggregate("s.scores", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 2)
    return rows.select("exam", "student", F.trim("s.studentRef").alias("student_ref"), F.col("s.scores").alias("scores"), "max_scores", F.coalesce("s.totalScore", added).alias("total"))


def scores(rows: DataFrame) -> DataFrame:
    """Long scores (exam, student, question, score) of students(): the place in the list is the question."""
    return rows.select("exam", "student", F.posexplode("scores").alias("question", "score"))


def scored(rows: DataFrame) -> DataFrame:
    """exam, question of scores(), each once: an exam's longest list of scores has them all, so scores needn't be told apart one by one."""
    most = rows.groupBy("exam").agg(F.max(F.size("scores")).alias("n")).where("n > 0")
    return most.select("exam", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("question"))


def payload_issues(payloads: DataFrame) -> DataFrame:
    """exam, place, code, severity: what a payload, its questions and its students break."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    gates = [rules.Rule("NO_QUESTIONS", "error", empty("questions")), rules.Rule("NO_STUDENTS", "error", empty("students")), rules.Rule("COMPONENT", "error", ~F.coalesce(F.col("component").isin("written", "listening", "speaking", "general"), F.lit(False)))]
    whole = rules.issues(payloads, ["exam"], gates).select("exam", F.lit("exam").alias("place"), "code", "severity")
    asked = questions(payloads).withColumn("place", F.concat(F.lit("question "), (F.col("question") + 1).cast("string")))
    bad = rules.issues(asked, ["exam", "place"], [rules.Rule("MAX_SCORE", "error", ~F.coalesce(F.col("max_score") > 0, F.lit(False)))])
    there = students(payloads).withColumn("place", F.concat(F.lit("student "), (F.col("student") + 1).cast("string")))
    return whole.unionByName(bad).unionByName(rules.issues(there, ["exam", "place"], rules.student_rules()))


def missing_fields(exams: DataFrame) -> DataFrame:
    """The exams with the required fields that no alias has a useful value for, as a sorted array."""
    names = {c.lower(): c for c in exams.columns}
    gone = []
    for field, aliases in REQUIRED.items():
        held = [text.useful(F.col(names[a.lower()]).cast("string")) for a in aliases if a.lower() in names]
        there = held[0] if held else F.lit(False)
        for h in held[1:]:
            there = there | h
        gone.append(F.when(~there, F.lit(field)))
    return exams.withColumn("missing", F.array_sort(F.filter(F.array(*gone), lambda x: x.isNotNull())))


def conflict(a: Column, b: Column) -> Column:
    """Whether two useful texts say different things: neither has the other in it, but for case and accents."""
    x, y = text.compare_fold(a), text.compare_fold(b)
    return text.useful(a) & text.useful(b) & (x != y) & ~F.contains(x, y) & ~F.contains(y, x)


def filled(current: Column, source: Column, detected: Column, default: Column) -> tuple[Column, Column]:
    """A field's value and where it is from: detected unless the teacher wrote it, a default only for a blank."""
    take = text.useful(detected) & ~F.coalesce(source == "teacher", F.lit(False))
    blank = ~text.useful(detected) & ~text.useful(current) & text.useful(default)
    return F.when(take, detected).when(blank, default).otherwise(current), F.when(take, "document").when(blank, "context").otherwise(source)


def structuring(asked: DataFrame) -> DataFrame:
    """Per exam of questions(exam, question, text, max_score, answer_key): total, counts of what is missing, codes of what that means."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out = asked.groupBy("exam").agg(
        F.count("*").alias("questions"), F.sum(F.coalesce("max_score", F.lit(0.0)).cast("decimal(28,6)")).cast("double").alias("total"), F.count_if(blank("text")).alias("blank_texts"),
        F.count_if(F.coalesce("max_score", F.lit(0.0)) <= 0).alias("without_score"), F.bool_and(~blank("answer_key")).alias("has_answer_key"),
    )
    return out.withColumn("codes", F.filter(F.array(F.when(F.col("without_score") > 0, "MISSING_SCORE"), F.when(~F.col("has_answer_key"), "MISSING_ANSWER_KEY")), lambda x: x.isNotNull()))


#: Confidence of a reading below which it is low.
CONFIDENCE = 0.6


def structured(documents: DataFrame, asked: DataFrame, students: DataFrame) -> DataFrame:
    """Per exam of documents(exam, confidence, broken_tables, warnings array): what structuring() counts, students, repeated student numbers, codes of missing information, warnings.

    asked as in structuring(), students(exam, student_no). Exams without questions or students have codes for that; confidence counts as 0 where there is none. warnings are the
    document's and then the codes. Repeated numbers are sorted, each once; blank ones don't count.
    """
    number = F.trim(F.coalesce("student_no", F.lit("")))
    by_number = students.groupBy("exam", number.alias("no")).agg(F.count("*").alias("n"))
    of_exam = by_number.groupBy("exam").agg(F.sum("n").alias("students"), F.array_sort(F.collect_list(F.when((F.col("no") != "") & (F.col("n") > 1), F.col("no")))).alias("repeated"))
    out = documents.join(structuring(asked).drop("codes"), "exam", "left").join(of_exam, "exam", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    confidence = F.coalesce("confidence", F.lit(0.0))
    codes = [
        F.when(zero("questions") == 0, "MISSING_QUESTION"), F.when(zero("without_score") > 0, "MISSING_SCORE"), F.when(~F.coalesce("has_answer_key", F.lit(True)), "MISSING_ANSWER_KEY"),
        F.when(zero("students") == 0, "MISSING_STUDENT"), F.when(zero("broken_tables") > 0, "BROKEN_TABLE"), F.when(F.isnan(confidence) | (confidence < CONFIDENCE), "LOW_CONFIDENCE"),
    ]
    codes = F.filter(F.array(*codes), lambda x: x.isNotNull())
    return out.select(
        "exam", confidence.alias("confidence"), zero("questions").alias("questions"), F.coalesce("total", F.lit(0.0)).alias("total"), zero("blank_texts").alias("blank_texts"), zero("without_score").alias("without_score"),
        F.coalesce("has_answer_key", F.lit(True)).alias("has_answer_key"), zero("students").alias("students"), F.coalesce("repeated", F.array().cast("array<string>")).alias("repeated"), codes.alias("codes"),
        F.concat(F.coalesce("warnings", F.array().cast("array<string>")), codes).alias("warnings"),
    )


def mapping(rows: DataFrame) -> DataFrame:
    """Per exam of links(): how many outcomes its questions have, and how many questions have no outcome with a code."""
    coded = rows.groupBy("exam", "question").agg(F.bool_or(F.col("code") != "").alias("coded"))
    counts = coded.groupBy("exam").agg(F.count("*").alias("questions"), F.count_if(~F.col("coded")).alias("unmapped"))
    return counts.join(rows.groupBy("exam").agg(F.countDistinct("outcome").alias("outcomes")), "exam")

"""Teaching programs, weighting profiles and outcome catalogs as small dimension tables, and joins to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text, unicode

# fixed values: courses and weights of each profile, programs, skills of each component
PROFILES = {
    "tde-70-15-15": (["Türk Dili ve Edebiyatı", "Seçmeli Türk Dili ve Edebiyatı"], {"written": 0.70, "listening": 0.15, "speaking": 0.15}),
    "language-50-25-25": (["Türkçe", "Yabancı Dil", "Birinci Yabancı Dil", "İkinci Yabancı Dil", "İngilizce", "Almanca", "Fransızca", "Arapça", "Mesleki Arapça", "Rusça", "İspanyolca", "İtalyanca", "Çince", "Japonca", "Farsça"], {"written": 0.50, "listening": 0.25, "speaking": 0.25}),
}
PROGRAMS = [("tde-9-tymm", ["Türk Dili ve Edebiyatı", "Seçmeli Türk Dili ve Edebiyatı"], "9", "TDE")]
SKILLS = {"written": ["Okuma", "Yazma"], "listening": ["Dinleme/İzleme"], "speaking": ["Konuşma"]}
#: Keywords that are sent to all tasks, at most.
KEYWORDS = 10_000
OF_SKILLS = [(["dinleme/izleme", "dinleme", "izleme"], "listening"), (["konusma"], "speaking"), (["okuma", "yazma"], "written")]


def _dimension(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of literals: rows of Python objects would pass through a Python worker for each core."""
    value = lambda v: F.create_map(*[F.lit(x) for pair in v.items() for x in pair]) if isinstance(v, dict) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[value(v).alias(k) for k, v in row.items()]) for row in rows])))


def profiles(spark: SparkSession) -> DataFrame:
    return _dimension(spark, [{"profile": k, "weights": w, "course_key": unicode.COURSE.of(c)} for k, (courses, w) in PROFILES.items() for c in courses])


def _known_courses(exams: DataFrame, fold: Callable[[Column], Column], dim: DataFrame) -> DataFrame:
    """course and what dim has for it, for the courses as they are written in exams(course) and whose fold is a course_key of dim.

    Each spelling is folded once, however many exams have it: a fold passes all its rows through Python.
    """
    many = exams.groupBy("course").agg(F.count("*").alias("n"))
    written = many.select("course", fold(F.when(F.col("n") > 0, F.col("course"))).alias("course_key"))  # n keeps conditions on the fold from being put to all rows
    return written.join(F.broadcast(dim), "course_key").drop("course_key")


def with_profile(exams: DataFrame) -> DataFrame:
    """exams(course) with profile and weights; null where the course has none. The dimension has a fixed number of rows; spellings of its courses go to all tasks."""
    known = _known_courses(exams, text.course_fold, profiles(exams.sparkSession))
    return exams.join(F.broadcast(known), "course", "left").select(*exams.columns, "profile", "weights")


def with_program(exams: DataFrame) -> DataFrame:
    """exams(course, grade) with program and outcome_prefix; null where there is none. The dimension has a fixed number of rows; spellings of its courses go to all tasks."""
    dim = _dimension(exams.sparkSession, [{"program": p, "course_key": unicode.CATALOG.of(c), "grade_key": g, "outcome_prefix": x} for p, courses, g, x in PROGRAMS for c in courses])
    known = _known_courses(exams, text.catalog_fold, dim)
    keyed = exams.withColumn("grade_key", text.grade_base(F.trim("grade")))
    return keyed.join(F.broadcast(known), ["course", "grade_key"], "left").select(*exams.columns, "program", "outcome_prefix")


def request_issues(requests: DataFrame) -> DataFrame:
    """exam, code of what stops requests(exam, course, component, profile, questions, students, component_analyses) before any analysis; the first of these only:

    COMPONENT (not written, listening, speaking or general; a blank one is written), UNKNOWN_PROFILE, FOREIGN_PROFILE (not the course's), NEEDS_LANGUAGE_COURSE (a course without a
    profile has written exams only), NO_COMPONENT_ANALYSES (general), NO_QUESTIONS and NO_STUDENTS (all but general). The last three columns count what is there.
    """
    rows = with_profile(requests.withColumn("asked", F.trim(F.coalesce("profile", F.lit("")))).drop("profile"))
    component = F.coalesce(text.blank_to_null(F.col("component")), F.lit("written"))
    general, there = component == "general", lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    code = (
        F.when(~component.isin("written", "listening", "speaking", "general"), "COMPONENT").when((F.col("asked") != "") & ~F.col("asked").isin(list(PROFILES)), "UNKNOWN_PROFILE")
        .when((F.col("asked") != "") & ~F.coalesce(F.col("profile") == F.col("asked"), F.lit(False)), "FOREIGN_PROFILE").when(F.col("profile").isNull() & (component != "written"), "NEEDS_LANGUAGE_COURSE")
        .when(general & ~there("component_analyses"), "NO_COMPONENT_ANALYSES").when(~general & ~there("questions"), "NO_QUESTIONS").when(~general & ~there("students"), "NO_STUDENTS")
    )
    return rows.select("exam", code.alias("code")).where("code is not null")


def foreign_codes(links: DataFrame, exams: DataFrame) -> DataFrame:
    """exam, question, code of links(exam, question, outcome, code) whose code belongs to another course's program."""
    known = with_program(exams).select("exam", "program", "outcome_prefix")
    joined = links.join(known, "exam")
    own = F.upper("code").startswith("TDE") | F.lower("outcome").startswith("tema")
    wrong = F.col("program").isNotNull() & (F.col("code") != "") & ~F.upper("code").startswith(F.col("outcome_prefix"))
    return joined.where((own & F.col("program").isNull()) | wrong).select("exam", "question", "code")


def component_of_skills(skills: Column) -> Column:
    """The component whose skills a set of skills is part of; null if none or the set is empty."""
    folded = F.filter(F.array_distinct(text.skill_folds(skills)), lambda s: s != "")
    out = F.lit(None).cast("string")
    for names, component in reversed(OF_SKILLS):
        out = F.when((F.size(folded) > 0) & (F.size(F.array_except(folded, F.array(*[F.lit(n) for n in names]))) == 0), component).otherwise(out)
    return out


def catalog(outcomes: DataFrame, component: str) -> DataFrame:
    """Outcomes of a component's skills; one with process components becomes those, with ids from its own and their codes.

    outcomes(id, code, title, theme, skill, processComponents array<struct<code, title>>).
    """
    mine = outcomes.where(F.col("skill").isin(SKILLS.get(component, [])))
    rows = mine.select("*", F.explode_outer("processComponents").alias("p"))
    child = F.concat_ws("-", "id", F.regexp_replace(F.lower(F.translate("p.code", "Iİ", "ıi")), "[^a-z0-9]+", "-"))
    pick = lambda a, b: F.when(F.col("p").isNotNull(), a).otherwise(b)
    return rows.select(pick(child, F.col("id")).alias("id"), pick(F.col("p.code"), F.col("code")).alias("code"), pick(F.col("p.title"), F.col("title")).alias("title"), "theme", "skill", pick(F.col("code"), F.lit(None)).alias("parent_code"), pick(F.col("title"), F.lit(None)).alias("parent_title"))


def keyword_links(questions: DataFrame, outcomes: DataFrame, fallback: str) -> DataFrame:
    """question_id, outcome_id: outcomes with a keyword in the question's text, else the fallback.

    questions(question_id, text), outcomes(outcome_id, keywords). Keywords meet the text's runs of up to three characters by an equi-join on
    their first three (a shorter one as a whole), so the pairs of questions and outcomes are never all made. Keywords go to all tasks while they are at most
    KEYWORDS. Questions without an outcome are told from the same pass: each question meets its outcomes by its id, in no join.
    """
    words = questions.select("question_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    keys = outcomes.select("outcome_id", F.explode("keywords").alias("k")).select("outcome_id", F.lower("k").alias("k")).where("k <> ''").distinct()

    def runs(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("t") - size + 1), lambda i: F.substring(F.col("t"), i, F.lit(size)))
        return F.when(F.length("t") >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    grams = words.select("question_id", "t", F.explode(F.concat(*[runs(n) for n in (1, 2, 3)])).alias("g"))
    keys = keys.withColumn("g", F.substring("k", 1, 3))
    few = keys.limit(KEYWORDS + 1).count() <= KEYWORDS
    found = grams.join(F.broadcast(keys) if few else keys, "g").where(F.contains(F.col("t"), F.col("k"))).select("question_id", "outcome_id")
    every = questions.select("question_id", F.lit(None).cast("string").alias("outcome_id"))
    met = found.unionByName(every).groupBy("question_id").agg(F.collect_set("outcome_id").alias("o"))  # nulls are left out
    return met.select("question_id", F.explode(F.when(F.size("o") > 0, F.col("o")).otherwise(F.array(F.lit(fallback)))).alias("outcome_id"))

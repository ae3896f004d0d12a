"""Question and outcome success, evidence, totals, composites: aggregates over long score tables.

A score table has one row for each exam, student and question. Sums are of decimals, so they don't depend on how rows are dealt
to tasks. A division by zero gives the rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import bands

DECIMAL = "decimal(28,6)"


def rate(earned: Column, possible: Column) -> Column:
    return F.coalesce(F.try_divide(earned, possible), F.lit(0.0))


def question_totals(scores: DataFrame, questions: DataFrame, students: DataFrame) -> DataFrame:
    """Earned and possible points of each question: possible is its maximum times the number of all students of the exam.

    scores(exam, student, question, score), questions(exam, question, max_score), students(exam, student): missing scores count as zero; of
    scores that a student has twice for a question the first in order of position counts, if the column position is there, else the least.
    """
    first = F.min_by("score", "position") if "position" in scores.columns else F.min("score")
    once = scores.groupBy("exam", "student", "question").agg(first.alias("score"))
    earned = once.groupBy("exam", "question").agg(F.sum(F.col("score").cast(DECIMAL)).cast("double").alias("earned"))
    many = students.groupBy("exam").agg(F.countDistinct("student").alias("students"))
    joined = questions.join(many, "exam", "left").join(earned, ["exam", "question"], "left")
    return joined.select("exam", "question", "max_score", F.coalesce("students", F.lit(0)).alias("students"), F.coalesce("earned", F.lit(0.0)).alias("earned"), (F.col("max_score") * F.coalesce("students", F.lit(0))).alias("possible")).withColumn("rate", rate(F.col("earned"), F.col("possible")))


def outcome_totals(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Weighted sums over the questions of each outcome: questions(exam, question, earned, possible), links(exam, question, outcome, weight)."""
    joined = links.join(questions, ["exam", "question"])
    weigh = lambda c: F.sum((F.col(c) * F.col("weight")).cast(DECIMAL)).cast("double")
    out = joined.groupBy("exam", "outcome").agg(weigh("earned").alias("earned"), weigh("possible").alias("possible"), F.countDistinct("question").alias("questions"))
    return out.withColumn("rate", rate(F.col("earned"), F.col("possible"))).withColumn("level", bands.level(F.col("rate"))).withColumn("decision", bands.decision(F.col("rate")))


def evidence_totals(rows: DataFrame) -> DataFrame:
    """outcome_totals() of the rows of evidence(), whose questions have the weighted points: nothing is joined or dealt again."""

    def added(name: str) -> Column:
        points = F.filter(F.transform("questions", lambda q: q[name].cast(DECIMAL)), lambda x: x.isNotNull())
        return F.when(F.size(points) > 0, F.aggregate(points, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)"))).cast("double")

    out = rows.select("exam", "outcome", added("earned").alias("earned"), added("possible").alias("possible"), F.size(F.array_distinct(F.transform("questions", lambda q: q["question"]))).cast("long").alias("questions"))
    return out.withColumn("rate", rate(F.col("earned"), F.col("possible"))).withColumn("level", bands.level(F.col("rate"))).withColumn("decision", bands.decision(F.col("rate")))


def equal_links(questions: DataFrame) -> DataFrame:
    """Links with equal weights from questions(exam, question, outcomes array<string>): 1 / n for each of n."""
    return questions.select("exam", "question", F.explode("outcomes").alias("outcome"), (F.lit(1.0) / F.size("outcomes")).alias("weight"))


def evidence(questions: DataFrame, links: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """For each outcome the questions behind it in order, with points, and the corrected cells of them all.

    corrected(exam, question, cells) is optional. A question that is linked twice is listed twice.
    """
    joined = links.join(questions, ["exam", "question"])
    joined = joined.withColumn("cells", F.lit(0)) if corrected is None else joined.join(corrected, ["exam", "question"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    item = F.struct("question", (F.col("earned") * F.col("weight")).alias("earned"), (F.col("possible") * F.col("weight")).alias("possible"), "cells")
    return joined.groupBy("exam", "outcome").agg(F.array_sort(F.collect_list(item)).alias("questions"), F.sum("cells").alias("corrected_cells"))


def answer_scores(answers: DataFrame, questions: DataFrame, students: DataFrame) -> DataFrame:
    """Scores from answer keys: the maximum where the answers are alike but for case and outer space, else 0; a missing answer is wrong."""
    grid = students.join(questions, "exam").join(answers, ["exam", "student", "question"], "left")
    same = F.lower(F.trim(F.coalesce("answer", F.lit("")))) == F.lower(F.trim("answer_key"))
    return grid.select("exam", "student", "question", F.when(same, F.col("max_score")).otherwise(F.lit(0.0)).alias("score"))


def student_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("exam", "student").agg(F.round(F.sum(F.col("score").cast(DECIMAL)), 2).cast("double").alias("total"))


def class_summary(totals: DataFrame, most: Column) -> DataFrame:
    """Average, least, greatest total, those at half of most or above and below, and the level of the unrounded average."""
    at_half = F.col("total") >= most * 0.5
    average = F.sum(F.col("total").cast(DECIMAL)).cast("double") / F.count("*")
    return totals.withColumn("most", most).groupBy("exam").agg(
        F.count("*").alias("students"), average.alias("average"), F.min("total").alias("least"), F.max("total").alias("greatest"),
        F.count_if(at_half).alias("passed"), F.count_if(~at_half).alias("failed"), F.first("most").alias("most"),
    ).withColumn("level", bands.level(rate(F.col("average"), F.col("most"))))


def composite(components: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted total of students who have all components: components(class, student, component, total)."""
    names = sorted(weights)
    wide = components.groupBy("class", "student").pivot("component", names).agg(F.sum(F.col("total").cast(DECIMAL))).dropna(subset=names)
    total = sum((F.col(f"`{n}`") * F.lit(str(weights[n])).cast("decimal(6,4)") for n in names[1:]), F.col(f"`{names[0]}`") * F.lit(str(weights[names[0]])).cast("decimal(6,4)"))
    return wide.select("class", "student", F.round(total, 2).cast("double").alias("composite"))


def cohort_mismatch(components: DataFrame, required: list[str]) -> DataFrame:
    """Students of a class who lack one of the required components, with those that they lack."""
    seen = components.groupBy("class", "student").agg(F.collect_set("component").alias("seen"))
    return seen.select("class", "student", F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "seen")).alias("missing")).where(F.size("missing") > 0)


def component_results(components: DataFrame, weights: dict[str, float], given: DataFrame | None = None) -> DataFrame:
    """Average, weight and weighted contribution of each component of each class.

    given(class, component, average): averages that reports bring along; they count where they are, else the mean of the students. A component that has a given average and no
    students has 0 of them.
    """
    weight = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))])[F.col("component")]
    average = F.sum(F.col("total").cast(DECIMAL)).cast("double") / F.count("*")
    out = components.groupBy("class", "component").agg(average.alias("average"), F.count("*").alias("students"))
    if given is not None:
        brought = given.where("average is not null").groupBy("class", "component").agg(F.max("average").alias("_given"))
        out = out.join(brought, ["class", "component"], "full").select("class", "component", F.coalesce("_given", "average").alias("average"), F.coalesce("students", F.lit(0)).alias("students"))
    return out.withColumn("weight", weight).withColumn("contribution", F.col("average") * F.col("weight")).withColumn("most", 100 * F.col("weight"))


def reports(exams: DataFrame, questions: DataFrame, students: DataFrame, profiles: DataFrame) -> DataFrame:
    """The head of each exam's report: exams(exam, component, profile) with component_weight (of profiles(profile, weights); null without a profile), counts, exam_max, class_average, rate.

    questions(exam, max_score), students(exam, total). Exams without students have no average, those without points the rate 0. The average is rounded to two places, its rate isn't.
    """
    asked = questions.groupBy("exam").agg(F.count("*").alias("question_count"), F.sum(F.col("max_score").cast(DECIMAL)).cast("double").alias("exam_max"))
    there = students.groupBy("exam").agg(F.count("*").alias("student_count"), (F.sum(F.col("total").cast(DECIMAL)).cast("double") / F.count("*")).alias("average"))
    known = F.broadcast(profiles.select("profile", "weights").dropDuplicates(["profile"]))  # a fixed dimension
    rows = exams.join(known, "profile", "left").join(asked, "exam", "left").join(there, "exam", "left")
    most = F.coalesce("exam_max", F.lit(0.0))
    return rows.select(
        "exam", "component", "profile", F.try_element_at("weights", F.col("component")).alias("component_weight"), F.coalesce("question_count", F.lit(0)).alias("question_count"), F.coalesce("student_count", F.lit(0)).alias("student_count"),
        most.alias("exam_max"), F.round("average", 2).alias("class_average"), F.when(F.col("average").isNotNull(), F.coalesce(F.try_divide("average", most), F.lit(0.0))).alias("rate"),
    )


def anomalies(questions: DataFrame, near: float = 0.05) -> DataFrame:
    """Questions that nearly nobody or nearly everybody solved, and those whose rate equals another one's in the exam."""
    w = Window.partitionBy("exam", "rate")
    flags = F.array_join(F.filter(F.array(
        F.when(F.col("rate") <= near, F.lit("near_zero")), F.when(F.col("rate") >= 1 - near, F.lit("near_full")), F.when(F.count("*").over(w) > 1, F.lit("equal_rate")),
    ), lambda x: x.isNotNull()), ",")
    return questions.withColumn("flags", flags).where("flags <> ''")

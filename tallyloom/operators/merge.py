"""General evaluation: the reports of three components of one class, checked against each other and combined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import measure

# fixed values: components that a class needs, and context that its reports must agree in
COMPONENTS = ["listening", "speaking", "written"]
CONTEXT = ["school", "course", "class_section", "year", "term"]


def report_issues(reports: DataFrame) -> DataFrame:
    """class, code of classes whose reports(class, component, CONTEXT columns) can't be combined: unknown, repeated or missing
    components, context that lacks or differs."""
    known = F.col("component").isin(COMPONENTS)
    folded = [text.course_fold(F.col(c).cast("string")).alias(c) for c in CONTEXT]
    rows = reports.select("class", "component", *folded)
    gap = lambda c: F.bool_or(F.col(c) == "")
    # bits for components, least and greatest for texts: to count distinct ones would copy each row for each column
    bit = F.coalesce(*[F.when(F.col("component") == c, 1 << i) for i, c in enumerate(COMPONENTS)])
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    seen = rows.groupBy("class").agg(
        F.bool_or(~F.coalesce(known, F.lit(False))).alias("UNKNOWN_COMPONENT"), F.count(F.when(known, 1)).alias("_many"), F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0))).alias("_kinds"),
        *[gap(c).alias(f"NO_{c.upper()}") for c in CONTEXT], *[(F.min(said(c)) != F.max(said(c))).alias(f"DIFFERENT_{c.upper()}") for c in CONTEXT],
    )
    out = seen.withColumns({"REPEATED_COMPONENT": F.col("_many") > F.col("_kinds"), "MISSING_COMPONENT": F.col("_kinds") < len(COMPONENTS)}).drop("_many", "_kinds")
    codes = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in out.columns if c != "class"]), lambda x: x.isNotNull())
    return out.select("class", F.explode(codes).alias("code"))


def general(components: DataFrame, weights: dict[str, float]) -> DataFrame:
    """class, students, average (of the students' composites, each rounded), state: complete, missing (a component) or mismatch (cohorts)."""
    seen = components.groupBy("class").agg(F.countDistinct("component").alias("n"))
    off = measure.cohort_mismatch(components, sorted(weights)).groupBy("class").agg(F.count("*").alias("off"))
    scored = measure.composite(components, weights).groupBy("class").agg(F.count("*").alias("students"), F.round(F.avg(F.col("composite").cast("decimal(18,2)")), 2).cast("double").alias("average"))
    out = seen.join(off, "class", "left").join(scored, "class", "left")
    state = F.when(F.col("n") < len(weights), "missing").when(F.coalesce("off", F.lit(0)) > 0, "mismatch").otherwise(F.lit("complete"))
    return out.select("class", F.coalesce("students", F.lit(0)).alias("students"), F.when(state == "complete", F.col("average")).alias("average"), state.alias("state"))


def skill_evidence(outcomes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """outcomes(class, component, outcome, rate) of known components with weight and weighted contribution to four places."""
    weight = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))])[F.col("component")]
    return outcomes.withColumn("weight", weight).where("weight is not null").withColumn("contribution", F.round(F.col("rate") * F.col("weight"), 4))

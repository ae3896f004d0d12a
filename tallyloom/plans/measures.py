"""Queries of measures and composites. Students are customers or orders, questions line numbers, outcomes brands, components return flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import bands
from tallyloom.operators import corrections, measure, programs, reports, rules
from tallyloom.plans.registry import Registry, table

query = Registry()
WEIGHTS = {"written": 0.70, "listening": 0.15, "speaking": 0.15}

_LEVEL = "case when {0} >= 0.85 then 'Beklenen düzeyin üzerinde gelişmiş' when {0} >= 0.70 then 'Beklenen düzeyde gelişmiş' when {0} >= 0.50 then 'Gelişimi sürmekte' else 'İlave destek gerektiriyor' end"
_SHOWN = "case when {0} >= 0.85 then 'Beklenen düzeyin üzerinde' when {0} >= 0.70 then 'Beklenen düzeyde' when {0} >= 0.50 then 'Gelişimi sürmekte' else 'Gelişim desteği öncelikli' end"
_QUESTIONS = "select 'all' as exam, l_linenumber as question, sum(l_quantity) as earned, cast(50 * count(*) as double) as possible, sum(l_quantity) / cast(50 * count(*) as double) as rate from lineitem group by l_linenumber"
_OUTCOMES = "select p_brand as outcome, sum(l_quantity) as earned, cast(50 * count(*) as double) as possible, sum(l_quantity) / cast(50 * count(*) as double) as rate from lineitem join part on l_partkey = p_partkey group by p_brand"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = lines.groupBy(F.lit("all").alias("exam"), F.col("l_linenumber").alias("question")).agg(F.sum("l_quantity").alias("earned"), (F.count("*") * 50.0).alias("possible"))
    return out.withColumn("rate", measure.rate(F.col("earned"), F.col("possible")))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = joined.groupBy(F.col("p_brand").alias("outcome")).agg(F.sum("l_quantity").alias("earned"), (F.count("*") * 50.0).alias("possible"))
    return out.withColumn("rate", measure.rate(F.col("earned"), F.col("possible")))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Totals by nation, customer and component."""
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "written", "N", "listening", "R", "speaking")]), F.col("l_returnflag"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.groupBy(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("student"), name.alias("component")).agg(F.sum("l_quantity").alias("total"))


_COMPONENTS = "(select c_nationkey as class, c_custkey as student, case l_returnflag when 'A' then 'written' when 'N' then 'listening' when 'R' then 'speaking' end as component, sum(l_quantity) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all) t"


@query(f"select question, earned, possible, rate, {_LEVEL.format('rate')} as level from ({_QUESTIONS})")
def question_success(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).withColumn("level", bands.level(F.col("rate"))).drop("exam")


@query("with once as (select l_orderkey, l_linenumber, min(l_quantity) as score from lineitem group by all), n as (select count(distinct o_orderkey) as students from orders) select l_linenumber as question, sum(score) as earned, cast(students as bigint) as students, students * cast(50 as double) as possible, sum(score) / (students * cast(50 as double)) as rate from once, n group by l_linenumber, students")
def question_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.lit("all").alias("exam"), F.col("l_orderkey").alias("student"), F.col("l_linenumber").alias("question"), F.col("l_quantity").alias("score"))
    questions = lines.select("exam", "question").distinct().withColumn("max_score", F.lit(50.0))
    students = table(spark, d, "orders").select(F.lit("all").alias("exam"), F.col("o_orderkey").alias("student"))
    return measure.question_totals(lines, questions, students).select("question", "earned", "students", "possible", "rate")


@query(f"with q as ({_QUESTIONS}), links as (select distinct l_linenumber as question, outcome from lineitem join (select p_partkey, unnest([p_brand, p_type]) as outcome from part) on l_partkey = p_partkey) select outcome, sum(earned * 0.5::double) as earned, sum(possible * 0.5::double) as possible, sum(earned * 0.5::double) / sum(possible * 0.5::double) as rate, count(distinct question) as questions, {_LEVEL.format('(sum(earned * 0.5::double) / sum(possible * 0.5::double))')} as level from q join links using (question) group by outcome")
def outcome_success_weighted(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("outcomes"))
    linked = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("all").alias("exam"), F.col("l_linenumber").alias("question"), "outcomes").distinct()
    links = measure.equal_links(linked).distinct()
    return measure.outcome_totals(_rates(spark, d), links).select("outcome", "earned", "possible", "rate", "questions", "level")


@query(f"with q as ({_QUESTIONS}), links as (select distinct l_linenumber as question, p_brand as outcome from lineitem join part on l_partkey = p_partkey) select outcome, string_agg(cast(question as varchar) || ':' || cast(cast(earned as bigint) as varchar) || '/' || cast(cast(possible as bigint) as varchar), ';' order by question) as evidence, count(*) as questions from q join links using (question) group by outcome")
def outcome_evidence(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("outcome"))
    links = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("all").alias("exam"), F.col("l_linenumber").alias("question"), "outcome", F.lit(1.0).alias("weight")).distinct()
    found = measure.evidence(_rates(spark, d).drop("rate"), links)
    item = lambda q: F.concat(q["question"].cast("string"), F.lit(":"), q["earned"].cast("long").cast("string"), F.lit("/"), q["possible"].cast("long").cast("string"))
    return found.select("outcome", F.array_join(F.transform("questions", item), ";").alias("evidence"), F.size("questions").cast("long").alias("questions"))


@query("select o_custkey as student, sum(l_quantity) as total from lineitem join orders on l_orderkey = o_orderkey group by o_custkey")
def student_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return measure.student_totals(lines.select(F.lit("all").alias("exam"), F.col("o_custkey").alias("student"), F.col("l_quantity").alias("score"))).select("student", "total")


@query(f"with t as (select c_nationkey as exam, c_custkey as student, sum(l_quantity) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all) select exam, count(*) as students, sum(total) / count(*) as average, min(total) as least, max(total) as greatest, count(*) filter (total >= 1000) as passed, count(*) filter (total < 1000) as failed, {_LEVEL.format('(sum(total) / count(*) / 2000)')} as level from t group by exam")
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = measure.student_totals(lines.select(F.col("c_nationkey").alias("exam"), F.col("c_custkey").alias("student"), F.col("l_quantity").alias("score")))
    return measure.class_summary(totals, F.lit(2000.0)).drop("most")


@query(f"with w as (select class, student, cast(sum(total) filter (component = 'written') as bigint) as a, cast(sum(total) filter (component = 'listening') as bigint) as b, cast(sum(total) filter (component = 'speaking') as bigint) as c from {_COMPONENTS} group by class, student) select class, student, (70 * a + 15 * b + 15 * c) / 100.0::double as composite from w where a is not null and b is not null and c is not null")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    return measure.composite(_components(spark, d), WEIGHTS)


@query(f"with r as (select unnest(['listening', 'speaking', 'written']) as component), s as (select distinct class, student from {_COMPONENTS}) select class, student, string_agg(component, ',' order by component) as missing from s, r where not exists (select 1 from {_COMPONENTS} where t.student = s.student and t.component = r.component) group by class, student")
def cohort_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return measure.cohort_mismatch(_components(spark, d), sorted(WEIGHTS)).withColumn("missing", F.array_join("missing", ","))


@query(f"select class, component, sum(total) / count(*) as average, count(*) as students, case component when 'written' then 0.70::double else 0.15::double end as weight, sum(total) / count(*) * case component when 'written' then 0.70::double else 0.15::double end as contribution from {_COMPONENTS} group by class, component")
def component_results(spark: SparkSession, d: str) -> DataFrame:
    return measure.component_results(_components(spark, d), WEIGHTS).drop("most")


@query(f"with o as ({_OUTCOMES}) select {_SHOWN.format('rate')} as level, string_agg(outcome, ', ' order by outcome) as outcomes, count(*) as many from o group by 1")
def band_lists(spark: SparkSession, d: str) -> DataFrame:
    return reports.level_lists(_outcomes(spark, d), []).select("level", "outcomes", "many")


@query("with o as (select l_returnflag as component, p_brand as outcome, sum(l_quantity) / cast(50 * count(*) as double) + 0.19::double as rate from lineitem join part on l_partkey = p_partkey group by all) select component, coalesce(string_agg(outcome, ', ' order by outcome) filter (rate >= 0.70), '') as strong, coalesce(string_agg(outcome, ', ' order by outcome) filter (rate < 0.70), '') as weak from o group by component")
def component_pivot(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rate = F.sum("l_quantity") / (F.count("*") * 50.0) + 0.19
    return reports.strong_and_weak(joined.groupBy(F.col("l_returnflag").alias("component"), F.col("p_brand").alias("outcome")).agg(rate.alias("rate")))


@query(f"with o as ({_OUTCOMES}) select {_LEVEL.format('rate')} as level, case when rate < 0.5 then 'critical' else 'medium' end as severity, count(*) as many, count(*) filter (rate < 0.7) as weak from o group by all")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("rate")
    return _outcomes(spark, d).groupBy(bands.level(rate).alias("level"), bands.severity(rate).alias("severity")).agg(F.count("*").alias("many"), F.count_if(rate < bands.WEAK).alias("weak"))


@query("select l_orderkey, l_linenumber, code, 'error' as severity from (select l_orderkey, l_linenumber, unnest([case when l_quantity > 45 then 'SCORE_RANGE' end, case when l_discount = 0 then 'NO_DISCOUNT' end, case when l_tax > 0.07 then 'TAX' end]) as code from lineitem) where code is not null")
def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    found = [rules.Rule("SCORE_RANGE", "error", F.col("l_quantity") > 45), rules.Rule("NO_DISCOUNT", "error", F.col("l_discount") == 0), rules.Rule("TAX", "error", F.col("l_tax") > 0.07)]
    return rules.issues(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], found)


@query("with s as (select user_id as document, case when value >= 1 then value end as score, event_type from events) select document, count(*) as row_count, count(*) filter (score is null) as empty_cells, count(*) filter (event_type = 'error') as mismatches, case when count(*) filter (score is null) > 0 or count(*) filter (event_type = 'error') > 0 then 'teacher-review-required' else 'ready-for-teacher-review' end as state from s group by document")
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("value") >= 1, F.col("value"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("document"), F.array(score).alias("scores"), F.lit(1.0).alias("total"), F.when(F.col("event_type") == "error", 2.0).otherwise(1.0).alias("calculated_total"), F.array().cast("array<string>").alias("findings"))
    return rules.quality(rows).drop("findings").withColumn("empty_cells", F.col("empty_cells").cast("long"))


@query("select l_orderkey, l_linenumber, count(*) - 1 as repeats from lineitem group by all having count(*) > 1")
def duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    found = rules.repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("repeats"))


@query("select l_orderkey, l_partkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size <= 40)")
def unknown_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return rules.unknown(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), known, ["l_partkey"])


@query("select o_orderpriority as exam, cast(c.q as integer) as question, count(*) as cells from orders, (values (0), (1)) c(q) where (c.q = 0 and o_custkey % 7 = 0) or (c.q = 1 and o_custkey % 5 = 0) group by all")
def corrections_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("exam"), F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("position"), F.col("o_custkey").cast("double").alias("k"))
    original = orders.select("exam", "row_id", "position", F.array(F.col("k"), F.col("k"), F.lit(None).cast("double")).alias("scores"))
    changed = F.array(F.when(F.col("k") % 7 == 0, F.col("k") + 1).otherwise(F.col("k")), F.when(F.col("k") % 5 != 0, F.col("k")), F.lit(3.0))
    return corrections.corrected_cells(original, orders.select("exam", "row_id", "position", changed.alias("scores")))


@query("select cast(l_linenumber as integer) as question, cast(sum(l_quantity) as bigint) as cells from lineitem group by 1")
def corrections_merge(spark: SparkSession, d: str) -> DataFrame:
    maps = table(spark, d, "lineitem").select(F.lit("all").alias("exam"), F.create_map(F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")).alias("cells"))
    return corrections.merged(maps).select("question", "cells")


@query("with k as (select l_orderkey as exam, l_linenumber as question, min(l_linestatus) as answer_key, max(l_quantity) as most from lineitem group by all) select exam, o_custkey as student, sum(case when most > 10 and lower(o_orderstatus) = lower(answer_key) then 10.0::double else 0.0::double end) as total from k join (select distinct o_orderkey, o_custkey, o_orderstatus from orders) on exam = o_orderkey group by exam, o_custkey")
def answer_key_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Each order is an exam of its customer; lines of up to ten pieces are not answered, answers are lower-case with spaces around."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("question")).agg(F.min("l_linestatus").alias("answer_key"), F.max("l_quantity").alias("most"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam"), F.col("o_custkey").alias("student"), F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")).alias("answer")).distinct()
    answers = lines.where("most > 10").join(orders, "exam").select("exam", "student", "question", "answer")
    scores = measure.answer_scores(answers, lines.select("exam", "question", "answer_key", F.lit(10.0).alias("max_score")), orders.select("exam", "student"))
    return measure.student_totals(scores)


@query("with q as (select l_orderkey as exam, l_linenumber as question, sum(l_quantity) / cast(50 * count(*) as double) as rate from lineitem group by all), f as (select exam, question, concat_ws(',', case when rate <= 0.05 then 'near_zero' end, case when rate >= 0.95 then 'near_full' end, case when count(*) over (partition by exam, rate) > 1 then 'equal_rate' end) as flags from q) select exam, question, flags from f where flags <> ''")
def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each order is an exam of its own."""
    rates = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("question")).agg(measure.rate(F.sum("l_quantity"), F.count("*") * 50.0).alias("rate"))
    return measure.anomalies(rates).select("exam", "question", "flags")


@query(f"with q as ({_QUESTIONS}), f as (select question, concat_ws(',', case when rate <= 0.05 then 'near_zero' end, case when rate >= 0.95 then 'near_full' end, case when exists (select 1 from q b where b.question <> q.question and b.rate = q.rate) then 'equal_rate' end) as flags from q) select question, flags from f where flags <> ''")
def anomaly_flags_all(spark: SparkSession, d: str) -> DataFrame:
    return measure.anomalies(_rates(spark, d)).select("question", "flags")


@query(f"with q as ({_QUESTIONS}), o as ({_OUTCOMES}) select 2 as section, '- Soru ' || question || ': %' || printf('%.2f', rate * 100) as line from q union all select 3, '- ' || outcome || ': %' || printf('%.2f', rate * 100) from o union all select 4, '- ' || outcome || ': %' || printf('%.2f', rate * 100) || ' | ' || case when rate >= 0.8 then 'Güçlü' when rate >= 0.5 then 'Geliştirilmeli' else 'Kritik' end from o")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.text_report(_rates(spark, d), _outcomes(spark, d).withColumn("exam", F.lit("all"))).select("section", "line")


@query("select c_nationkey, n_name, count(*) as customers, case n_nationkey % 4 when 0 then 'tde-70-15-15' when 3 then null else 'language-50-25-25' end as profile, case n_nationkey % 4 when 0 then 0.70::double when 3 then null else 0.50::double end as written from customer join nation on c_nationkey = n_nationkey group by all")
def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Courses by nation, written in other ways than the dimension has them; the last one has no profile."""
    courses = F.array(*[F.lit(c) for c in ("Türk Dili ve Edebiyatı", "  TÜRKÇE ", "mesleki   Arapça", "Matematik")])
    names = table(spark, d, "nation").withColumn("course", F.get(courses, (F.col("n_nationkey") % 4).cast("int")))
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return counts.join(programs.with_profile(names), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_name", "customers", "profile", F.col("weights")["written"].alias("written"))

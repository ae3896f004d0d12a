"""Queries of rosters, payloads, gates, programs, merges, prompts and folds over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import bands, text
from tallyloom.operators import documents, merge, programs, prompts, reports, rosters, rules, textguard
from tallyloom.plans.measures import _COMPONENTS, WEIGHTS, _components
from tallyloom.plans.registry import Registry, table

query = Registry()


def _cycle(at: Column, *values: str | None) -> Column:
    """The value whose place is the remainder of at."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


@query("with n as (select o_orderpriority as exam, o_orderstatus as grp, o_orderkey, row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderkey) as row_number, row_number() over (partition by o_orderpriority order by o_orderstatus, o_orderkey) as k from orders) select o_orderkey, cast(row_number as integer) as row_number, 'Ö-' || case when k < 1000 then lpad(cast(k as varchar), 3, '0') else cast(k as varchar) end as technical_id from n")
def roster_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("exam"), F.col("o_orderstatus").alias("group"), F.col("o_orderkey").alias("position"))
    return rosters.numbered(rows).select(F.col("position").alias("o_orderkey"), "row_number", "technical_id")


_PADDED = "with s as (select o_custkey as exam, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as row_number, cast(o_orderkey as varchar) as student_no from orders), n as (select c_custkey as exam, c_custkey % 12 as expected, (select count(*) from orders where o_custkey = c_custkey) as n from customer)"


@query(f"{_PADDED} select exam, row_number, student_no from s union all select exam, cast(i as integer), '' from (select exam, unnest(range(n + 1, expected + 1)) as i from n)")
def entry_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("exam"), F.lit("one").alias("group"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("string").alias("student_no"))
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("exam"), (F.col("c_custkey") % 12).alias("expected"))
    return rosters.padded(rosters.row_numbers(rows), expected)


@query("with r as (select o_orderpriority as exam, o_orderkey as position, o_orderstatus as st, case when o_custkey % 11 = 0 then null else cast(o_custkey as varchar) end as no from orders), c as (select * from r where st = 'O') select exam, position, 'NO_STUDENT_NUMBER' as code from c where no is null union all select exam, position, 'SAVED_BEFORE' from c where exists (select 1 from r s where s.st = 'F' and s.exam = c.exam and s.no = c.no) union all select exam, position, 'REPEATED' from (select *, row_number() over (partition by exam, no order by position) as k from c where no is not null) where k > 1")
def roster_issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one status are saved groups, those of another are being entered; some have no number."""
    number = F.when(F.col("o_custkey") % 11 == 0, F.lit(" - ")).otherwise(F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("exam"), F.col("o_orderkey").alias("position"), number.alias("student_no"), "o_orderstatus")
    return rosters.student_issues(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), rows.where("o_orderstatus = 'F'"))


@query("with n as (select o_custkey, count(*) as n, greatest(o_custkey % 20, 1) as expected from orders group by o_custkey) select o_custkey, case when n = expected then 'equal' when n > expected then 'over' else 'under' end as status, abs(n - expected) as difference from n")
def roster_counts(spark: SparkSession, d: str) -> DataFrame:
    saved = F.col("o_orderstatus") == "F"
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(saved).alias("saved"), F.count_if(~saved).alias("current"))
    status, difference = rosters.count_status(F.col("saved"), F.col("current"), F.col("o_custkey") % 20)
    return counts.select("o_custkey", status.alias("status"), difference.alias("difference"))


@query("with p as (select p_brand || '/' || p_size % 5 as folder, p_name as name, p_size, p_partkey % 3 as part from part), e as (select * from p where part = 0), i as (select * from p where part = 1), b as (select * from e union all select * from i where not exists (select 1 from e where e.folder = i.folder and e.name = i.name and e.p_size = i.p_size)) select folder, name, p_size, count(*) over (partition by folder) > 10 as too_many from b")
def file_selection(spark: SparkSession, d: str) -> DataFrame:
    """A third of the parts are files that are there, another third come anew."""
    folder = F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 5).cast("string"))
    rows = table(spark, d, "part").select(folder.alias("group"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(0).alias("modified"), (F.col("p_partkey") % 3).alias("part"))
    out = rosters.selected_files(rows.where("part = 0"), rows.where("part = 1"))
    return out.select(F.col("group").alias("folder"), "name", F.col("size").alias("p_size"), "too_many")


@query("with c as (select n_nationkey as choice, case when n_nationkey % 5 = 0 then null else 'Brand#' || (n_nationkey % 5) || '1' end as stage, 'S' || n_regionkey as school, case when n_nationkey % 2 = 0 then 'PROMO' else 'ECONOMY' end as kind from nation where n_nationkey % 5 > 0), o as (select distinct p_brand, split_part(p_type, ' ', 1) as kind, p_name from part) select choice, p_name as course from c join o on p_brand = stage and o.kind = c.kind union select choice, n2.n_name from c join nation n2 on 'S' || n2.n_regionkey = school union select choice, 'Diğer' from c")
def course_options(spark: SparkSession, d: str) -> DataFrame:
    nation, key = table(spark, d, "nation"), F.col("n_nationkey")
    school = F.concat(F.lit("S"), F.col("n_regionkey").cast("string"))
    stage = F.when(key % 5 > 0, F.concat(F.lit("Brand#"), (key % 5).cast("string"), F.lit("1")))
    choices = nation.select(key.alias("choice"), stage.alias("stage"), school.alias("school_type"), _cycle(key, "PROMO", "ECONOMY").alias("course_type"))
    courses = table(spark, d, "part").select(F.col("p_brand").alias("stage"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("course_type"), F.col("p_name").alias("course"))
    return rosters.course_options(choices, courses, nation.select(school.alias("school_type"), F.col("n_name").alias("course")), "Diğer")


@query("with w as (select distinct user_id + cast(floor(value) as bigint) % 2 * 1000000 as source from events where event_type = 'error'), r as (select user_id as source, bool_and(value >= 3) as full_rows from events group by user_id) select source, coalesce(full_rows, false) as resolved from w left join r using (source)")
def warnings_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Some warnings are of sources without rows; a value below 3 is an empty cell."""
    rows = table(spark, d, "events")
    source = F.col("user_id") + F.floor("value") % 2 * 1_000_000
    cell = F.when(F.col("value") >= 3, F.col("value").cast("string")).otherwise(F.lit(" "))
    return rosters.resolved(rows.where("event_type = 'error'").select(source.alias("source")).distinct(), rows.select(F.col("user_id").alias("source"), F.array(F.col("event_type"), cell).alias("cells")))


_LINES = "select l_orderkey as exam, l_linenumber as question, max(l_quantity) as max_score, min(l_linestatus) as answer_key, min(l_tax) as tax from lineitem group by all"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order's questions with their maximum and key, once each."""
    keys = [F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("question")]
    return table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("max_score"), F.min("l_linestatus").alias("answer_key"), F.min("l_tax").alias("tax"))


@query(f"with q as ({_LINES}) select exam, sum(max_score) as total, string_agg(question || '=' || cast(max_score as integer), ',' order by question) as weights, bool_and(tax > 0.01) as answer_key_present from q group by exam")
def scoring_models(spark: SparkSession, d: str) -> DataFrame:
    """Questions of little tax have no key."""
    key = F.when(F.col("tax") > 0.01, F.col("answer_key"))
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("int").cast("string"))
    return rosters.scoring_model(_lines(spark, d).withColumn("answer_key", key)).withColumn("weights", F.array_join(F.transform(F.map_entries("weights"), entry), ","))


@query("select l_partkey as outcome, coalesce(case when p_size <= 40 then p_name end, cast(l_partkey as varchar)) as title, count(*) as linked from lineitem left join part on l_partkey = p_partkey group by all")
def outcome_titles(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("outcome")).agg(F.count("*").alias("linked"))
    return rosters.titled(links, table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("outcome"), F.col("p_name").alias("title")))


@query("select o_orderkey, unnest(list_filter([case when o_orderkey % 3 = 0 then 'exam.course' end, case when o_orderkey % 5 = 0 then 'exam.context.school' end, case when o_orderstatus = 'F' then 'status' end], lambda x: x is not null)) as path from orders")
def missing_paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    course, school = F.when(key % 3 != 0, F.lit("c")), F.when(key % 5 != 0, F.lit("s")).otherwise(F.lit(""))
    exam = F.struct(course.alias("course"), F.struct(school.alias("school")).alias("context"))
    rows = table(spark, d, "orders").select(key, exam.alias("exam"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return rosters.missing_paths(rows, ["o_orderkey"], ["exam.course", "exam.context.school", "status"])


@query("select event_id, case event_id % 3 when 0 then 'object' when 1 then 'array' else 'value' end as kind, case event_id % 3 when 0 then array_to_string(json_keys(props), ',') when 1 then '2' else event_type end as content from events")
def payload_shapes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id") % 3
    json = F.when(key == 0, F.col("props")).when(key == 1, F.concat(F.lit("["), F.col("props"), F.lit(", 1]"))).otherwise(F.col("event_type"))
    kind, content = rosters.shape(json)
    return table(spark, d, "events").select("event_id", kind.alias("kind"), content.alias("content"))


@query("select doc_id from documents where lang is distinct from 'en'")
def index_without_program(spark: SparkSession, d: str) -> DataFrame:
    return rosters.without_program(table(spark, d, "documents").select("doc_id", F.col("lang").alias("program")), "en").select("doc_id")


@query("select lang, array_to_string(list_sort(list(distinct source)), ',') as grades from documents group by lang")
def found_grades(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("grade"))
    return rosters.found_grades(rows, ["lang"]).withColumn("grades", F.array_join("grades", ","))


@query(f"with q as (select *, row_number() over (partition by exam order by question) as k from ({_LINES})) select exam, cast(k - 1 as integer) as question, cast(case when question % 2 = 0 then question * 10 else k end as integer) as number, max_score + 0.5 as max_score, case when question % 3 = 0 then '' else 'T' || question || ' | ' end || 'C' || question as outcome, 1.0::double as weight from q")
def payload_questions(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of the orders, lines in the order of their numbers: some numbers are left blank and are then the place, maxima have a comma, some themes are blank."""
    n = F.col("question")
    fields = {"outcomeCode": F.concat(F.lit(" C"), n.cast("string")), "outcomeTheme": F.when(n % 3 != 0, F.concat(F.lit("T"), n.cast("string")))}
    outcome = [fields.get(f, F.lit(None).cast("string")).alias(f) for f in documents.OUTCOME_FIELDS]
    most = F.replace((F.col("max_score") + 0.5).cast("string"), F.lit("."), F.lit(","))
    number = F.when(n % 2 == 0, (n * 10).cast("string")).otherwise(F.lit(""))
    none = F.lit(None).cast("array<struct<" + ", ".join(f"{f}: string" for f in documents.OUTCOME_FIELDS) + ">>")
    q = F.struct(n.alias("place"), number.alias("number"), most.alias("maxScore"), *outcome, none.alias("outcomes"))
    payloads = _lines(spark, d).groupBy("exam").agg(F.array_sort(F.collect_list(q)).alias("questions"))
    asked = documents.questions(payloads)
    return documents.links(asked).join(asked.select("exam", "question", "number", "max_score"), ["exam", "question"]).select("exam", "question", "number", "max_score", "outcome", "weight")


@query("select o_orderkey as exam, 'student 1' as place, unnest(list_filter([case when o_orderkey % 3 = 0 then 'STUDENT_REF' end, case when o_orderkey % 11 = 0 then 'SCORE_COUNT' end, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then 'SCORE_RANGE' end, case when o_orderkey % 5 = 0 then 'TOTAL_MISMATCH' end], lambda x: x is not null)) as code from orders union all select o_orderkey, 'exam', 'COMPONENT' from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'question 2', 'MAX_SCORE' from orders where o_orderkey % 13 = 0")
def payload_checks(spark: SparkSession, d: str) -> DataFrame:
    """A payload of two questions and one student for each order, some with an unknown component, a bad reference, score, count, total or maximum."""
    k = F.col("o_orderkey")
    blank = [F.lit(None).cast("string").alias(f) for f in documents.OUTCOME_FIELDS]
    none = F.lit(None).cast("array<struct<" + ", ".join(f"{f}: string" for f in documents.OUTCOME_FIELDS) + ">>").alias("outcomes")
    question = lambda most: F.struct(F.lit(None).cast("string").alias("number"), most.alias("maxScore"), *blank, none)
    bad = k % 7 == 0
    first = F.when(bad, F.lit(-1.0)).otherwise(F.lit(3.0))
    scores = F.when(k % 11 == 0, F.array(first)).otherwise(F.array(first, F.when(k % 13 == 0, 0.0).otherwise(F.lit(4.0))))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) + F.when(k % 5 == 0, 1.0).otherwise(F.lit(0.0))
    student = F.struct(F.lit(1).alias("rowNumber"), F.when(k % 3 == 0, "ali").otherwise(F.lit("Ö-001")).alias("studentRef"), scores.alias("scores"), total.alias("totalScore"))
    asked = F.array(question(F.lit("10")), question(F.when(k % 13 == 0, "0").otherwise(F.lit("10"))))
    rows = table(spark, d, "orders").select(k.alias("exam"), _cycle(k, "oral", "written").alias("component"), asked.alias("questions"), F.array(student).alias("students"))
    return documents.payload_issues(rows).select("exam", "place", "code")


@query("with f as (select p_partkey, p_partkey || case p_partkey % 4 when 0 then '.PDF' when 1 then '.docx' when 2 then '.exe' else '' end as name, case when p_size = 1 then 0 else p_size * 500000 end as size from part) select name, unnest(list_filter([case when p_partkey % 4 >= 2 then 'EXTENSION' end, case when size > 20971520 then 'TOO_LARGE' end, case when size = 0 then 'EMPTY' end], lambda x: x is not null)) as code from f")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_partkey").cast("string"), _cycle(F.col("p_partkey"), ".PDF", ".docx", ".exe", ""))
    size = F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size") * 500_000)
    return rules.file_issues(table(spark, d, "part").select(name.alias("name"), size.alias("size"))).select("name", "code")


@query("select p_partkey as exam, case when p_partkey % 3 = 2 then 'tde-9-tymm' end as program, case p_partkey % 3 when 2 then p_partkey % 4 in (1, 2, 3) and p_partkey % 4 <> 1 else p_partkey % 4 = 1 end as foreign_code from part")
def program_codes(spark: SparkSession, d: str) -> DataFrame:
    """Exams of three courses with codes of a program, of another, and none."""
    k = F.col("p_partkey")
    exams = table(spark, d, "part").select(k.alias("exam"), _cycle(k, "Matematik", "Fizik", "  TüRK Dili  ve edebiyatı").alias("course"), F.lit("9. Sınıf").alias("grade"))
    links = table(spark, d, "part").select(k.alias("exam"), F.lit(0).alias("question"), F.lit("x").alias("outcome"), _cycle(k, "", "tde1.2", "MAT.1", "FIZ.2").alias("code"))
    wrong = programs.foreign_codes(links, exams).select("exam", F.lit(True).alias("foreign_code"))
    return programs.with_program(exams).join(wrong, "exam", "left").select("exam", "program", F.coalesce("foreign_code", F.lit(False)).alias("foreign_code"))


@query("select p_partkey, case p_partkey % 6 when 0 then 'listening' when 1 then 'speaking' when 2 then 'written' when 3 then 'written' end as component from part")
def skill_components(spark: SparkSession, d: str) -> DataFrame:
    listed = _cycle(F.col("p_partkey"), "Dinleme,İzleme", "KONUŞMA", "Okuma, Yazma", "yazma", "Okuma,Konuşma", "")
    return table(spark, d, "part").select("p_partkey", programs.component_of_skills(F.split(F.translate(listed, "İ", "i"), ",")).alias("component"))


@query("with r as (select c_custkey, unnest(['written', 'listening', 'speaking']) as component from customer), s as (select c_custkey as class, component, case when c_custkey % 5 = 0 and component = 'written' then 'other' when c_custkey % 7 = 0 and component = 'speaking' then '' else 'işık' end as school from r where not (c_custkey % 3 = 0 and component = 'listening')) select class, unnest(list_filter([case when count(distinct component) < 3 then 'MISSING_COMPONENT' end, case when bool_or(school = '') then 'NO_SCHOOL' end, case when count(distinct nullif(school, '')) > 1 then 'DIFFERENT_SCHOOL' end], lambda x: x is not null)) as code from s group by class")
def class_reports(spark: SparkSession, d: str) -> DataFrame:
    """Three reports of each customer; some are missing, of another school, or without one."""
    k, part = F.col("c_custkey"), F.col("component")
    every = table(spark, d, "customer").select(k, F.explode(F.array(*[F.lit(c) for c in merge.COMPONENTS])).alias("component")).where(~((k % 3 == 0) & (part == "listening")))
    school = F.when((k % 5 == 0) & (part == "written"), "other").when((k % 7 == 0) & (part == "speaking"), " ").when(part == "listening", "İŞIK").otherwise(F.lit(" işık "))
    return merge.report_issues(every.select(k.alias("class"), "component", school.alias("school"), *[F.lit("x").alias(c) for c in merge.CONTEXT[1:]]))


@query(f"with w as (select class, student, cast(sum(total) filter (component = 'written') as bigint) as a, cast(sum(total) filter (component = 'listening') as bigint) as b, cast(sum(total) filter (component = 'speaking') as bigint) as c from {_COMPONENTS} group by class, student) select class, count(*) filter (a is not null and b is not null and c is not null) as students, case when count(a) = 0 or count(b) = 0 or count(c) = 0 then 'missing' when count(a) < count(*) or count(b) < count(*) or count(c) < count(*) then 'mismatch' else 'complete' end as state, case when state = 'complete' then round(sum(70 * a + 15 * b + 15 * c) / 100.0::double / count(*), 2) end as average from w group by class")
def general_classes(spark: SparkSession, d: str) -> DataFrame:
    return merge.general(_components(spark, d), WEIGHTS)


@query("select p_partkey, concat_ws(' - ', nullif(case when p_partkey % 3 = 0 then '' else p_type end, ''), p_brand, p_name, case when p_partkey % 2 = 0 then null else p_type end) as identity from part")
def outcome_identity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    theme, skill = F.when(k % 3 == 0, "").otherwise(F.col("p_type")), F.when(k % 2 != 0, F.col("p_type"))
    return table(spark, d, "part").select(k, prompts.identity(theme, F.col("p_brand"), F.lit(None).cast("string"), F.col("p_name"), F.col("p_name"), skill).alias("identity"))


@query("select doc_id as name, case when trim(coalesce(text, '')) = '' then 'empty' else 'too long' end as reason from documents where trim(coalesce(text, '')) = '' or length(text) > 8000")
def prompt_limits(spark: SparkSession, d: str) -> DataFrame:
    return prompts.rejected(table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.lit("s").alias("system"), F.col("text").alias("user")))


@query("select p_partkey, p_partkey % 4 = 0 as grounded from part")
def grounded_terms(spark: SparkSession, d: str) -> DataFrame:
    """Two terms of a name that a line break cuts; the same term twice; an unknown one; one alone."""
    k, a, b = F.col("p_partkey"), F.concat(F.lit("alpha"), F.col("p_partkey").cast("string")), F.concat(F.lit("beta"), F.col("p_partkey").cast("string"))
    terms = F.when(k % 4 == 0, F.array(F.upper(a), b)).when(k % 4 == 1, F.array(a, F.upper(a))).when(k % 4 == 2, F.array(a, F.lit("gamma"))).otherwise(F.array(a))
    return table(spark, d, "part").select(k, textguard.grounded(terms, F.array(F.concat(F.lit("x al-\n"), F.substring(a, 3, 40)), F.concat(F.lit("  y\n"), b))).alias("grounded"))


@query("select o_orderkey as exam, '- Soru 1: a' || chr(10) || '- Soru 3: c' || case when o_orderkey % 2 = 0 then chr(10) || '- Soru 2: d' else '' end as findings from orders")
def anomaly_findings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an answer that name a known question, the first three of them."""
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("text\n-  soru 1:  a \n- Soru 9: b\n- Soru 3: c\r\n"), F.when(k % 2 == 0, "- Soru 2: d\n- Soru 2: e").otherwise(F.lit("Soru 2: d")))
    rows = table(spark, d, "orders")
    return textguard.findings(rows.select(k.alias("exam"), answer.alias("answer")), rows.select(k.alias("exam"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number")))


@query("with f as (select lang, source, cast(doc_id % 7 as varchar) as focus, min(doc_id) as place from documents group by all) select lang, source as document, string_agg(focus, ', ' order by place) as focuses from f group by all")
def source_focuses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("document"), (F.col("doc_id") % 7).cast("string").alias("focus"), F.col("doc_id").alias("place"))
    return reports.source_focuses(rows, ["lang"])


@query("select p_partkey, 'ışık ' || p_size || ' iz' as course, p_size || '' as theme_number, 'ŞİİR ' || p_size as theme, 'A' || p_size || 'B' as theme_key, case when p_partkey % 2 = 0 then cast(p_size as varchar) else 'hazırlık' end as grade, cast(p_size as varchar) as digits, 'sair ' || p_size || ' i' as compared from part")
def text_folds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    around = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    heading = F.when(F.col("p_partkey") % 2 == 0, around("", ". SINIF x")).otherwise(around("x ", ". SINIF"))
    return table(spark, d, "part").select(
        "p_partkey", text.course_fold(around("  IŞIK ", "\tİZ ")).alias("course"), text.grade_base(around("", ". Sınıf")).alias("theme_number"), text.theme_upper(around("3. Tema: şiir ")).alias("theme"),
        text.theme_key(around(" a ", " b\n")).alias("theme_key"), text.grade_label(heading).alias("grade"), text.digits(around("x-", "y")).alias("digits"), text.compare_fold(around("Şâir - ", " (I)")).alias("compared"),
    )


@query("select p_partkey, cast(p_size as integer) as question, p_size + 0.5::double as most, case when p_partkey % 2 = 0 then p_size + 0.25::double end as strict, case p_partkey % 3 when 0 then p_size + 0.5::double when 1 then 7.0::double else null end as given, least(p_size, 20) as clamped, case when p_partkey % 3 = 1 then '' when p_partkey % 3 = 2 then '' else 'Lise ' || p_size end as school from part")
def number_forms(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    around = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    given = F.when(k % 3 == 0, around("", ",5")).when(k % 3 == 1, "").otherwise(F.lit("x"))
    school = F.when(k % 3 == 0, around(" Lise ", " ")).when(k % 3 == 1, n).otherwise(F.lit("undefined"))
    return table(spark, d, "part").select(
        k, text.question_number(around("soru ", " x")).alias("question"), text.max_score(around("Soru 3 (", ",5 puan)")).alias("most"), text.strict_number(F.when(k % 2 == 0, around(" ", ",25 ")).otherwise(around("", "p"))).alias("strict"),
        text.given_number(given, F.lit(7.0)).alias("given"), text.clamp(F.col("p_size")).alias("clamped"), text.institution(school).alias("school"),
    )


@query("with r as (select p_partkey, p_size / 50.0::double as rate from part) select p_partkey, case when rate >= 0.85 then 'over' when rate >= 0.70 then 'at' when rate >= 0.50 then 'under' else 'far' end as decision, case when rate >= 0.80 then 'Güçlü' when rate >= 0.50 then 'Geliştirilmeli' else 'Kritik' end as early from r")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision texts by short names of their levels."""
    rate = F.col("p_size") / 50.0
    names = F.create_map(*[F.lit(x) for (_, _, said), short in zip(bands.ANALYSIS, ("over", "at", "under", "far"), strict=True) for x in (said, short)])
    return table(spark, d, "part").select("p_partkey", names[bands.decision(rate)].alias("decision"), bands.early_level(rate).alias("early"))

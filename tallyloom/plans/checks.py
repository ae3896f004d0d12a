"""Queries of contracts, gates, backup packages and what exams lack, over the order, line and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.functions import json_text
from tallyloom.operators import backups, documents, measure, programs, prompts, uploads
from tallyloom.plans.registry import Registry, table
from tallyloom.sources import providers
from tallyloom.sources.contracts import CONTRACTS

query = Registry()

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_tax", "l_returnflag"]


@query("with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_tax, l_returnflag) - 1 as i from lineitem), o as (select * from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)), w as (select l_orderkey, i, unnest(list_filter([case when l_returnflag = 'R' then ['number', 'KIND'] end, case when l_tax > 0.06 then ['tax', 'UNKNOWN'] end, case when l_quantity < 3 then ['id', 'MISSING'] end], lambda x: x is not null)) as w from n join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P') select o_orderkey, 'validation' as path, 'MISSING' as code from o where o_orderstatus = 'P' union all select l_orderkey, 'questions[' || i || '].' || w[1], w[2] from w union all select o_orderkey, 'assessment.grade', 'KIND' from o where o_orderstatus <> 'P' and o_custkey % 10 = 0")
def contract_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents of orders: returned lines give their number as a text, some lines have a tax or no id, orders in progress no validation."""
    returned, number = F.lit('"'), lambda x: x["l_linenumber"].cast("string")
    fields = lambda x: F.concat_ws(",", F.when(x["l_quantity"] >= 3, F.concat(F.lit('"id":"q'), x["l_partkey"].cast("string"), F.lit('"'))), F.concat(F.lit('"number":'), F.when(x["l_returnflag"] == "R", F.concat(returned, number(x), returned)).otherwise(number(x))), F.when(x["l_tax"] > 0.06, F.concat(F.lit('"tax":'), x["l_tax"].cast("string"))), F.concat(F.lit('"max_score":'), x["l_quantity"].cast("string")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_LINE))).alias("lines"))
    grade = F.when(F.col("o_custkey") % 10 == 0, "9").otherwise(F.lit("null"))
    text = F.concat(
        F.lit('{"metadata":{"ced_version":"1","created_at":"x","source":"s"},"assessment":{"id":"a","title":"t","course":"c","grade":'), grade, F.lit('},"student_results":[],"questions":['), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("{"), fields(x), F.lit("}"))), ","), F.lit("]"),
        F.when(F.col("o_orderstatus") == "P", "}").otherwise(F.lit(',"validation":{"valid":true}}')),
    )
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", text.alias("document"))
    return CONTRACTS.check(rows, ["o_orderkey"], "document", "exam")


@query("with r as (select o_orderkey as exam, case o_custkey % 4 when 0 then 'Fizik' when 1 then 'Türkçe' when 2 then 'türk dili  ve EDEBİYATI' end as course, case left(o_orderpriority, 1) when '1' then 'oral' when '2' then 'written' when '3' then 'speaking' when '4' then 'general' else '' end as component, case o_orderstatus when 'O' then '' when 'F' then 'language-50-25-25' else 'x' end as profile, o_custkey % 7 as questions, o_custkey % 5 as students from orders), p as (select *, case when course = 'Türkçe' then 'language-50-25-25' when course like 'türk dili%' then 'tde-70-15-15' end as own, case when component = '' then 'written' else component end as c from r), s as (select exam, case when c = 'oral' then 'COMPONENT' when profile = 'x' then 'UNKNOWN_PROFILE' when profile <> '' and profile is distinct from own then 'FOREIGN_PROFILE' when own is null and c <> 'written' then 'NEEDS_LANGUAGE_COURSE' when c = 'general' and students = 0 then 'NO_COMPONENT_ANALYSES' when c <> 'general' and questions = 0 then 'NO_QUESTIONS' when c <> 'general' and students = 0 then 'NO_STUDENTS' end as code from p) select * from s where code is not null")
def request_gates(spark: SparkSession, d: str) -> DataFrame:
    """Requests of orders: their priority is the component, their status the profile that is asked for."""
    k, first = F.col("o_custkey"), F.left("o_orderpriority", F.lit(1))
    course = F.when(k % 4 == 0, "Fizik").when(k % 4 == 1, "Türkçe").when(k % 4 == 2, "türk dili  ve EDEBİYATI")
    component = F.when(first == "1", "oral").when(first == "2", "written").when(first == "3", "speaking").when(first == "4", "general").otherwise(F.lit(" "))
    profile = F.when(F.col("o_orderstatus") == "O", "").when(F.col("o_orderstatus") == "F", "language-50-25-25").otherwise(F.lit("x"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam"), course.alias("course"), component.alias("component"), profile.alias("profile"), (k % 7).alias("questions"), (k % 5).alias("students"), (k % 5).alias("component_analyses"))
    return programs.request_issues(rows)


def _packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages of customers by segment: new ones, ones of version 1, with a name within, changed after they were sealed; those of little money are of a later version."""
    segment, note = F.col("c_mktsegment"), F.struct(F.col("c_name").alias("text"), F.when(F.col("c_nationkey") % 5 == 0, F.col("c_name")).alias("fullName"))
    space = F.to_json(F.struct(F.array(note).alias("decisions"), F.struct(F.col("c_nationkey").alias("nation")).alias("teacherContext")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), segment, "c_acctbal", space.alias("workspace"))
    of = lambda part, version: backups.packages(part, F.lit("2024-01-01"), version=version)
    low = F.col("c_acctbal") < 0
    rows = backups.dealt(rows)
    made = of(rows.where(~low & (segment != "BUILDING")), 2).unionByName(of(rows.where(~low & (segment == "BUILDING")), 1)).unionByName(of(rows.where(low), 3))
    return made.withColumn("package", F.when(F.col("record_id") % 7 == 0, F.replace("package", F.lit("2024-01-01"), F.lit("2024-01-02"))).otherwise(F.col("package")))


_STATUS = "case when c_acctbal < 0 then 'newer' when c_custkey % 7 = 0 then 'broken' when c_nationkey % 5 = 0 then 'private' when c_mktsegment = 'BUILDING' then 'old' else 'ok' end"


@query(f"select c_custkey as record_id, {_STATUS} as status, case when {_STATUS} = 'private' then 'workspace.decisions.0.fullName' end as detail from customer")
def saved_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages that are written and read back."""
    return backups.saved(_packages(spark, d), staging.scratch(spark, "packages")).select("record_id", "status", "detail")


@query(f"select c_custkey as record_id, {_STATUS} = 'old' as converted, 'ok' as status, c_nationkey as nation from customer where {_STATUS} in ('ok', 'old')")
def migrated_packages(spark: SparkSession, d: str) -> DataFrame:
    """Good packages at the current version, opened again."""
    up = backups.brought_up(_packages(spark, d), F.lit("2025-01-01")).where(F.col("status").isin("ok", "old")).select("record_id", "package", (F.col("status") == "old").alias("converted"))
    nation = F.variant_get(F.parse_json("package"), "$.workspace.teacherContext.nation", "int")
    return backups.opened(up).select("record_id", "converted", "status", nation.alias("nation"))


@query("select event_id, case when value < 5 then '{\"k\":null,\"v\":[null,{\"t\":\"' || event_type || '\"}]}' else '{\"k\":' || json_extract_string(props, '$.k') || ',\"v\":[\" \",{\"t\":\"' || event_type || '\"}]}' end as cleaned from events")
def emptied_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events with empty texts at several depths, where the value is small."""
    low = F.col("value") < 5
    k = F.when(low, '""').otherwise(F.get_json_object("props", "$.k"))
    said = F.concat(F.lit('{"k": '), k, F.lit(', "v": ["'), F.when(low, "").otherwise(F.lit(" ")), F.lit('", {"t": "'), F.col("event_type"), F.lit('"}]}'))
    return table(spark, d, "events").select("event_id", json_text.without_empty(said).alias("cleaned"))


@query("with q as (select l_orderkey as exam, count(*) as questions, sum(case when l_tax > 0.01 then l_quantity else 0 end) as total, count(*) filter (l_returnflag = 'A') as blank_texts, count(*) filter (l_tax <= 0.01) as without_score, bool_and(l_linestatus <> 'F') as has_answer_key from lineitem group by 1), s as (select o_custkey as exam, count(*) as students, list_sort(list(distinct no) filter (n > 1)) as repeated from (select o_custkey, o_orderstatus as no, count(*) over (partition by o_custkey, o_orderstatus) as n from orders) group by 1), d as (select o_orderkey as exam, o_totalprice / 500000 as confidence, o_custkey % 3 as broken from orders) select exam, coalesce(questions, 0) as questions, coalesce(total, 0) as total, coalesce(blank_texts, 0) as blank_texts, coalesce(students, 0) as students, coalesce(array_to_string(repeated, ','), '') as repeated, array_to_string(list_filter([case when questions is null then 'MISSING_QUESTION' end, case when without_score > 0 then 'MISSING_SCORE' end, case when not has_answer_key then 'MISSING_ANSWER_KEY' end, case when students is null then 'MISSING_STUDENT' end, case when broken > 0 then 'BROKEN_TABLE' end, case when confidence < 0.6 then 'LOW_CONFIDENCE' end], lambda x: x is not null), ',') as codes from d left join q using (exam) left join s using (exam)")
def structured_exams(spark: SparkSession, d: str) -> DataFrame:
    """Orders are exams and their lines questions; the orders of the customer with an exam's number are its students, whose status is their number."""
    line = table(spark, d, "lineitem")
    asked = line.select(F.col("l_orderkey").alias("exam"), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.lit("t")).alias("text"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("max_score"), F.when(F.col("l_linestatus") != "F", "x").alias("answer_key"))
    orders = table(spark, d, "orders")
    docs = orders.select(F.col("o_orderkey").alias("exam"), (F.col("o_totalprice") / 500000).alias("confidence"), (F.col("o_custkey") % 3).alias("broken_tables"), F.lit(None).cast("array<string>").alias("warnings"))
    there = orders.select(F.col("o_custkey").alias("exam"), F.col("o_orderstatus").alias("student_no"))
    out = documents.structured(docs, asked, there)
    return out.select("exam", "questions", "total", "blank_texts", "students", F.array_join("repeated", ",").alias("repeated"), F.array_join("codes", ",").alias("codes"))


@query("with l as (select l_orderkey as exam, l_linenumber as question, l_partkey % 5 as outcome, l_returnflag <> 'N' as coded from lineitem), q as (select exam, question, bool_or(coded) as coded from l group by all) select exam, (select count(distinct outcome) from l x where x.exam = q.exam) as outcomes, count(*) as questions, count(*) filter (not coded) as unmapped from q group by exam")
def mapping_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines link a question of their number to an outcome; those of one flag have no code."""
    code = F.when(F.col("l_returnflag") == "N", "").otherwise(F.lit("C"))
    return documents.mapping(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("question"), (F.col("l_partkey") % 5).alias("outcome"), code.alias("code"))).select("exam", "outcomes", "questions", "unmapped")


@query("with e as (select o_orderkey as exam, case left(o_orderpriority, 1) when '1' then 'listening' when '2' then 'speaking' when '3' then 'general' else 'written' end as component, case o_orderstatus when 'F' then 'language-50-25-25' when 'O' then 'tde-70-15-15' end as profile from orders), q as (select l_orderkey as exam, count(*) as n, sum(l_quantity) as most, sum(floor(l_quantity * (1 - l_tax))) as got, count(*) filter (l_tax > 0.02) as students, sum(floor(l_quantity * (1 - l_tax))) filter (l_tax > 0.02) as earned from lineitem group by 1) select exam, component, profile, case profile || component when 'language-50-25-25written' then 0.5 when 'language-50-25-25listening' then 0.25 when 'language-50-25-25speaking' then 0.25 when 'tde-70-15-15written' then 0.7 when 'tde-70-15-15listening' then 0.15 when 'tde-70-15-15speaking' then 0.15 end::double as component_weight, coalesce(n, 0) as question_count, coalesce(students, 0) as student_count, coalesce(most, 0) as exam_max, round(earned / students, 2) as class_average, case when students > 0 then round(earned / students / most, 9) end as rate from e left join q using (exam)")
def report_heads(spark: SparkSession, d: str) -> DataFrame:
    """Lines are questions worth their quantity; those with some tax are students, too, who have what is left of it."""
    first, status, line = F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus"), table(spark, d, "lineitem")
    exams = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam"), F.when(first == "1", "listening").when(first == "2", "speaking").when(first == "3", "general").otherwise(F.lit("written")).alias("component"), F.when(status == "F", "language-50-25-25").when(status == "O", "tde-70-15-15").alias("profile"))
    asked = line.select(F.col("l_orderkey").alias("exam"), F.col("l_quantity").alias("max_score"))
    there = line.where("l_tax > 0.02").select(F.col("l_orderkey").alias("exam"), F.floor(F.col("l_quantity") * (1 - F.col("l_tax"))).alias("total"))
    return measure.reports(exams, asked, there, programs.profiles(spark)).withColumn("rate", F.round("rate", 9))


@query("with n as (select *, row_number() over (order by name) - 1 as n from (select cast(p_partkey as varchar) as name, p_name, p_size from part where p_brand <> 'Brand#1')), b as (select *, n // 16 as batch, least(30, max(p_size) over (partition by n // 16)) as most from n), a as (select name, batch, cast(n % 16 as integer) as place, case when most = 29 then null else p_name || '/' || most end as answer from b) select p_brand as owner, cast(p_partkey as varchar) as name, batch, place, answer from part left join a on a.name = cast(p_partkey as varchar)")
def prompt_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Parts are prompts of their brands, in batches of 16; those of one brand are blank, and the model fails batches that may answer with 29 tokens."""

    def model(pairs: list[tuple[str, str]], tokens: int) -> list[str]:
        return [] if tokens == 29 else [f"{user}/{tokens}" for _, user in pairs]

    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("owner"), F.lit("s").alias("system"), F.when(F.col("p_brand") == "Brand#1", " ").otherwise(F.col("p_name")).alias("user"), F.col("p_size").alias("tokens"))
    answers = prompts.flushed(prompts.queued(parts.drop("owner"), cap=30), model)
    return prompts.returned(parts.select("owner", "name"), answers).join(answers.select("name", "batch", "place"), "name", "left").select("owner", "name", "batch", "place", "answer")


@query("with n as (select l_orderkey, count(*) as lines from lineitem group by 1) select o_orderkey || suffix as path, provider, case when suffix = '.html' then 1 else 0 end as tables, case when suffix = '.html' then 3 + 3 * lines else 0 end as cells, warning from (select o_orderkey, lines, case o_orderstatus when 'F' then ['.html', 'page', null] when 'O' then ['.xls', 'old-sheet', 'SAVE_AS_XLSX'] else case when o_custkey % 2 = 0 then ['.PNG', 'image', 'NEEDS_OCR'] else ['.csv', null, 'NO_PROVIDER'] end end as x, x[1] as suffix, x[2] as provider, x[3] as warning from orders join n on l_orderkey = o_orderkey)")
def provided_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files of orders: pages with a table of their lines, and files that no provider can read."""
    cell = lambda x: F.concat(F.lit("<td> "), x.cast("string"), F.lit("</td>"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("<tr>"), cell(F.col("l_linenumber")), cell(F.col("l_partkey")), F.lit("<td></td>"), cell(F.col("l_quantity")), F.lit("</tr>"))).alias("rows"))
    page = F.concat(F.lit("<p>x</p><table><tr><th>No</th><th>Kod</th><th></th><th>Puan</th></tr>"), F.array_join("rows", ""), F.lit("</table>"))
    suffix = F.when(F.col("o_orderstatus") == "F", ".html").when(F.col("o_orderstatus") == "O", ".xls").when(F.col("o_custkey") % 2 == 0, ".PNG").otherwise(F.lit(".csv"))
    files = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.col("o_orderkey").cast("string"), suffix).alias("path"), page.cast("binary").alias("content"))
    return providers.documents(providers.PROVIDERS.cells(files))


@query("with s as (select user_id || '/' || event_type as upload, event_id, case when value < 4 then '.png' when value < 8 then '.PDF' else '.docx' end as suffix, value from events where event_id % 7 = 0 or user_id % 50 = 0), u as (select upload, count(*) as n, bool_and(suffix = '.png') as images, max(suffix) as suffix, bool_or(suffix = '.PDF' and value >= 5) as layer from s group by upload), k as (select upload, case when images then 'image-group' when n = 1 and suffix = '.docx' then 'native-table-document' when n = 1 and suffix = '.PDF' then case when layer then 'text-pdf' else 'scanned-pdf' end else 'other-document' end as kind from u) select upload, kind, kind in ('image-group', 'scanned-pdf') as needs_ocr, kind <> 'scanned-pdf' as can_read from k")
def routed_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and type are files of an upload, of a kind by their value; of pages of PDF files only the second has a text, which is short where the value is small."""
    few = (F.col("event_id") % 7 == 0) | (F.col("user_id") % 50 == 0)
    suffix = F.when(F.col("value") < 4, ".png").when(F.col("value") < 8, ".PDF").otherwise(F.lit(".docx"))
    files = table(spark, d, "events").where(few).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("upload"), F.concat(F.col("event_id").cast("string"), suffix).alias("path"), "value")
    pages = files.where(F.col("path").endswith(".PDF")).select("path", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"), "value")
    said = F.when(F.col("page") == 2, F.repeat(F.lit("ab \n"), F.floor(F.col("value") * 4).cast("int"))).when(F.col("page") == 5, F.repeat(F.lit("x"), F.lit(99)))
    return uploads.routed(files.drop("value"), uploads.text_layers(pages.select("path", "page", said.alias("text"))))


@query("with u as (select l_orderkey as exam, l_linenumber as place, max(l_shipmode) as mode, count(*) as n from (select l_orderkey, l_linenumber, l_returnflag || l_linestatus as l_shipmode from lineitem) group by all) select exam, 'mode' as field, mode as value from u qualify row_number() over (partition by exam order by place desc) = 1 union all select exam, 'odd', cast(place as varchar) from u where place % 2 = 1 qualify row_number() over (partition by exam order by place desc) = 1")
def merged_uploads(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of an order's lines are uploads; all have a field, those of odd numbers another."""
    place, mode = F.col("l_linenumber"), F.max(F.concat("l_returnflag", "l_linestatus"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("exam"), place.alias("place")).agg(mode.alias("mode"))
    fields = F.map_concat(F.create_map(F.lit("mode"), F.col("mode")), F.when(F.col("place") % 2 == 1, F.create_map(F.lit("odd"), F.col("place").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return uploads.merged_fields(rows.select("exam", "place", fields.alias("fields")))


@query("select o_custkey as exam, count(*) as number, count(distinct o_orderkey) as students, count(*) filter (o_orderstatus = 'F') as own_source from orders group by 1")
def merged_rosters(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer are uploads of one student; those of one status name its source."""
    student = F.struct(F.col("o_orderkey").cast("string").alias("student"), F.when(F.col("o_orderstatus") == "F", "own").otherwise(F.lit(" ")).alias("source"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("exam"), F.col("o_orderdate").alias("place"), F.col("o_orderkey").cast("string").alias("file"), F.array(student).alias("students"))
    merged = uploads.merged_students(rows)
    return merged.groupBy("exam").agg(F.max("number").alias("number"), F.countDistinct("student").alias("students"), F.count_if(F.col("source") == "own").alias("own_source"))


@query("select o_orderkey, case when (o_totalprice > 100000)::int + (o_custkey % 2)::int + (o_custkey % 3 > 0)::int + 3 >= 5 then 'template' when o_orderstatus = 'F' then 'unrecognized-template' when o_orderstatus = 'O' then 'handwritten-table' else 'score-table' end as kind from orders where left(o_orderpriority, 1) not in ('1', '2')")
def upload_types(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose priority, as attendance, means present, with six fields of which three may say nothing."""
    absent = F.when(F.left("o_orderpriority", F.lit(1)) == "1", " GİRMEDİ ").when(F.left("o_orderpriority", F.lit(1)) == "2", "Katılmadı")
    rows = uploads.participating(table(spark, d, "orders").withColumn("attendance", absent))
    some = [F.when(F.col("o_totalprice") > 100000, "x").otherwise(F.lit("null")), F.when(F.col("o_custkey") % 2 == 1, "y"), F.when(F.col("o_custkey") % 3 > 0, "z").otherwise(F.lit(" - "))]
    mode = F.when(F.col("o_orderstatus") == "F", "template").when(F.col("o_orderstatus") == "O", "manual")
    return rows.select("o_orderkey", uploads.document_type([*some, *[F.lit(x) for x in "abc"]], mode).alias("kind"))


@query("with s as (select l_orderkey as exam, 'Ö-' || lpad(cast(l_suppkey as varchar), 3, '0') as ref, l_quantity as total from lineitem where l_suppkey % 3 > 0 and l_returnflag <> 'R'), e as (select exam, string_agg(ref || '=' || total, ';' order by ref, total) as cohort from s group by exam) select o_orderkey as exam, case when o_custkey % 2 = 0 then o_orderpriority else o_orderstatus end as course, '' as term, coalesce(cohort, '') as cohort from orders left join e on exam = o_orderkey")
def portable_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of orders with the students that have a pseudonym and a total, read back from their JSON; the customer stays behind."""
    line = table(spark, d, "lineitem")
    ref = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit(" Ö-"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"))).otherwise(F.lit("Ali Veli"))
    students = line.select(F.col("l_orderkey").alias("exam"), ref.alias("student_ref"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(F.lit(float("nan"))).alias("total"))
    exams = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("null")).alias("courseName"), F.col("o_orderstatus").alias("course"), "o_custkey")
    reports = uploads.portable(exams, students, {"courseName": ["courseName", "course"], "term": ["term"]}, "analysis-report")
    parsed = F.from_json("report", "exam struct<courseName: string, term: string>, analysis struct<cohortEvidence: array<struct<student_ref: string, total: double>>>")
    cohort = F.array_join(F.transform("r.analysis.cohortEvidence", lambda s: F.concat(s["student_ref"], F.lit("="), s["total"].cast("string"))), ";")
    return reports.select("exam", parsed.alias("r")).select("exam", F.col("r.exam.courseName").alias("course"), F.col("r.exam.term").alias("term"), cohort.alias("cohort"))

"""Queries of documents: exam papers made of orders and their lines, sections and chunks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import chunking
from tallyloom.plans.registry import Registry, table
from tallyloom.sources import semantic

query = Registry()

_NUMBERED = "n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) as k, count(*) over (partition by l_orderkey) as lines from lineitem)"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the orders, by the remainder of the key by 4: a class's table with one of questions, one without, a sheet of one student, a table of other things.

    Lines are questions worth their quantity; where an order has a class its first two lines are students, too, who get the line's number for each question.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind, text_of = F.col("o_orderkey") % 4, lambda c: F.col(c).cast("string")
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    lined = lambda f: F.transform("lines", f)
    exam = F.array(row("İl", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), "DERS", F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).otherwise(F.lit(" "))), row("Toplam Puan:", comma(F.col("o_totalprice")), "Öğrenci Okul No", text_of("o_custkey")), row("Sınav Türü", "☐ Yazılı ☒ Sözlü"))
    asked = F.concat(F.array(row("Soru No", "Kod", "Çıktı", "Azami Puan")), lined(lambda x, i: row(F.when(x["l_linenumber"] % 2 == 0, (i + 11).cast("string")).otherwise(F.lit("")), F.when(x["l_partkey"] % 3 > 0, F.concat(F.lit("P"), x["l_partkey"].cast("string"))).otherwise(F.lit("")), "", comma(x["l_quantity"]))))
    heads = F.concat(row("Okul No", "Adı Soyadı"), lined(lambda x, i: F.concat(F.lit("Soru "), (i + 1).cast("string"))), row("Toplam"))
    student = lambda x: F.concat(row(x["l_suppkey"].cast("string"), "Ali Veli"), lined(lambda y: x["l_linenumber"].cast("string")), F.array((x["l_linenumber"] * F.size("lines") + F.when(x["l_tax"] > 0.05, 1).otherwise(0)).cast("string")))
    group = F.concat(F.array(heads), F.transform(F.slice("lines", 1, 2), student))
    sheet = F.array(F.concat(row("Sorular"), lined(lambda x, i: F.concat(F.lit("S"), (i + 1).cast("string")))), F.concat(row("Azami Puan"), lined(lambda x: comma(x["l_quantity"]))), F.concat(row("Öğrencinin Aldığı Puan"), lined(lambda x: F.when(x["l_discount"] > 0.01, comma(x["l_quantity"] / 2)).otherwise(F.lit("")))))
    tables = F.when(kind == 0, F.array(exam, asked, group)).when(kind == 1, F.array(exam, group)).when(kind == 2, F.array(exam, sheet)).otherwise(F.array(F.array(row("x", "y"))))
    cells = orders.select(text_of("o_orderkey").alias("path"), F.posexplode(tables).alias("table_ix", "t")).select("path", "table_ix", F.posexplode("t").alias("row_ix", "r")).select("path", "table_ix", "row_ix", F.posexplode("r").alias("cell_ix", "text"))
    return semantic.read(semantic.documents(cells))



@query(f"with {_NUMBERED} select cast(l_orderkey as varchar) as path, cast(case when l_orderkey % 4 = 0 and l_linenumber % 2 = 0 then k + 10 else k end as integer) as number, case when l_orderkey % 4 = 0 and l_partkey % 3 > 0 then 'P' || l_partkey else '' end as outcome_code, case when l_orderkey % 4 <> 1 then l_quantity end as max_score, case l_orderkey % 4 when 1 then 'score-column-heading' when 2 then 'single-student-score-sheet' end as source from n where l_orderkey % 4 < 3")
def paper_questions(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("path", F.inline("questions")).drop("outcome_description")


@query(f"with {_NUMBERED} select cast(l_orderkey as varchar) as path, cast(k as integer) as row_number, cast(l_suppkey as varchar) as student_no, cast(l_linenumber * lines as double) as calculated_total, cast(l_linenumber * lines + case when l_tax > 0.05 then 1 else 0 end as double) as total, cast(lines as integer) as scores from n where l_orderkey % 4 < 2 and k <= 2 union all select cast(l_orderkey as varchar), 1, cast(max(o_custkey) as varchar), sum(case when l_discount > 0.01 then l_quantity / 2 else 0 end), null, cast(count(*) as integer) from n join orders on l_orderkey = o_orderkey where l_orderkey % 4 = 2 group by l_orderkey")
def paper_students(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("path", F.inline("students")).withColumn("scores", F.size("scores"))


@query("with o as (select * from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)) select cast(o_orderkey as varchar) as path, case o_orderkey % 4 when 2 then 'single-student-score-sheet' when 3 then 'unclassified' else 'class-score-template' end as document_type, case when o_orderkey % 4 < 3 and o_orderstatus <> 'F' then o_orderstatus else '' end as province, case when o_orderkey % 4 < 3 and o_custkey % 5 > 0 then o_orderpriority else '' end as course, case when o_orderkey % 4 < 3 then 'Sözlü' else '' end as exam_type, case when o_orderkey % 4 < 3 then o_totalprice end as total_max_score, case when o_orderkey % 4 < 3 and o_orderstatus <> 'F' then 'province' else '' end as verified from o")
def paper_exams(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("path", "document_type", "exam.province", "exam.course", F.col("exam.examType").alias("exam_type"), F.col("exam.totalMaxScore").alias("total_max_score"), F.array_join("exam.verified", ",").alias("verified"))


@query(f"with {_NUMBERED}, o as (select * from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)), w as (select l_orderkey as p, 'TOTAL_MISMATCH' as code, k as place from n where l_orderkey % 4 < 2 and l_tax > 0.05 and k <= 2 union all select l_orderkey, 'NO_OUTCOME', case when l_linenumber % 2 = 0 then k + 10 else k end from n where l_orderkey % 4 = 0 and l_partkey % 3 = 0 union all select o_orderkey, unnest(list_filter([case when o_orderkey % 4 = 3 or o_custkey % 5 = 0 then 'NO_COURSE' end, case when o_orderkey % 4 = 3 then 'NO_QUESTIONS' end, case when o_orderkey % 4 = 3 then 'NO_STUDENTS' end, case when o_orderkey % 4 = 3 then 'NOT_TOLD_APART' end, case when o_orderkey % 4 in (1, 2) then 'OUTCOMES_NOT_IN_SHEET' end, case when o_orderkey % 4 = 1 then 'MAXIMA_NOT_IN_SHEET' end, case when o_orderkey % 4 < 2 then 'NAME_LEFT_OUT' end], lambda x: x is not null)), null from o) select cast(p as varchar) as path, code, cast(place as integer) as place from w")
def paper_warnings(spark: SparkSession, d: str) -> DataFrame:
    return semantic.warnings(_papers(spark, d))


@query("with p as (select conv_id // 10 as document, cast(conv_id % 10 * 8 + turn + 1 as integer) as page, max(case when role = 'system' then 'G' || conv_id % 3 end) as g, max(case when role = 'assistant' and length(text) % 2 = 0 then 'T ' || length(text) % 7 end) as t from conversations where text is not null group by all), d as (select document, min(page) as first, max(page) as last from (select conv_id // 10 as document, conv_id % 10 * 8 + turn + 1 as page from conversations) group by document), g as (select document, g as grade, max(page) as a from p where g is not null group by all), o as (select d.document, grade, coalesce(a, first) as a, coalesce((select min(n.a) - 1 from g n where n.document = d.document and n.a > g.a), last) as e from d left join g on g.document = d.document), i as (select o.document, o.a, p.t as theme, max(p.page) as s from o join p on p.document = o.document and p.page between o.a and o.e where p.t is not null group by all) select o.document, grade, theme, cast(coalesce(s, o.a) as integer) as first_page, cast(coalesce((select min(n.s) - 1 from i n where n.document = o.document and n.a = o.a and n.s > i.s), o.e) as integer) as last_page from o left join i on i.document = o.document and i.a = o.a")
def nested_sections(spark: SparkSession, d: str) -> DataFrame:
    """Ten conversations are a document, a turn is a page: a system's turn has the heading of a grade, answers of even length those of themes."""
    said, even = F.col("text").isNotNull(), F.length("text") % 2 == 0
    grade = F.when((F.col("role") == "system") & said, F.concat(F.lit(" G"), (F.col("conv_id") % 3).cast("string"), F.lit(" \n")))
    theme = F.when((F.col("role") == "assistant") & even, F.concat(F.lit("THEME: T "), (F.length("text") % 7).cast("string"), F.lit("\n")))
    page = F.concat(F.lit("x\n"), F.coalesce(grade, F.lit("")), F.coalesce(theme, F.lit("")), F.lit("y"))
    pages = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).alias("document"), (F.col("conv_id") % 10 * 8 + F.col("turn") + 1).cast("int").alias("page"), page.alias("text"))
    return chunking.nested_sections(pages, r"^\s*(G\d+)\s*$", r"^\s*THEME: (.+?)\s*$")


@query("select doc_id, md5(text) as text_md5, length(text) as chars, true as all_fit, true as numbered from documents where text <> ''")
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents put together again; whether each fits 512 tokens with its headings, which are lines that begin with few words and a colon."""
    import public_tokenizers

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document"), "text")
    chunks = chunking.token_chunks(docs, public_tokenizers.path("word_bpe_49k.json"), heading=r"(\w{1,3})\s+(\S+(?: \S+)?)")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    out = chunks.groupBy("document").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.max("tokens").alias("most"), F.max("chunk_index").alias("last"), F.count("*").alias("many"))
    return out.select(F.col("document").alias("doc_id"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"), (F.col("most") <= chunking.TOKENS).alias("all_fit"), (F.col("last") + 1 == F.col("many")).alias("numbered"))

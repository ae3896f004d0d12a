"""Queries of sheets, report fields, headings, contexts, answers and shown numbers over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import json_text, text
from tallyloom.operators import documents, programs, prompts, retrieval, rules
from tallyloom.plans.registry import Registry, table
from tallyloom.sources import tables

query = Registry()


def _cells(rows: DataFrame, key: str, *lines: list[Column | str]) -> DataFrame:
    """key, row_ix, cell_ix, text of a sheet with these lines for each row."""
    sheet = F.array(*[F.array(*[F.lit(c) if isinstance(c, str) else c for c in line]) for line in lines])
    return rows.select(key, F.posexplode(sheet).alias("row_ix", "line")).select(key, "row_ix", F.posexplode("line").alias("cell_ix", "text"))


@query("select o_orderkey, cast(q as integer) as question, case q when 1 then 10.0::double else 12.5::double end as max_score, case when q = 1 then cast(o_orderkey % 10 as double) when o_orderkey % 3 > 0 then 8.5::double end as score from orders, (values (1), (2)) t(q)")
def sheet_scores(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each order, with an empty row, an empty column and a name; some have no second score."""
    k = F.col("o_orderkey")
    head = [" Okul No ", "", "Ad Soyad", "Soru 1 (10p)", "S2 (12,5 puan)", "Toplam"]
    second = F.when(k % 3 > 0, "8,5").otherwise(F.lit(""))
    cells = _cells(table(spark, d, "orders"), "o_orderkey", head, [""] * 6, [k.cast("string"), "", "Ali Veli", (k % 10).cast("string"), second, "9"])
    return tables.scores(tables.clean(cells, ["o_orderkey"]), ["o_orderkey"]).drop("row_ix")


@query("select o_orderkey, unnest(['ders adi', 'sinif']) as label, unnest(['Fizik', cast(o_orderkey % 4 + 9 as varchar)]) as value from orders")
def sheet_pairs(spark: SparkSession, d: str) -> DataFrame:
    line = ["Ders Adı", "Kimya", "Sınıf:", (F.col("o_orderkey") % 4 + 9).cast("string"), "DERS ADI", "Fizik", "alone"]
    return tables.pairs(_cells(table(spark, d, "orders"), "o_orderkey", line), ["o_orderkey"])


@query("select o_orderkey, cast(case when o_orderkey % 3 = 0 then 1 else 0 end as integer) as table_ix from orders")
def best_tables(spark: SparkSession, d: str) -> DataFrame:
    """Of two tables the one with more rows, of equal ones the first."""
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("table_ix"))
    many = F.when((F.col("o_orderkey") % 3 == 0) & (F.col("table_ix") == 1), 2).when((F.col("o_orderkey") % 3 == 1) & (F.col("table_ix") == 0), 2).otherwise(F.lit(1))
    cells = rows.select("o_orderkey", "table_ix", F.explode(F.sequence(F.lit(1), many)).alias("row_ix"))
    return tables.best_table(cells, "o_orderkey").select("o_orderkey", "table_ix").distinct()


@query("select c_custkey as row_id, cast(c_custkey as varchar) as student_no, '7.0,8.5' as scores, case when c_custkey % 3 = 0 then 20.0::double else 15.5::double end as total, 15.5::double as calculated_total, case when c_custkey % 2 = 0 then 'AD_SOYAD' else '' end as findings from customer")
def positional_rows(spark: SparkSession, d: str) -> DataFrame:
    """Read rows, some with a name between the number and the scores."""
    k = F.col("c_custkey")
    rest = [F.lit("7"), F.lit("8,5"), F.when(k % 3 == 0, "20").otherwise(F.lit("15,5"))]
    cells = F.when(k % 2 == 0, F.array(k.cast("string"), F.lit("Ayşe Yılmaz"), *rest)).otherwise(F.array(k.cast("string"), *rest))
    out = rules.positional_rows(table(spark, d, "customer").select(k.alias("row_id"), cells.alias("cells")))
    return out.withColumns({"scores": F.array_join(F.transform("scores", lambda s: s.cast("string")), ","), "findings": F.array_join("findings", ",")})


@query("select c_custkey, concat_ws(',', case when c_custkey % 6 = 0 then 'school' end, case when c_custkey % 5 = 0 then 'teacher' end) as missing from customer")
def report_fields(spark: SparkSession, d: str) -> DataFrame:
    """Reports with a field under one of two names, under none, or with a placeholder."""
    k = F.col("c_custkey")
    whole = ["course", "className", "province", "district", "academicYear", "term", "examSequence", "examDate", "teachingProgram"]
    rows = table(spark, d, "customer").select(
        k, F.when(k % 3 > 0, "A").alias("schoolName"), F.when(k % 2 > 0, "B").alias("institutionName"), F.when(k % 5 == 0, "undefined").otherwise(F.lit("T")).alias("teacher"), *[F.lit("x").alias(c) for c in whole]
    )
    return documents.missing_fields(rows).select("c_custkey", F.array_join("missing", ",").alias("missing"))


@query("select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 3 > 0 then 'found' when c_custkey % 2 > 0 and c_custkey % 5 = 0 then 'usual' when c_custkey % 5 = 0 then ' ' else 'old' end as value, case when c_custkey % 2 = 0 and c_custkey % 3 > 0 then 'document' when c_custkey % 2 > 0 and c_custkey % 5 = 0 then 'context' when c_custkey % 3 = 0 then 'teacher' end as origin, c_custkey % 4 = 1 as conflict from customer")
def filled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a document, a teacher or the context gives, and pairs of texts that do and don't contradict each other."""
    k = F.col("c_custkey")
    current, source, found = F.when(k % 5 == 0, " ").otherwise(F.lit("old")), F.when(k % 3 == 0, "teacher"), F.when(k % 2 == 0, "found")
    value, origin = documents.filled(current, source, found, F.lit("usual"))
    other = F.when(k % 4 == 0, "ATATURK LISESI").when(k % 4 == 1, "Kanuni Lisesi").when(k % 4 == 2, "lisesi").otherwise(F.lit("null"))
    return table(spark, d, "customer").select(k, value.alias("value"), origin.alias("origin"), documents.conflict(F.lit("ataturk  lisesi"), F.translate(other, "I", "i")).alias("conflict"))


@query("select conv_id, role as label, max(turn) as page from conversations where turn % 2 = 1 or role = 'user' group by all")
def heading_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns are pages, most with a heading on their second line."""
    has = (F.col("turn") % 2 == 1) | (F.col("role") == "user")
    said = F.concat(F.lit("x\n 1. TEMA: "), F.when(has, F.concat(F.col("role"), F.lit(" "))).otherwise(F.lit("")), F.lit("\ny"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), said.alias("text"))
    return retrieval.heading_pages(rows, r"[ ]*\d+\. TEMA: (\S.*)$").select(F.col("document").alias("conv_id"), "label", "page")


@query("with h as (select distinct conv_id, turn, role, coalesce(text, '') as text from conversations) select conv_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn, text, role)) as context, string_agg(role || ':' || turn || ':' || least(length(text), 300), ';' order by turn, text, role) as sources from h group by conv_id")
def hit_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as hits in order."""
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("document"), F.array("turn").alias("pages")).distinct()
    item = lambda s: F.concat_ws(":", s["document"], s["pages"][0].cast("string"), F.length(s["excerpt"]).cast("string"))
    return retrieval.contexts(hits).select(F.col("query_id").alias("conv_id"), F.md5("context").alias("context"), F.array_join(F.transform("sources", item), ";").alias("sources"))


@query("with k as (select p_partkey as k from part), r as (select k, case when k % 5 = 0 then 'no result' when k % 7 = 0 then 'no source' when k % 3 = 0 then 'refused' when k % 4 = 0 then 'prescribes' when k % 11 = 0 then 'scope' else 'published' end as reason from k) select cast(k as varchar) as name, reason, case when reason = 'published' then 'Tamam iyi.' else '' end as answer, cast(case when k % 5 > 0 and k % 3 > 0 and (k % 4 = 0 or k % 11 > 0) then 1 else 0 end as integer) as dropped from r")
def published_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are missing, without a source, refused, prescribe only or in part, name a foreign code, or are fine."""
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, "Bilgi yok.").when(k % 4 == 0, "Bu gerekir.").when(k % 11 == 0, "TDE9.9 iyi.").otherwise(F.lit("Tamam iyi. Tavsiye ederim."))
    rows = table(spark, d, "part").select(k, k.cast("string").alias("name"))
    owners = rows.select("name", F.lit(0.5).alias("rate"), F.array(F.lit("TDE1.1")).alias("codes"), F.lit("written").alias("component"), F.lit(None).cast("string").alias("description"))
    return prompts.published(owners, rows.where(k % 5 > 0).select("name", said.alias("answer")), rows.where(k % 7 > 0).select("name"), "Bilgi yok")


@query("select l_partkey % 100 as outcome, count(*) as many, 'critical' as severity from lineitem where l_quantity < 25 and l_partkey % 100 % 3 > 0 and l_partkey % 100 % 4 > 0 group by all union all select l_partkey % 100, count(*), 'medium' from lineitem where l_quantity >= 25 and l_quantity < 35 and l_partkey % 100 % 3 > 0 and l_partkey % 100 % 4 > 0 group by all")
def weak_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes to ask about: weak ones with a program and a theme."""
    k = F.col("l_partkey") % 100
    rows = table(spark, d, "lineitem").select(k.alias("outcome"), (F.col("l_quantity") / 50).alias("rate"), F.when(k % 3 > 0, "p").alias("program"), F.when(k % 4 > 0, "t").otherwise(F.lit("")).alias("theme"))
    return prompts.weak(rows).groupBy("outcome", "severity").agg(F.count("*").alias("many"))


@query("select event_id, '{\"a\": \"x\", \"b\": ' || event_id || '}' as first, '{\"a\":\"x\",\"b\":' || event_id || '}' as canonical from events where event_id % 2 = 0 union all select event_id, null, null from events where event_id % 2 = 1")
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model: a fenced object with something after it, or no object."""
    k = F.col("event_id")
    said = F.when(k % 2 == 0, F.concat(F.lit('```json\n{"a": "x", "b": '), k.cast("string"), F.lit("}\n``` so"))).otherwise(F.lit("none {"))
    swapped = F.when(k % 2 == 0, F.concat(F.lit('{"b": '), k.cast("string"), F.lit(', "a": "x"}'))).otherwise(F.lit("x"))
    return table(spark, d, "events").select("event_id", json_text.first_object(said).alias("first"), json_text.canonical(swapped).alias("canonical"))


@query("select p_partkey, p_size || '.000' as whole, p_size || ',25' as part_, '%' || p_size as percent, case when p_size >= 10 then p_size // 10 || ',' || p_size % 10 || ' sn' else p_size * 100 || ' ms' end as duration, p_size || '.pdf' as base, 'pdf' as suffix from part")
def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    path = F.concat(F.lit("a/b\\"), n.cast("string"), F.lit(".pdf"))
    return table(spark, d, "part").select(
        "p_partkey", text.turkish_number(n * 1000.0).alias("whole"), text.turkish_number(n + 0.25).alias("part_"), text.turkish_percent(n / 100.0).alias("percent"), text.duration_text(n * 100.0).alias("duration"),
        text.basename(path).alias("base"), text.suffix(path).alias("suffix"),
    )


@query("select p_partkey || '-a-1' as id, 'A.1' as code, 'T' || p_partkey as parent_code from part where p_partkey % 6 = 0 union all select p_partkey || '-b-2', 'B 2', 'T' || p_partkey from part where p_partkey % 6 = 0 union all select cast(p_partkey as varchar), 'T' || p_partkey, null from part where p_partkey % 3 = 0 and p_partkey % 2 = 1")
def outcome_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of three skills, each other one with two process components."""
    k = F.col("p_partkey")
    skill = F.when(k % 3 == 0, "Konuşma").when(k % 3 == 1, "Okuma")
    children = F.when(k % 2 == 0, F.array(F.struct(F.lit("A.1").alias("code"), F.lit("t").alias("title")), F.struct(F.lit("B 2").alias("code"), F.lit("u").alias("title"))))
    rows = table(spark, d, "part").select(k.cast("string").alias("id"), F.concat(F.lit("T"), k.cast("string")).alias("code"), F.col("p_name").alias("title"), F.col("p_type").alias("theme"), skill.alias("skill"), children.alias("processComponents"))
    return programs.catalog(rows, "speaking").select("id", "code", "parent_code")

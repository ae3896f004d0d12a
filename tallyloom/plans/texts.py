"""Queries of text functions, guards, reports, retrieval, sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import digests, text
from tallyloom.operators import backups, programs, reports, retrieval, textguard
from tallyloom.plans.registry import Registry, table
from tallyloom.sources import readers
from tallyloom.streaming import events as E

query = Registry()
_PRESCRIBED = "thing|tion"


@query("select p_partkey, coalesce(nullif(trim(case when p_size = 1 then p_name else ' ' end), ''), p_type || ' | ' || p_brand) as outcome_key from part")
def outcome_key(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("p_size") == 1, F.col("p_name")).otherwise(F.lit(" "))
    return table(spark, d, "part").select("p_partkey", text.outcome_key(given, F.col("p_type"), F.col("p_brand"), F.col("p_size")).alias("outcome_key"))


@query("with k as (select p_partkey, unnest(['en', 'er', 'st', 'widget', 'col']) as keyword, p_name from part), m as (select p_partkey, keyword from k where contains(lower(p_name), keyword)) select p_partkey, keyword as outcome from m union all select p_partkey, 'GEN.1' from part where p_partkey not in (select p_partkey from m)")
def keyword_join(spark: SparkSession, d: str) -> DataFrame:
    outcomes = spark.createDataFrame([(w, [w.upper(), ""]) for w in ("en", "er", "st", "widget", "col")], "outcome_id string, keywords array<string>")
    links = programs.keyword_links(table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("text")), outcomes, "GEN.1")
    return links.select(F.col("question_id").alias("p_partkey"), F.col("outcome_id").alias("outcome"))


@query("with p as (select distinct o_custkey, o_orderkey % 97 as page from orders where o_orderkey % 97 > 0), i as (select o_custkey, page, page - row_number() over (partition by o_custkey order by page) as island from p), r as (select o_custkey, island, min(page) as a, max(page) as b from i group by all) select o_custkey, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ', ' order by a) as ranges from r group by o_custkey")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return reports.page_ranges(table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 97).alias("page")), ["o_custkey"])


@query("select conv_id, turn as first_page, coalesce(lead(turn) over (partition by conv_id order by turn, role) - 1, n) as last_page, role as title from (select *, max(turn) over (partition by conv_id) as n from (select distinct conv_id, turn, role from conversations)) where role = 'user'")
def section_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("pages"))
    heads = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("page"), F.col("role").alias("title")).distinct()
    return retrieval.sections(heads.join(last, "conv_id"), ["conv_id"])


@query("select lang, source as document, string_agg(cast(page as varchar), ',' order by page) filter (page > 0) as pages, min(first_doc) as first_doc from (select lang, source, doc_id % 5 as page, min(doc_id) as first_doc from documents group by all) group by lang, source having max(page) > 0")
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("lang", F.col("source").alias("document"), F.array((F.col("doc_id") % 5).cast("int")).alias("pages"), F.col("doc_id").alias("place"))
    merged = reports.merged_sources(hits, ["lang"]).where(F.size("pages") > 0)
    return merged.select("lang", "document", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.col("place").alias("first_doc"))


@query("select lang, source as document, case when count(*) over (partition by lang) > 1 then 'K' || row_number() over (partition by lang order by place, source) else '' end as label from (select lang, source, min(doc_id) as place from documents group by all)")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("document"), F.col("doc_id").alias("place"))
    return reports.citation_labels(rows, ["lang"]).select("lang", "document", "label")


_HITS = "with s as (select q.vec_id as query_id, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as score {extra} from embeddings q, embeddings c where q.vec_id % 20 = 0 {same}), r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) "


@query(_HITS.format(extra="", same="") + "select query_id, chunk_id, score, cast(rank as integer) as rank from (select *, max(score) over (partition by query_id) as best from r where rank <= 5) where best <= 0 or score >= best * 0.78::double")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return retrieval.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), [])


@query(_HITS.format(extra="", same="") + "select query_id, chunk_id, score, cast(rank as integer) as rank from (select *, max(score) over (partition by query_id) as best from r where rank <= 5) where best <= 0 or score >= best * 0.78::double")
def vector_lists(spark: SparkSession, d: str) -> DataFrame:
    """The hits of vector_topk through lists around centroids, of which a query reads those that its bounds don't rule out."""
    rows = table(spark, d, "embeddings")
    index = retrieval.inverted(rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), [])
    return retrieval.search_lists(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), index, [])[0]


@query(_HITS.format(extra=", q.label", same="and q.label = c.label") + "select query_id, chunk_id, score, cast(rank as integer) as rank from r where rank <= 8")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return retrieval.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"), ["label"], k=8, floor=None)


@query("with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as words from documents), c as (select doc_id, words, unnest(range((len(words) + 511) // 512)) as i from w) select doc_id as document, cast(i as integer) as chunk_index, array_to_string(words[i * 512 + 1 : (i + 1) * 512], ' ') as text, cast(len(words[i * 512 + 1 : (i + 1) * 512]) as integer) as words from c")
def chunking(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("document"), "text"), 512)


@query("with h as (select doc_id, sha1(from_hex('59b00b8686ac5690b5e5af5ffc2604d1') || encode(concat_ws('|', lang, source, cast(doc_id as varchar), coalesce(text, '')))) as h from documents) select doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][cast('0x' || h[17:17] as integer) % 4 + 1] || h[18:20] || '-' || h[21:32] as chunk_id from h")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", digests.chunk_id(F.col("lang"), F.col("source"), F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("chunk_id"))


@query("select max(doc_id) as doc_id, md5(coalesce(text, '')) as digest from documents group by 2")
def dedupe_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return retrieval.upsert(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "digest", "doc_id")


@query(f"with s as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as every from documents) select doc_id, md5(trim(array_to_string(list_filter(every, lambda x: not regexp_matches(x, '{_PRESCRIBED}')), ' '))) as kept, cast(len(every) - len(list_filter(every, lambda x: not regexp_matches(x, '{_PRESCRIBED}'))) as integer) as dropped from s")
def sentence_guard(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped = textguard.without_sentences(F.col("text"), _PRESCRIBED)
    return table(spark, d, "documents").select("doc_id", F.md5(kept).alias("kept"), dropped.alias("dropped"))


@query("select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+(?:[''’][\\p{L}\\p{N}_]+)?')) as integer) as words, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+(?:[''’][\\p{L}\\p{N}_]+)?')) <= 70 as short from documents")
def word_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words")).withColumn("short", F.col("words") <= textguard.WEAK_WORDS)


@query("select doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')), lambda x: not list_contains(['1', '2', '3'], x))), ',') as foreign_codes from documents")
def code_whitelist(spark: SparkSession, d: str) -> DataFrame:
    foreign = textguard.foreign_codes(F.coalesce("text", F.lit("")), F.array(*[F.lit(x) for x in "123"]), "([0-9]+)")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(foreign), ",").alias("foreign_codes"))


@query("select p_partkey, p_partkey % 5 in (1, 2) and p_partkey % 7 <> 0 and not (p_partkey % 4 = 0 and p_partkey % 3 = 0) as fits from part")
def answer_scope(spark: SparkSession, d: str) -> DataFrame:
    """Answers that name a code, some of another program, some with words of action or of another skill."""
    k = F.col("p_partkey")
    answer = F.concat(F.col("p_name"), F.lit(" TDE1."), (k % 5).cast("string"), F.when(k % 7 == 0, " Etkinlik yap").otherwise(""), F.when(k % 4 == 0, " yazma beceri").otherwise(""))
    component = F.when(k % 3 == 0, "Speaking").otherwise("written")
    return table(spark, d, "part").select("p_partkey", textguard.in_scope(answer, F.lit(0.5), F.array(F.lit("TDE1.1"), F.lit("tde1.2")), component, F.lit(None).cast("string")).alias("fits"))


@query("select p_partkey, trim(regexp_replace(lower(translate(p_name || ' ' || p_type, 'ÇĞİÖŞÜçğıöşü', 'CGIOSUcgiosu')), '[^a-z0-9]+', ' ', 'g')) as label from part")
def label_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.label_fold(F.concat_ws(" ", "p_name", "p_type")).alias("label"))


@query("select c_custkey, try_cast(nullif(regexp_extract(replace(c_name, ',', '.'), '-?\\d+(?:\\.\\d+)?'), '') as double) as number from customer")
def number_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.lenient_number(F.col("c_name")).alias("number"))


@query("select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as shown, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def date_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("shown"))
    return rows.withColumn("iso", F.date_format(text.any_date(F.col("shown")), "yyyy-MM-dd"))


@query("with n as (select c_custkey, lpad(cast(10000000000 + c_custkey * 7919 as varchar), 11, '0') as id from customer), x as (select *, list_transform(string_split(id, ''), lambda c: cast(c as integer)) as g from n) select c_custkey, (g[10] = (((g[1] + g[3] + g[5] + g[7] + g[9]) * 7 - (g[2] + g[4] + g[6] + g[8])) % 10 + 10) % 10 and g[11] = (g[1] + g[2] + g[3] + g[4] + g[5] + g[6] + g[7] + g[8] + g[9] + g[10]) % 10) as valid from x")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", digests.national_id((F.col("c_custkey") * 7919 + F.lit(10_000_000_000)).cast("string")).alias("valid"))


@query("select page_id, item from (select page_id, trim(regexp_replace(unnest(regexp_extract_all(coalesce(html, ''), '(?is)<li[^>]*>(.*?)</li>', 1)), '<[^>]*>', '', 'g')) as item from pages)")
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(readers.list_items(F.col("html"))).alias("item"))


@query("select event_id, json_extract_string(props, '$.page') as page from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("select o_orderkey, o_orderkey % 10 > 1 as valid, o_orderstatus as status, o_custkey as customer from orders")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Some manifests are of another schema, some of a later version."""
    rows, last = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), "o_totalprice"), F.col("o_orderkey") % 10
    kinds = [(last > 1, "report", 1), (last == 0, "letter", 1), (last == 1, "report", 2)]
    written = [reports.manifest(rows.where(some), "o_orderkey", ["status", "customer"], schema, version) for some, schema, version in kinds]
    return reports.read_manifest(written[0].unionByName(written[1]).unionByName(written[2]), "report", "status: string, customer: bigint")


_UNITS = "list_transform(string_split(p_name, ''), lambda x: cast(unicode(x) as bigint))"


@query(f"select p_partkey, lpad(printf('%x', list_reduce({_UNITS}, lambda h, x: (xor(h, x) * 16777619) & 4294967295, cast(2166136261 as bigint))), 8, '0') as fnv1a, xor(list_reduce({_UNITS}, lambda c, b: list_reduce(cast(range(8) as bigint[]), lambda z, i: xor(z >> 1, 3988292384 * (z & 1)), xor(c, b)), cast(4294967295 as bigint)), 4294967295) as crc from part")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", digests.fnv1a(F.col("p_name")).alias("fnv1a"), F.crc32(F.col("p_name").cast("binary")).alias("crc"))


@query("with recursive o as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts) as n from events), f(user_id, n, fired, last) as (select user_id, n, true, us from o where n = 1 union all select o.user_id, o.n, o.us - f.last >= 21600000000, case when o.us - f.last >= 21600000000 then o.us else f.last end from f join o on o.user_id = f.user_id and o.n = f.n + 1) select user_id, last as fired_us from f where fired")
def throttle(spark: SparkSession, d: str) -> DataFrame:
    return E.throttled(table(spark, d, "events"), "user_id", "ts", 6 * 3600)


@query("select user_id, count(*) // 20 as complete, count(*) % 20 as waiting from events group by user_id")
def group_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return E.group_sizes(table(spark, d, "events"), "user_id", 20)


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select event_type, epoch_us(time_bucket(interval 1 hour, ts)) as start_us, count(*) as many from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.windowed(rows, "ts", "event_type", "1 hour").select("event_type", F.unix_micros("start").alias("start_us"), "many")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Backups by order: some of a later or an earlier version, some with a name, some changed after they were sealed."""
    key = F.col("o_orderkey")
    version = F.when(key % 3 == 0, 3).when(key % 3 == 1, 1).otherwise(2)
    space = F.to_json(F.struct("o_orderstatus", F.when(key % 5 == 0, "x").alias("fullName")))
    rows = table(spark, d, "orders").select(key.alias("record_id"), version.alias("version"), space.alias("workspace"))
    return backups.sealed(rows).withColumn("workspace", F.when(F.col("record_id") % 7 == 0, F.concat("workspace", F.lit(" "))).otherwise(F.col("workspace")))


@query("select case when o_orderkey % 7 = 0 then 'broken' when o_orderkey % 5 = 0 then 'private' when o_orderkey % 3 = 0 then 'newer' when o_orderkey % 3 = 1 then 'old' else 'ok' end as status, count(*) as many from orders group by 1")
def backup_tally(spark: SparkSession, d: str) -> DataFrame:
    return backups.tally(_records(spark, d), ["fullName"])


@query("select o_orderkey as record_id, cast(2 as integer) as version, '{\"o_orderstatus\":\"' || o_orderstatus || '\"' || case when o_orderkey % 3 = 1 then ',\"questionApprovals\":[]' else '' end || '}' as workspace from orders where o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0")
def backup_migrate(spark: SparkSession, d: str) -> DataFrame:
    return backups.migrated(_records(spark, d), ["fullName"]).select("record_id", "version", "workspace")

"""Tables and texts of reports: page ranges, citations, sources, levels, lines of a text report, portable manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import bands, text


def page_ranges(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ranges ("66-68, 71"), from pages(keys, page): repeats and pages below 1 are dropped."""
    once = pages.where("page > 0").select(*keys, "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    runs = once.withColumn("island", island).groupBy(*keys, "island").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    word = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", word.alias("word")))), lambda x: x["word"]), ", ").alias("ranges"))


def merged_sources(hits: DataFrame, keys: list[str]) -> DataFrame:
    """For each document of keys its sorted pages and the first place it is at, from hits(keys, document, pages, place)."""
    named = hits.where(text.blank_to_null(F.col("document")).isNotNull())
    good = named.withColumn("pages", F.filter(F.coalesce("pages", F.array().cast("array<int>")), lambda p: p > 0))
    each = good.select(*keys, F.trim("document").alias("document"), "place", F.explode_outer("pages").alias("page"))
    return each.groupBy(*keys, "document").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.min("place").alias("place"))


def source_focuses(hits: DataFrame, keys: list[str]) -> DataFrame:
    """For each document of keys its distinct focuses by first place, joined; hits(keys, document, focus, place)."""
    first = hits.where(text.blank_to_null(F.col("focus")).isNotNull()).groupBy(*keys, "document", "focus").agg(F.min("place").alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "focus"))), lambda x: x["focus"])
    return first.groupBy(*keys, "document").agg(F.array_join(listed, ", ").alias("focuses"))


def citation_labels(sources: DataFrame, keys: list[str]) -> DataFrame:
    """K1, K2 and so on for a report's documents by first place; blank where there is one. sources(keys, document, place)."""
    first = sources.groupBy(*keys, "document").agg(F.min("place").alias("place"))
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("place", "document"))
    return first.withColumn("label", F.when(F.count("*").over(w) > 1, F.concat(F.lit("K"), rank.cast("string"))).otherwise(F.lit("")))


def citation(label: Column, ranges: Column) -> Column:
    """(K1, s. 66-68); empty without pages."""
    return F.when(F.coalesce(ranges, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("("), F.when(label != "", F.concat(label, F.lit(", "))).otherwise(F.lit("")), F.lit("s. "), ranges, F.lit(")")))


def level_lists(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """For each display level the outcomes in it, sorted and joined."""
    return outcomes.withColumn("level", bands.display_level(F.col("rate"))).groupBy(*keys, "level").agg(F.array_join(F.array_sort(F.collect_list("outcome")), ", ").alias("outcomes"), F.count("*").alias("many"))


def strong_and_weak(outcomes: DataFrame) -> DataFrame:
    """For each component its strong and its weak outcomes, sorted and joined; outcomes(component, outcome, rate)."""
    side = F.when(F.col("rate") >= bands.WEAK, "strong").otherwise(F.lit("weak"))
    wide = outcomes.withColumn("side", side).groupBy("component").pivot("side", ["strong", "weak"]).agg(F.array_join(F.array_sort(F.collect_list("outcome")), ", "))
    return wide.na.fill("", ["strong", "weak"])


def text_report(questions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Lines (exam, section, place, line) of a text report: success of questions(exam, question, rate) and outcomes(exam, outcome, rate)."""
    first = questions.select("exam", F.lit(2).alias("section"), F.col("question").cast("string").alias("place"), F.concat(F.lit("- Soru "), F.col("question").cast("string"), F.lit(": "), text.percent_text(F.col("rate"))).alias("line"))
    third = outcomes.select("exam", F.lit(3).alias("section"), F.col("outcome").cast("string").alias("place"), F.concat(F.lit("- "), F.col("outcome"), F.lit(": "), text.percent_text(F.col("rate"))).alias("line"))
    fourth = outcomes.select("exam", F.lit(4).alias("section"), F.col("outcome").cast("string").alias("place"), F.concat(F.lit("- "), F.col("outcome"), F.lit(": "), text.percent_text(F.col("rate")), F.lit(" | "), bands.early_level(F.col("rate"))).alias("line"))
    return first.unionByName(third).unionByName(fourth)


def manifest(rows: DataFrame, key: str, kept: list[str], schema: str, version: int = 1) -> DataFrame:
    """key and a portable JSON text, base64-encoded, with the kept columns only."""
    body = F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("schemaVersion"), F.struct(*kept).alias("body"))
    return rows.select(key, F.base64(F.to_json(body).cast("binary")).alias("manifest"))


def read_manifest(rows: DataFrame, schema: str, body: str, version: int = 1) -> DataFrame:
    """The bodies of manifests and whether each is of the schema and version; a broken one has valid = false."""
    parsed = F.from_json(F.unbase64("manifest").cast("string"), f"schema string, schemaVersion int, body struct<{body}>")
    out = rows.withColumn("_m", parsed)
    valid = F.coalesce((F.col("_m.schema") == schema) & (F.col("_m.schemaVersion") == version), F.lit(False))
    return out.select(*[c for c in rows.columns if c != "manifest"], valid.alias("valid"), "_m.body.*")

"""URL filters: association rules over URL tokens, mined by Spark's FP-growth from labelled pages.

A transaction is the set of a labelled page's URL tokens, as far as they occur in enough blocked pages, and its label; of tokens that occur in the
same labelled pages the least one stands for all. FP-growth's work grows with the number of subsets, so a transaction has at most 2 * GROUP
tokens: a longer one is cut into groups of GROUP tokens, and each two groups are a transaction. So all sets of one or two tokens are found. Where URLs are
cut, larger sets are grown from FP-growth's pairs, one token at a time, and counted in all labelled pages, until none is left: a set is grown only if all its
subsets occur in enough blocked pages, none is in the same pages as a subset of its own and none is in blocked pages alone, since otherwise a
smaller set says as much. So no rule is lost, however long URLs are. A
page of k + 1 groups counts a set at most k times, so a rule of confidence c has one of at least c / (c + k (1 - c)) among transactions: those
rules are counted again in all labelled pages. Those with enough support and confidence stay, without those that a rule of fewer tokens implies. An inverted index from token to rules finds the
rules whose tokens a URL all has: the page is blocked if there is one. Fixed rules (host, path prefix) come before:
the longest that fits decides.

DataFrame functions only. Rows with null urls, or without "://", have empty host and path and no tokens; the method
allows them. Repeated rows are judged each; a page_id may be null or repeat. Labels without page_id or verdict are ignored; other columns than
page_id and url are, too, whatever their names. Token sets are matched by the MD5 of their text, once each. The number of rules is bounded by the
support, not by the data; their index is broadcast while it has at most BROADCAST rows, else joined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT, stage

#: Share of labelled pages that a rule's tokens and label must occur in, and of pages with its tokens that have the label.
SUPPORT, CONFIDENCE = 0.002, 0.5
#: Labelled pages, at least, that a rule's tokens and label must occur in.
COUNT = 4
_BLOCK = "label=block"
#: Tokens of a group; two groups are a transaction.
GROUP = 5
#: Rows of an index (a token of a rule each) that may be broadcast: a few MB.
BROADCAST = 50_000
#: A rule's confidence must be so many times the share of blocked pages.
LIFT = 1.2


def host(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, with A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its labels, path segments (numbers as a class and by length), suffix, parameters."""
    h, p = host(url), path(url)
    labels = F.transform(F.filter(F.split(h, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    parts = F.filter(F.split(F.lower(p), "/"), lambda x: x != "")
    shape = F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("number="), F.length(x).cast("string"))).otherwise(F.concat(F.lit("p="), F.regexp_replace(x, r"\d+", "0"))))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    rest = F.filter(F.array(F.concat(F.lit("s="), F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.when(F.contains(url, F.lit("#")), F.lit("anchor"))), lambda x: x.isNotNull())
    found = F.array_distinct(F.concat(labels, shape, query, rest))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(found)


def _id(items: Column) -> Column:
    return F.md5(F.to_json(items))


def _subsets(index: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id and rule_id of the rules of index(rule_id, need, item) whose items sets(set_id, items) all have. At most BROADCAST rows are broadcast."""
    few = index.limit(BROADCAST + 1).count() <= BROADCAST
    found = sets.select("set_id", F.explode("items").alias("item")).join(F.broadcast(index) if few else index, "item")
    return found.groupBy("set_id", "rule_id").agg(F.count("*").alias("have"), F.first("need").alias("need")).where("have = need").select("set_id", "rule_id")


def _index(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.size("items").alias("need"), F.explode("items").alias("item"))


def transactions(baskets: DataFrame, group: int = GROUP) -> DataFrame:
    """baskets(items, ...) with at most 2 * group items: the items of each two groups of longer ones."""
    items, n = F.col("items"), F.ceil(F.size("items") / group).cast("int")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * group + 1, F.lit(group)))
    cut = baskets.where(F.size("items") > 0).withColumn("groups", groups)
    last = F.size("groups")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.concat(F.element_at("groups", i), F.element_at("groups", j)))))
    rest = [c for c in baskets.columns if c != "items"]
    return cut.select(F.explode(F.when(last > 2, pairs).otherwise(F.array("items"))).alias("items"), *rest)


def _counted(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Staged candidates(items, ...) with rule_id, pages and blocked: in how many of sets(set_id, items, pages, blocked) all of a candidate's items are."""
    named = stage(candidates.withColumn("rule_id", _id(F.col("items"))))
    counts = _subsets(_index(named), sets.select("set_id", "items")).join(sets.select("set_id", "pages", "blocked"), "set_id")
    return stage(named.join(counts.groupBy("rule_id").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("blocked")), "rule_id"))


def _without_one(items: Column) -> Column:
    """All subsets of a sorted array that lack one of its items."""
    return F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.concat(F.slice(items, F.lit(1), i - 1), F.slice(items, i + 1, F.size(items))))


def grown(pairs: DataFrame, singles: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """items of the sets of three tokens or more that can be rules that no smaller set implies, grown from pairs(items) of singles(items, pages) level by level.

    All candidates are counted in sets(set_id, items, pages, blocked). A level's candidates join two sets of the level before that differ in their last token.
    """
    below, out = singles.select("items", "pages"), None
    level = _counted(pairs.select("items").distinct(), sets)
    while True:
        subsets = level.select("rule_id", F.explode(_without_one(F.col("items"))).alias("sub")).join(below.select(F.col("items").alias("sub"), F.col("pages").alias("sub_pages")), "sub")
        free = subsets.groupBy("rule_id").agg(F.count("*").alias("have"), F.min("sub_pages").alias("fewest"))
        level = level.join(free, "rule_id").where((F.col("have") == F.size("items")) & (F.col("pages") < F.col("fewest")) & (F.col("blocked") >= least))
        level = stage(level.select("items", "pages", "blocked"))
        size = level.select(F.size("items")).limit(1).collect()
        if not size:
            return out
        if size[0][0] > 2:
            out = level.select("items") if out is None else out.unionByName(level.select("items"))
        below = level.where("blocked < pages")  # what is only in blocked pages is as sure as can be
        head, last = F.slice("items", F.lit(1), F.size("items") - 1), F.element_at("items", -1)
        a, b = below.select(head.alias("head"), last.alias("a")), below.select(head.alias("head"), last.alias("b"))
        level = _counted(a.join(b, "head").where("a < b").select(F.concat("head", F.array("a", "b")).alias("items")), sets)


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, count: int = COUNT) -> DataFrame:
    """Rules (rule_id, items, support, confidence) for blocking, from pages(page_id, url) and labels(page_id, block boolean).

    A page with several labels is blocked if one says so. Empty tables and labels without a blocked page give no rules.
    """
    spark = pages.sparkSession
    known = labels.where("page_id is not null and block is not null").groupBy("page_id").agg(F.max("block").alias("block"))
    marked = pages.select("page_id", F.array_sort(tokens(F.col("url"))).alias("items")).join(known, "page_id")
    sets = stage(marked.groupBy("items").agg(F.count("*").alias("pages"), F.count_if("block").alias("blocked")).withColumn("set_id", _id(F.col("items"))))
    total, blocked = sets.agg(F.coalesce(F.sum("pages"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    none = "rule_id string, items array<string>, support double, confidence double"
    if not blocked:
        return spark.createDataFrame([], none)
    least = max(count, support * total)
    item = sets.select("set_id", "pages", "blocked", F.explode("items").alias("item")).groupBy("item")
    item = item.agg(F.sum("blocked").alias("blocked"), F.sum("pages").alias("pages"), F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("where")).where(F.col("blocked") >= least)
    item = item.groupBy("where", "pages", "blocked").agg(F.min("item").alias("item"))
    frequent = sets.select("set_id", "pages", "blocked", F.explode("items").alias("item")).join(item.select("item"), "item")
    frequent = stage(frequent.groupBy("set_id").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("pages").alias("pages"), F.first("blocked").alias("blocked")))
    copies = transactions(frequent).withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages"))))
    baskets = stage(copies.select(F.when(F.col("page") <= F.col("blocked"), F.array_append("items", _BLOCK)).otherwise(F.col("items")).alias("items")))
    many, longest = baskets.count(), frequent.agg(F.max(F.size("items"))).first()[0] or 0
    if not many:
        return spark.createDataFrame([], none)
    c, k = min(1.0, max(confidence, lift * blocked / total)), max(1, math.ceil(longest / GROUP) - 1)
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / many), minConfidence=c / (c + k * (1 - c)) * (1 - 1e-9)).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1) == _BLOCK).select(F.array_sort("antecedent").alias("items"))
    if longest > 2 * GROUP:
        pairs = model.freqItemsets.where((F.size("items") == 3) & F.array_contains("items", _BLOCK)).select(F.array_sort(F.array_remove("items", _BLOCK)).alias("items"))
        larger = grown(pairs, item.select(F.array("item").alias("items"), "pages"), frequent, least)
        found = found if larger is None else found.unionByName(larger).distinct()
    found = stage(found.withColumn("rule_id", _id(F.col("items"))))
    counts = _subsets(_index(found), sets.select("set_id", "items")).join(sets, "set_id").groupBy("rule_id").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("blocked"))
    sure = F.col("blocked") / F.col("pages")
    good = counts.where((F.col("blocked") >= least) & (sure >= confidence) & (sure >= lift * blocked / total))
    found = stage(found.join(good, "rule_id").select("rule_id", "items", (F.col("blocked") / total).alias("support"), sure.alias("confidence")))
    # a rule goes if one of its tokens' subsets is a rule with at least its confidence; subsets are found by their id
    size = F.size("items")
    subset = F.explode(F.when(size > 1, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_remove(F.col("items"), F.element_at("items", i)))).otherwise(F.array().cast("array<array<string>>")))
    smaller = found.select(F.col("rule_id").alias("sub_id"), F.col("confidence").alias("sub_confidence"))
    implied = found.select("rule_id", "confidence", subset.alias("s")).withColumn("sub_id", _id(F.col("s")))
    implied = implied.join(smaller, "sub_id").where("sub_confidence >= confidence").select("rule_id").distinct()
    return found.join(implied, "rule_id", "left_anti")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """set_id, many (rows that have the set) and the best confidence of the rules whose items each distinct set of pages(items) has all of.

    The index maps each rule's tokens to the rule; distinct token sets are looked up once.
    """
    sets = pages.groupBy(F.array_sort("items").alias("items")).agg(F.count("*").alias("many")).withColumn("set_id", _id(F.col("items")))
    full = _subsets(_index(rules), sets.select("set_id", "items")).join(rules.select("rule_id", "confidence"), "rule_id")
    return full.groupBy("set_id").agg(F.max("confidence").alias("confidence")).join(sets.select("set_id", "many"), "set_id")


def fixed_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """rule and verdict of the longest of rules (verdict, host, path prefix) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((h == at) | h.endswith("." + at)) & p.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the best mined rule of each row of pages(page_id, url)."""
    h, p = host(F.col("url")), path(F.col("url"))
    rule, says = fixed_rule(F.col("host"), F.col("path"), fixed)
    rows = pages.select("page_id", h.alias("host"), p.alias("path"), _id(F.array_sort(tokens(F.col("url")))).alias("set_id"))
    hits = stage(matches(pages.select(tokens(F.col("url")).alias("items")), rules))
    often = F.col("many") * FREQUENT > (hits.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0])
    # a set that many rows have, of which there are fewer than FREQUENT, is found in a broadcast table
    hot = hits.where(often).select(F.col("set_id").alias("hot_id"), F.col("confidence").alias("hot_confidence"))
    rest = hits.where(~often).select(F.col("set_id").alias("rest_id"), "confidence")
    rows = rows.join(F.broadcast(hot), F.col("set_id") == F.col("hot_id"), "left")
    rows = rows.withColumn("dealt", F.when(F.col("hot_id").isNull(), F.col("set_id")).otherwise(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    rows = rows.join(rest, F.col("dealt") == F.col("rest_id"), "left").withColumn("confidence", F.coalesce("hot_confidence", "confidence"))
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, mined).alias("verdict"), F.col("confidence").alias("rule_confidence"))

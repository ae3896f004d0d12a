"""Sections within sections by headings on pages, and chunks of text that fit a number of tokens, with the headings above them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a chunk with its headings.
TOKENS = 512
#: Characters of the chunks that a task hands on at once.
BATCH = 4_000_000


def nested_sections(pages: DataFrame, outer: str, inner: str) -> DataFrame:
    """document, grade, theme, first_page, last_page: the sections of pages(document, page, text) by two levels of headings.

    A pattern is matched line by line and its first group is the label; a page's first match counts, and of a label's pages the last: tables of contents come first. A section ends
    before the next of its level begins. Inner labels count by themselves within each outer section, and a section reaches to that one's end. Pages before the
    first heading of a level belong to no section, unless the level has no heading there: then its label is null and the section is the whole range.

    Pages of a document meet in one task, once: a row for each page that has a heading.
    """
    label = lambda p: F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), f"(?m){p}", 1)), F.lit(""))
    read = pages.where("document is not null and page is not null").select("document", F.col("page").cast("int").alias("page"), label(outer).alias("g"), label(inner).alias("t"))
    last = read.groupBy("document").agg(F.max("page").alias("pages"), F.min("page").alias("begin"))
    of_document, by_label = Window.partitionBy("document"), lambda *c: Window.partitionBy("document", *c)
    heads = read.where("g is not null or t is not null").groupBy("document", "page").agg(F.min("g").alias("g"), F.min("t").alias("t"))
    heads = heads.withColumn("g", F.when(F.col("page") == F.max("page").over(by_label("g")), F.col("g")))
    # the section of a page begins at the last outer heading up to it
    heads = heads.withColumn("at", F.max(F.when(F.col("g").isNotNull(), F.col("page"))).over(of_document.orderBy("page")))
    outers = heads.where("g is not null").select("document", F.col("g").alias("grade"), F.col("page").alias("at")).withColumn("after", F.lead("at").over(of_document.orderBy("at")))
    outers = last.join(outers, "document", "left").select("document", "grade", F.coalesce("at", "begin").alias("at"), (F.coalesce(F.col("after") - 1, F.col("pages"))).alias("end"), F.col("at").isNull().alias("whole"))
    inners = heads.where("t is not null").groupBy("document", "at", F.col("t").alias("theme")).agg(F.max("page").alias("start"))
    inners = inners.withColumn("following", F.lead("start").over(by_label("at").orderBy("start")))
    # themes of documents without an outer heading have no outer page
    key = F.when(F.col("whole"), F.lit(None)).otherwise(F.col("o.at"))
    both = outers.alias("o").join(inners.alias("i"), (F.col("o.document") == F.col("i.document")) & key.eqNullSafe(F.col("i.at")), "left")
    return both.select(F.col("o.document").alias("document"), "grade", "theme", F.coalesce("start", "o.at").alias("first_page"), F.coalesce(F.col("following") - 1, F.col("end")).alias("last_page"))


def segments(text: str, count: Callable[[str], int], limit: int = TOKENS, heading: str = r"(#+)\s+(.+)", additive: bool = False) -> Iterator[tuple[list[str], str, str]]:
    """Headings, text and the two together of each chunk of a text; the chunks' texts one after the other are the text.

    A line that is a heading (whose first group's length is its level) begins a chunk and is above what follows until one of its level or above it comes. A chunk takes
    lines while it fits limit tokens with its headings. A line that alone doesn't fit is cut between words, and a word between
    characters. Headings that would take more than half of the limit are left out, outermost first. count is of tokens and should not shrink as text is added. If it is additive where
    texts meet at white space, each part is counted by itself; else all that a chunk holds is counted anew for each part.
    """
    pattern, stack, lines = re.compile(heading), [], text.splitlines(keepends=True)

    def context() -> list[str]:
        above = [title for _, title in stack]
        while above and count("\n".join(above)) > limit // 2:
            above = above[1:]
        return above

    def whole(above: list[str], said: str) -> str:
        return "\n".join([*above, said]) if above else said

    def grown(above: list[str], before: str, many: int, part: str) -> int:
        """Tokens of before and part with the headings; before has many with them."""
        if additive and before and (before[-1].isspace() or part[:1].isspace()):
            return many + count(part)
        return count(whole(above, before + part))

    def pieces(above: list[str], part: str) -> list[tuple[str, int]]:
        """part cut so that each piece fits, and each piece's tokens with the headings."""
        many = count(whole(above, part))
        if many <= limit or len(part) == 1:
            return [(part, many)]
        words = re.findall(r"\s*\S+(?:\s+$)?|\s+", part)
        units = words if len(words) > 1 else [part[: len(part) // 2], part[len(part) // 2 :]]
        out: list[str] = []
        last: list[int] = []
        for unit in units:
            # the longest run of units that fits; a unit by itself may have to be cut again
            if out and (n := grown(above, out[-1], last[-1], unit)) <= limit:
                out[-1] = out[-1] + unit
                last[-1] = n
            else:
                for piece, n in pieces(above, unit):
                    out.append(piece)
                    last.append(n)
        return list(zip(out, last, strict=True))

    above, held, many = [], "", 0
    for line in lines:
        if m := pattern.fullmatch(line.strip()):
            if held:
                yield above, held, whole(above, held)
            level = len(m[1])
            stack[:] = [x for x in stack if x[0] < level]
            above, held = context(), ""
            stack.append((level, m[2].strip()))
            for part, _ in pieces(above, line):
                if held:
                    yield above, held, whole(above, held)
                held = part
            if held:
                yield above, held, whole(above, held)
            above, held = context(), ""
            continue
        if held and (n := grown(above, held, many, line)) <= limit:
            held, many = held + line, n
            continue
        for part, n in pieces(above, line):
            if held:
                yield above, held, whole(above, held)
            held, many = part, n
    if held:
        yield above, held, whole(above, held)


def token_chunks(docs: DataFrame, vocabulary: str, limit: int = TOKENS, heading: str = r"(#+)\s+(.+)") -> DataFrame:
    """document, chunk_index (from 0, over all sections), headings, text, contextualized_text, tokens of docs(document, text); see segments().

    vocabulary is the path of a file of the tokenizers library, on all executors. Empty and null texts have no chunk; equal documents are cut alike, each by itself.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, int] = {}

        def count(text: str) -> int:
            """Tokens of a text: of its words, where the vocabulary never joins text across white space."""
            return sum(known[w] if w in known else known.setdefault(w, len(tokenizer.encode(w, add_special_tokens=False).ids)) for w in text.split())

        def table(batch, rows: list[tuple]):
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
            at, *columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], ["document", "chunk_index", "headings", "text", "contextualized_text", "tokens"])

        for batch in batches:
            rows, held = [], 0
            for at, text in enumerate(batch.column(1)):
                if len(known) > 500_000:
                    known.clear()
                for i, (above, said, whole) in enumerate(segments(text.as_py() or "", count, limit, heading, additive=True)):
                    rows.append((at, i, above, said, whole, count(whole)))
                    held += len(whole)
                    if held > BATCH:
                        yield table(batch, rows)
                        rows, held = [], 0
            if rows:
                yield table(batch, rows)

    kind = dict(docs.dtypes)["document"]
    return docs.select("document", "text").mapInArrow(run, f"document {kind}, chunk_index int, headings array<string>, text string, contextualized_text string, tokens int")

"""Files of several providers that share a reader, counts of their cells, pages that are cut at their tags."""

import random

from pyspark.sql import functions as F

from tallyloom.sources import providers, readers

PLAIN = ["<td>", "</td>", "<TH>", "</th>", "<tr>", "</tr>", "<Tr>", "<table>", "<b>", "</b>", '<p class="a b">', '<td colspan="2" data-x="&amp;">', "&amp;", "&lt;td&gt;", "&am", "p;", "&#65;", "a", " ", "\n", "\x00", "\xa0", "é", ">", '"']
ODD = ["<", "< td>", "<td/>", "<br />", "</b >", "<td colspan=2>", "<td a='1'>", '<td a="<">', '<td a="x"b="y">', "<td\n>", '</td x="1">', "<script>", "</script>", "<style>", "<textarea>", "<title>", "<!-- <td> -->", "<!doctype html>", "<?x <td>?>", "</t", "<x-y>", "<a:b>"]


def test_pages_as_the_parser_reads_them(monkeypatch):
    parser, dealt = readers._Rows, random.Random(16)

    def parsed(page):
        p = parser()
        p.feed(page)
        return p.rows

    for i in range(20_000):
        page = "".join(dealt.choices(PLAIN if i % 2 else PLAIN + ODD, k=dealt.randrange(24)))
        assert readers._html_rows(page) == parsed(page), page
    monkeypatch.setattr(readers, "_Rows", None)  # a plain page is read without the parser
    assert list(readers._html_cells(b'<p>x</p><table id="t"><tr><th>a &amp; b</th></tr><tr></tr><tr><td> 1 <b>2</b></td><td></td></tr></table>')) == [(0, 0, 0, "a & b"), (0, 1, 0, "1 2"), (0, 1, 1, "")]


def test_cells_are_handed_on_in_parts(spark, monkeypatch):
    pages = [(f"{i}.htm", "<tr>" + f"<td>{i}</td>" * i) for i in range(90)] + [("z.html", None)]
    df = spark.createDataFrame(pages, "path string, text string").select("path", F.col("text").cast("binary").alias("content")).coalesce(1)
    monkeypatch.setattr(readers, "CELL_ROWS", 7)

    class Held:  # the task's function, without Spark
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    parts = [x.num_rows for x in readers.cells(Held())(iter(df.toArrow().to_batches()))]
    assert set(parts[:-1]) == {7} and 0 < parts[-1] <= 7 and sum(parts) == sum(range(90)) + 2
    monkeypatch.undo()
    out = {r.path: (r.n, r.error) for r in readers.cells(df).groupBy("path").agg(F.count("text").alias("n"), F.max("error").alias("error")).collect()}
    assert out.pop("z.html")[1].startswith("TypeError") and out == {f"{i}.htm": (i, None) for i in range(90)}


def test_one_pass_for_each_reader(spark):
    asked = []

    def read(rows):
        asked.append(rows)
        return rows.select("path", *[F.lit(0).alias(c) for c in ("table_ix", "row_ix", "cell_ix")], F.col("content").cast("string").alias("text"), F.when(F.col("content") == b"bad", "broken").alias("error"))

    own = providers.Providers(providers.Provider("one", ("a", "b"), read, "ONE"), providers.Provider("two", ("c", "b"), read, "TWO"), providers.Provider("never", ("d",), warning="LATER"), providers.Provider("none", ()))
    df = spark.createDataFrame([(p, b"bad" if p and p[0] == "y" else b" x ") for p in ("x.a", "x.B", "x.c", "y.a", "y.b", "x.d", "x.e", "x", "x.", None)], "path string, content binary")
    cells = own.cells(df)
    out = {r.path: (r.provider, r.tables, r.cells, r.warning) for r in providers.documents(cells).collect()}
    blank = (None, 0, 0, "NO_PROVIDER")
    assert out == {"x.a": ("one", 1, 1, None), "x.B": ("two", 1, 1, None), "x.c": ("two", 1, 1, None), "y.a": ("one", 1, 1, "ONE: broken"), "y.b": ("two", 1, 1, "TWO: broken"), "x.d": ("never", 0, 0, "LATER"), "x.e": blank, "x": blank, "x.": blank, None: blank}
    assert len(asked) == 1


def test_cells_are_counted_unsorted(spark):
    cells = spark.createDataFrame([("f", "p", t, str(t), e) for t in (0, 0, 3) for e in (None, "e")] + [("g", "p", None, " ", None)], "path string, provider string, table_ix int, text string, error string")
    df = providers.documents(cells)
    assert {tuple(r) for r in df.collect()} == {("f", "p", 2, 6, "e"), ("g", "p", 0, 0, None)}
    counted = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "partial_count(if" in x]
    assert counted and all("HashAggregate" in x for x in counted)

"""Providers of documents, exam files with quoted line breaks, the queue of prompts."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import prompts
from tallyloom.sources import providers, readers


def test_providers(spark):
    files = [("a.html", b"<table><tr><td>x</td></tr></table>"), ("b.docx", b"no zip"), ("c.PDF", b""), ("d.jpg", b""), ("e.xls", b""), ("f", b""), (None, b"x"), ("g.html", b"<p>nothing</p>"), ("h.mine", b"q")]
    df = spark.createDataFrame([(*f, "p") for f in files], "path string, content binary, provider string")
    own = providers.Providers(*providers.PROVIDERS.known.values(), providers.Provider("mine", ("mine",), lambda rows: rows.select("path", *[F.lit(0).alias(c) for c in ("table_ix", "row_ix", "cell_ix")], F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))))
    out = {r.path: (r.provider, r.tables, r.cells, r.warning) for r in providers.documents(own.cells(df)).collect()}
    assert out.pop("b.docx")[3].startswith("UNREADABLE: BadZipFile")
    assert out == {"a.html": ("page", 1, 1, None), "c.PDF": ("pdf", 0, 0, "NEEDS_TEXT_LAYER"), "d.jpg": ("image", 0, 0, "NEEDS_OCR"), "e.xls": ("old-sheet", 0, 0, "SAVE_AS_XLSX"), "f": (None, 0, 0, "NO_PROVIDER"), None: (None, 0, 0, "NO_PROVIDER"), "g.html": ("page", 0, 0, None), "h.mine": ("mine", 1, 1, None)}
    own.add(providers.Provider("pages", ("html",), warning="LATER"))
    assert {r.warning for r in providers.documents(own.cells(df)).where("path like '%.html'").collect()} == {"LATER"}


def test_exam_files(spark, tmp_path):
    head = "question_no,question_text,correct_answer,points\r\n"
    (tmp_path / "a.csv").write_bytes(("﻿" + head + '1,"Ne\nzaman, ""nerede""?",B,10\r\n\r\n2,?,A,x\r\n3,question_no,question_text,4\r\n').encode())
    (tmp_path / "b.csv").write_text("1,t,A,3\n" + head.replace("\r", "") + "2,t,A,3\n")
    (tmp_path / "c.csv").write_text("question_no,question_text,correct_answer,points,more\n1,t,A,3,z\n")
    (tmp_path / "d.csv").write_text('"question_no","question_text","correct_answer","points"\n5,t, A ,"3"\n6,t,A,nan\n7\n')
    got = {}
    for r in readers.exam_csv(spark, str(tmp_path)).orderBy("path", "row").collect():
        got.setdefault(r.path[-5:], []).append((r.row, r.number, r.text, r.answer_key, r.max_score if r.max_score == r.max_score else None, r.error))
    assert got["a.csv"] == [(2, 1, 'Ne\nzaman, "nerede"?', "B", 10.0, None), (3, 2, "?", "A", None, "points"), (4, 3, "question_no", "question_text", 4.0, None)]
    assert [x[-1] for x in got["b.csv"]] == ["header"] * 2 and [x[-1] for x in got["c.csv"]] == ["header"]
    assert [(x[0], x[1], x[3], x[-1]) for x in got["d.csv"]] == [(2, 5, "A", None), (3, 6, "A", "points"), (4, 7, None, "question_text")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_prompt_queue(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    rows = [(f"n{i:03}", "s", f"u{i}", i if i % 3 else None) for i in range(50)] + [("blank", "", "u", 5), ("long", "s", "x" * 8001, 5), ("n001", "s", "again", 2000)]
    df = spark.createDataFrame(rows, "name string, system string, user string, tokens int").repartition(5)
    queue = prompts.queued(df)
    calls = sorted((r.batch, r.place, r.name, r.user, r.batch_tokens) for r in queue.collect())
    fine = sorted((n, u) for n, _, u, _ in rows if n not in ("blank", "long"))
    assert [(b, p) for b, p, *_ in calls] == [(i // 16, i % 16) for i in range(51)] and [(n, u) for _, _, n, u, _ in calls] == fine
    assert [max(t for b, *_, t in calls if b == k) for k in range(4)] == [1024, 29, 46, 49]

    def model(pairs, tokens):
        if tokens == 29:
            raise RuntimeError("down")
        return [u + "!" for _, u in pairs][: 1 if tokens == 46 else None]

    answers = prompts.flushed(queue, model)
    got = {(r.name, r.batch): (r.answer, r.error) for r in answers.where("batch <> 0").collect()}
    for b, _, n, u, _ in calls:
        if b:
            assert got[n, b] == ((None, "RuntimeError: down") if b == 1 else (None, "ValueError: 1 answers for 16 prompts") if b == 2 else (u + "!", None))
    owners = spark.createDataFrame([("o", "n049"), ("o", "blank"), ("p", "n020")], "owner string, name string")
    assert sorted((r.owner, r.name, r.answer or "") for r in prompts.returned(owners, answers).collect()) == [("o", "blank", ""), ("o", "n049", "u49!"), ("p", "n020", "")]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert prompts.queued(df.where("false")).count() == 0

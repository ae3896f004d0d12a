"""Documents, programs, merges, prompts and the staged analysis."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import documents, measure, merge, programs, prompts, rules
from tallyloom.plans import flow


@pytest.fixture(scope="module")
def payloads(spark):
    ask = lambda n, m, **k: {"number": n, "maxScore": m, **k}
    good = {
        "exam": "e", "course": "Türk Dili ve Edebiyatı", "grade": "9. Sınıf", "component": "written", "correctedCells": {"0": "2", "3": "1", "x": "1"},
        "questions": [ask("2", "10", outcomeCode="TDE1.1", outcomeTheme="A"), ask("5", "10", outcomeCode="TDE1.1", outcomeTheme="A"), ask(None, "10", outcomes=[{"outcomeKey": "k1"}, {"outcomeKey": "k2"}, {"outcomeKey": ""}]), ask("9", "10")],
        "students": [{"studentRef": "Ö-001", "scores": [8, 6, 7, 5], "totalScore": 26}, {"studentRef": "Ö-002", "scores": [6, 6, 7, 9]}, {"studentRef": "Ö-003", "scores": [3, 9, 4, 10]}],
    }
    bad = {"exam": "b", "course": "Fizik", "grade": "9", "component": "performance", "questions": [ask("1", "0")], "students": [{"studentRef": "Ali", "scores": [1, 2], "totalScore": 9}]}
    lines = spark.createDataFrame([(json.dumps(x),) for x in (good, bad)], "j string")
    return lines.select(F.from_json("j", documents.PAYLOAD).alias("p")).select("p.*")


def test_analysis(payloads):
    tables, traces = flow.analysis(payloads)
    assert [t.state for t in traces] == ["done"] * 4
    assert {r.code for r in tables["issues"].where("exam = 'b'").collect()} == {"COMPONENT", "MAX_SCORE", "STUDENT_REF", "SCORE_COUNT", "SCORE_RANGE", "TOTAL_MISMATCH"}
    assert tables["issues"].where("exam = 'e'").count() == 0
    assert [(r.number, r.earned) for r in tables["question_results"].join(tables["questions"].select("question", "number"), "question").orderBy("question").collect()] == [(2, 17.0), (5, 21.0), (3, 18.0), (9, 24.0)]
    out = {r.outcome: (r.earned, r.possible) for r in tables["outcome_results"].collect()}
    assert out == {"A | TDE1.1": (38.0, 60.0), "k1": (9.0, 15.0), "k2": (9.0, 15.0), "Soru 9": (24.0, 30.0)}
    assert {r.outcome: r.corrected_cells for r in tables["evidence"].collect()} == {"A | TDE1.1": 2, "k1": 0, "k2": 0, "Soru 9": 1}
    assert tables["unknown_questions"].count() == tables["repeated_questions"].count() == 0


def test_a_failure_stops_only_what_needs_it():
    def fail(t):
        raise RuntimeError("no")

    done = flow.Stage("a", lambda t: {"x": 1})
    assert [t.state for t in flow.run([done, flow.Stage("b", fail, required=False), done], {})[1]] == ["done", "failed", "done"]
    assert [t.state for t in flow.run([flow.Stage("b", fail), done], {})[1]] == ["failed", "skipped"]


def test_programs(spark, payloads):
    exams = spark.createDataFrame([("e", "TÜRK DİLİ VE EDEBİYATI", "9. Sınıf"), ("f", " ingilizce", "9"), ("g", "Fizik", "9"), ("h", "türk dili ve edebiyatı", "9")], "exam string, course string, grade string")
    assert {r.exam: r.profile for r in programs.with_profile(exams).collect()} == {"e": "tde-70-15-15", "f": "language-50-25-25", "g": None, "h": "tde-70-15-15"}
    assert {r.exam: r.program for r in programs.with_program(exams).collect()}["h"] == "tde-9-tymm"
    links = spark.createDataFrame([("h", 0, "k", "TDE1.1"), ("h", 1, "k", "MAT1"), ("g", 0, "k", "tde2"), ("g", 1, "k", "FZ")], "exam string, question int, outcome string, code string")
    assert sorted(r.code for r in programs.foreign_codes(links, exams).collect()) == ["MAT1", "tde2"]
    skills = spark.createDataFrame([(["Konuşma"],), (["Okuma", "Yazma", ""],), (["Okuma", "Konuşma"],), ([],)], "s array<string>")
    assert [r[0] for r in skills.select(programs.component_of_skills(F.col("s"))).collect()] == ["speaking", "written", None, None]
    outcomes = spark.createDataFrame([("o1", "T1", "t", "A", "Okuma", [("T1.A", "x")]), ("o2", "T2", "u", "A", "Yazma", []), ("o3", "T3", "v", "A", "Konuşma", [])], "id string, code string, title string, theme string, skill string, processComponents array<struct<code: string, title: string>>")
    assert sorted((r.id, r.code, r.parent_code) for r in programs.catalog(outcomes, "written").collect()) == [("o1-t1-a", "T1.A", "T1"), ("o2", "T2", None)]


def test_keywords(spark):
    questions = spark.createDataFrame([(1, "Toplama işlemi"), (2, "harita ve iklim"), (3, None), (4, "pi sayısı")], "question_id int, text string")
    outcomes = spark.createDataFrame([("MAT", ["toplama", "Pi"]), ("SOS", ["harita", "iklim"]), ("GEN.1", [])], "outcome_id string, keywords array<string>")
    assert sorted(map(tuple, programs.keyword_links(questions, outcomes, "GEN.1").collect())) == [(1, "MAT"), (2, "SOS"), (3, "GEN.1"), (4, "MAT")]


def test_general_evaluation(spark):
    weights = {"written": 0.7, "listening": 0.15, "speaking": 0.15}
    rows = [("c", s, k, float(v)) for s, many in (("s1", (100, 80, 60)), ("s2", (50, 40, 100))) for k, v in zip(("written", "listening", "speaking"), many, strict=True)]
    rows += [("m", "s1", "written", 50.0), ("x", "s1", "written", 5.0), ("x", "s1", "listening", 5.0), ("x", "s2", "speaking", 5.0)]
    out = {r["class"]: (r.students, r.average, r.state) for r in merge.general(spark.createDataFrame(rows, "class string, student string, component string, total double"), weights).collect()}
    assert out == {"c": (2, 73.5, "complete"), "m": (0, None, "missing"), "x": (0, None, "mismatch")}
    same = ("S", "Türkçe", "9/A", "2024", "1")
    reports = [("c", k, *same) for k in merge.COMPONENTS] + [("d", "written", *same), ("d", "written", "T", "", *same[2:]), ("d", "other", *same)]
    found = merge.report_issues(spark.createDataFrame(reports, "class string, component string, school string, course string, class_section string, year string, term string")).collect()
    assert {(r["class"], r.code) for r in found} == {("d", c) for c in ("UNKNOWN_COMPONENT", "REPEATED_COMPONENT", "MISSING_COMPONENT", "NO_COURSE", "DIFFERENT_SCHOOL")}


def test_prompts(spark):
    outcomes = spark.createDataFrame([("a", 0.4, "p", "T"), ("b", 0.69, "p", ""), ("c", 0.9, "p", "T"), ("d", 0.1, None, "T")], "name string, rate double, program string, theme string")
    assert [(r.name, r.severity) for r in prompts.weak(outcomes).collect()] == [("a", "critical")]
    asked = spark.createDataFrame([(f"n{i}", "s", f"u{i}") for i in range(40)] + [("blank", "s", " "), ("long", "s", "x" * 8001)], "name string, system string, user string")
    assert {r.name: r.reason for r in prompts.rejected(asked).collect()} == {"blank": "empty", "long": "too long"}

    def model(batch):
        assert len(batch) <= 16
        return [f"{s}+{u}" for s, u in batch]

    out = {r.name: r.answer for r in prompts.answered(asked, model).collect()}
    assert len(out) == 40 and out["n7"] == "s+u7"
    owners = spark.createDataFrame([(n, 0.4, ["TDE1"], "written", "") for n in ("ok", "none", "nosource", "refused", "scope")], "name string, rate double, codes array<string>, component string, description string")
    answers = spark.createDataFrame([("ok", "Oran düşüktür. Telafi gerekir."), ("nosource", "x"), ("refused", "Bilgi yok. y"), ("scope", "etkinlik")], "name string, answer string")
    hits = spark.createDataFrame([("ok",), ("refused",), ("scope",)], "name string")
    got = {r.name: (r.reason, r.answer) for r in prompts.published(owners, answers, hits, "Bilgi yok.").collect()}
    assert got == {"ok": ("published", "Oran düşüktür."), "none": ("no result", ""), "nosource": ("no source", ""), "refused": ("refused", ""), "scope": ("scope", "")}
    rows = spark.createDataFrame([("e", q, 10.0, r, c) for q, r, c in ((1, 0.625, 0), (2, 0.5, 2), (3, 1.0, 0))] + [("f", 1, 1.0, 1.0, 0)], "exam string, question int, max_score double, rate double, cells int")
    assert [(r.exam, r.prompt.split("\n")[:2]) for r in prompts.anomaly_prompt(rows).collect()] == [("e", ["- Soru 1: azami 10.0 puan, başarı oranı %62", "- Soru 2: azami 10.0 puan, başarı oranı %50, düzeltme: 2"])]


def test_completeness(spark):
    exams = spark.createDataFrame([("S", "T", "Türkçe", "null")], "schoolName string, teacher string, course string, term string")
    assert documents.missing_fields(exams).first().missing == ["class", "date", "district", "program", "province", "sequence", "term", "year"]
    pairs = spark.createDataFrame([("Türkçe", "TURKCE dersi"), ("Fizik", "Kimya"), ("", "Kimya")], "a string, b string")
    assert [r[0] for r in pairs.select(documents.conflict(F.col("a"), F.col("b"))).collect()] == [False, True, False]
    fields = spark.createDataFrame([("", None, "D", "x"), ("T", "teacher", "D", "x"), ("", None, "", "x")], "now string, source string, found string, std string")
    value, source = documents.filled(F.col("now"), F.col("source"), F.col("found"), F.col("std"))
    assert [tuple(r) for r in fields.select(value, source).collect()] == [("D", "document"), ("T", "teacher"), ("x", "context")]
    asked = spark.createDataFrame([("e", 1, "t", 5.0, "A"), ("e", 2, " ", None, None)], "exam string, question int, text string, max_score double, answer_key string")
    row = documents.structuring(asked).first()
    assert (row.total, row.blank_texts, row.codes) == (5.0, 1, ["MISSING_SCORE", "MISSING_ANSWER_KEY"])


def test_materialised_stages(spark, tmp_path):
    made = []

    def stage(name, fail=False, needs=(), required=True):
        def work(t):
            made.append(name)
            rows = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
            return {name: rows.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("row 3"))).otherwise(F.col("v"))) if fail else rows}

        return flow.Stage(name, work, required, needs, f"the {name}", lambda t: {"odd": t[name].where("v = 4"), "none": t[name].where("v = 5")})

    stages = [stage("a"), stage("b", fail=True, required=False), stage("c", needs=("a", "b")), stage("d", needs=("a",)), stage("e", fail=True), stage("f")]
    tables, traces = flow.materialised(spark, stages, {}, f"{tmp_path}/x")
    assert [t.state for t in traces] == ["done", "failed", "skipped", "done", "failed", "skipped"]
    assert "row 3" in traces[1].error and traces[2].error == "needs b" and sorted(tables) == ["a", "d"]
    assert traces[0].rows == {"a": 5} and traces[0].issues == {"odd": 1} and traces[0].seconds > 0 and tables["d"].count() == 5
    wire = traces[0].wire()
    assert (wire["label"], wire["outputs"], wire["failed"], wire["skipped"]) == ("the a", {"a": 5}, False, False) and wire["durationMs"] == round(traces[0].seconds * 1000, 1)
    assert flow.total_seconds(traces, 0) == sum(t.seconds for t in traces) and flow.total_seconds(traces, 1e6) == 1e6
    # the same folder again: finished stages are kept, others are tried again
    assert made == ["a", "b", "d", "e"]
    tables, again = flow.materialised(spark, [stages[0], stage("b", needs=("a",)), *stages[2:4]], {}, f"{tmp_path}/x")
    assert [t.state for t in again] == ["kept", "done", "done", "kept"] and made[4:] == ["b", "c"] and again[0].seconds == traces[0].seconds
    assert sorted(tables) == ["a", "b", "c", "d"] and tables["a"].count() == 5


def test_materialised_analysis(spark, payloads, tmp_path):
    tables, traces = flow.materialised(spark, flow.MATERIALISED, {"payloads": payloads}, f"{tmp_path}/y")
    assert [t.state for t in traces] == ["done"] * 3 and traces[1].rows == {"question_results": 4, "links": 5} and not any(t.issues for t in traces)
    assert {r.outcome: r.earned for r in tables["outcome_results"].collect()} == {"A | TDE1.1": 38.0, "k1": 9.0, "k2": 9.0, "Soru 9": 24.0}


def test_a_stage_makes_its_tables_from_those_it_wrote(spark, payloads, tmp_path):
    times = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        times.add(1)
        return x

    stage = flow.Stage("s", lambda t: {"a": spark.range(5).select(seen("id").alias("id")), "b": lambda t: t["a"].where("id > 1"), "c": lambda t: t["b"].where("id > 2")})
    tables, traces = flow.materialised(spark, [stage], {}, f"{tmp_path}/z")
    assert traces[0].rows == {"a": 5, "b": 3, "c": 2} and times.value == 5  # each row was made once, not for each table
    assert {n: t.count() for n, t in flow.run([stage], {})[0].items()} == {"a": 5, "b": 3, "c": 2}


def test_evidence_has_the_totals(spark):
    questions = spark.createDataFrame([("e", q, e, p) for q, e, p in ((1, 0.1, 3.0), (2, 0.2, None), (3, 7.0, 9.0))] + [("f", 1, None, None)], "exam string, question int, earned double, possible double")
    links = spark.createDataFrame([("e", 1, "A", 1 / 3), ("e", 1, "A", 1 / 3), ("e", 2, "A", 1.0), ("e", 3, "B", 0.5), ("e", 9, "C", 1.0), ("f", 1, "A", 1.0)], "exam string, question int, outcome string, weight double")
    want, got = measure.outcome_totals(questions, links), measure.evidence_totals(measure.evidence(questions, links))
    assert want.schema.simpleString() == got.schema.simpleString() and sorted(map(str, want.collect())) == sorted(map(str, got.collect())) and got.count() == 3


def test_scored_questions_and_repeats(spark):
    rows = spark.createDataFrame([("e", [1.0, None]), ("e", [1.0, 2.0, None]), ("f", []), ("g", None), (None, [2.0])], "exam string, scores array<double>").selectExpr("exam", "1 as student", "scores")
    want = documents.scores(rows).select("exam", "question").distinct()
    assert sorted(map(str, documents.scored(rows).collect())) == sorted(map(str, want.collect()))
    keys = spark.createDataFrame([("e", 1), ("e", 1), ("e", 1), ("e", 2), (None, 1), (None, 1)], "exam string, question int")
    again = rules.repeats(keys, ["exam", "question"], ["question"])
    assert "Window" not in again._jdf.queryExecution().toString() and sorted(map(str, map(tuple, again.collect()))) == ["('e', 1)", "('e', 1)", "(None, 1)"]


def test_reports_are_not_copied_for_each_column(spark):
    rows = spark.createDataFrame([("c", "written", "S", "s ", "", None, "1"), ("c", "written", "T", "S", "", "x", "1"), ("d", None, "", "a", "a", "a", "a")], "class string, component string, school string, course string, class_section string, year string, term string")
    found = merge.report_issues(rows)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {("c", x) for x in ("REPEATED_COMPONENT", "MISSING_COMPONENT", "NO_CLASS_SECTION", "NO_YEAR", "DIFFERENT_SCHOOL")} | {("d", x) for x in ("UNKNOWN_COMPONENT", "MISSING_COMPONENT", "NO_SCHOOL")}
    assert {tuple(r) for r in found.collect()} == want

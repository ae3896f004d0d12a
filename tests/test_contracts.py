"""Contracts of JSON documents, gates of requests, packages of backups, reports' heads and what structuring misses."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import json_text
from tallyloom.operators import backups, documents, measure, programs
from tallyloom.sources.contracts import CONTRACTS, Contracts, is_kind


def good():
    return {
        "metadata": {"ced_version": "1", "created_at": "x", "source": "s"}, "assessment": {"id": "a", "title": "t", "course": "c", "grade": None, "total_score": 3, "question_count": 2},
        "questions": [{"id": "q1", "number": 1, "max_score": 2.5}, {"id": "q2", "number": 2, "text": None, "learning_outcome_ids": []}],
        "student_results": [{"student_no": "1", "full_name": "", "question_scores": [{"question_id": "q1", "score": None}]}], "validation": {"valid": True, "issues": [{"code": "c", "message": "m"}]},
    }


def changed(**edits):
    doc = good()
    for path, value in edits.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        at = doc
        for p in way:
            at = at[p]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(doc)


CASES = {
    "good": (json.dumps(good()), []), "text": ("not json", [("root", "NO_OBJECT")]), "list": ("[1]", [("root", "NO_OBJECT")]), "null": (None, [("root", "NO_OBJECT")]),
    "sections": (changed(metadata=..., extra=1, questions=3), [("extra", "UNKNOWN"), ("metadata", "MISSING")]),
    "lists": (changed(questions={}, student_results=[3]), [("questions", "NOT_LIST"), ("student_results[0]", "NOT_OBJECT")]),
    "fields": (changed(metadata__source=..., metadata__z=1, assessment__id=7, assessment__grade=4, assessment__question_count=2.5), [("assessment.grade", "KIND"), ("assessment.id", "KIND"), ("assessment.question_count", "KIND"), ("metadata.source", "MISSING"), ("metadata.z", "UNKNOWN")]),
    "items": (changed(questions__1__number="2", questions__0__max_score=True, questions__0__id=None), [("questions[0].id", "KIND"), ("questions[0].max_score", "KIND"), ("questions[1].number", "KIND")]),
    "nested": (changed(student_results__0__question_scores=[{"question_id": "q"}, {"score": "x"}], validation__issues=5, validation__valid=None), [("student_results[0].question_scores[1].question_id", "MISSING"), ("student_results[0].question_scores[1].score", "KIND"), ("validation.issues", "NOT_LIST"), ("validation.valid", "KIND")]),
}


def test_contracts(spark):
    df = spark.createDataFrame([(k, v[0], "p") for k, v in CASES.items()], "k string, j string, path string")
    got = {k: [] for k in CASES}
    for r in CONTRACTS.check(df, ["k"], "j", "exam").collect():
        got[r.k].append((r.path, r.code))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in CASES.items()}
    loose = spark.createDataFrame([(json.dumps({"learning_outcomes": [{"id": "a", "x": 1}, {"id": ""}, {"id": "b", "keywords": "k"}, 4], "y": 1}),), ('{"learning_outcomes": 1}',)], "j string")
    assert sorted((r.path, r.code) for r in CONTRACTS.check(loose, [], "j", "outcomes").collect()) == [("learning_outcomes", "NOT_LIST"), ("learning_outcomes[1].id", "KIND"), ("learning_outcomes[2].keywords", "KIND"), ("learning_outcomes[3]", "NOT_OBJECT")]
    assert [tuple(r) for r in Contracts().check(df.limit(1), ["k"], "j", "none").collect()] == [("good", "none", "NO_CONTRACT")]
    assert CONTRACTS.names() == ["exam", "outcomes", "answers"] and CONTRACTS.get("x") is None


def test_contracts_take_an_object_apart_once(spark):
    rows = spark.createDataFrame([(1, json.dumps(good()))], "k int, j string")
    plan = CONTRACTS.check(rows, ["k"], "j", "exam")._jdf.queryExecution().analyzed().toString()
    assert "to_json" not in plan and plan.count("try_variant_get") <= 12  # one for each object or list, none for each field


def test_each_spelling_of_a_course_is_folded_once(spark):
    names = ["Türkçe", " TÜRKÇE", "TüRK Dili  ve edebiyatı", "Fizik", "", None]
    exams = spark.range(60).select("id", F.get(F.array(*map(F.lit, names)), (F.col("id") % 6).cast("int")).alias("course"), F.lit("9. Sınıf").alias("grade"))
    both = programs.with_program(programs.with_profile(exams))
    assert both.columns == ["id", "course", "grade", "profile", "weights", "program", "outcome_prefix"]
    got = {(r.course, r.profile, r.program) for r in both.collect()}
    assert got == {(names[0], "language-50-25-25", None), (names[1], "language-50-25-25", None), (names[2], "tde-70-15-15", "tde-9-tymm"), ("Fizik", None, None), ("", None, None), (None, None, None)} and both.count() == 60
    plan = programs.with_profile(exams)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    python, distinct = [i for i, line in enumerate(plan) if "EvalPython" in line], next(i for i, line in enumerate(plan) if "Aggregate [course" in line)
    assert python and max(python) < distinct and "RDD" not in "".join(plan)  # Python gets distinct courses only, and the dimension none


def test_kinds(spark):
    values = {"{}": "object", "[]": "list", '"x"': "string", "1": "integer", "1.5": "number", "1e3": "number", "true": "boolean", "null": "null"}
    df = spark.createDataFrame([(v,) for v in values], "j string").withColumn("v", F.parse_json("j"))
    for kind in ("object", "list", "string", "integer", "number", "boolean", "null"):
        got = {r.j: r.f for r in df.select("j", is_kind(F.col("v"), kind).alias("f")).collect()}
        assert got == {j: k == kind or (kind, k) == ("number", "integer") for j, k in values.items()}, kind
        maybe = {r.j: r.f for r in df.select("j", is_kind(F.col("v"), kind + "?").alias("f")).collect()}
        assert maybe == {j: f or j == "null" for j, f in got.items()}


def test_key_paths_and_empty_texts(spark):
    deep = "[" * 500 + '{"fullName" : 1}' + "]" * 500
    texts = ['{"a": [{"fullName" : "x", "b": {"student": {"fullName": 1}}}], "fullName": null}', '{"a": "fullName"}', "x", None, deep]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(json_text.key_paths(["fullName", "student"], "w")("t")).collect()]
    assert got[:4] == [["w.a.0.fullName", "w.a.0.b.student", "w.fullName"], [], [], []] and len(got[4]) == 1
    clean = spark.createDataFrame([('{"a": "", "b": [" ", "", {"c": ""}], "d": 0}',), ("x",), (None,)], "t string").select(json_text.without_empty("t")).collect()
    assert [r[0] for r in clean] == ['{"a":null,"b":[" ",null,{"c":null}],"d":0}', None, None]


def plain_digest(value):
    h = 0x811C9DC5
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_packages(spark, tmp_path):
    spaces = spark.createDataFrame([("a", '{"decisions":[1,"ç𝐀"]}'), ("b", '{"x":{"y":[{"fullName":"n"}]}}'), ("c", "[]"), ("d", "{}"), ("e", None)], "record_id string, workspace string")
    now = backups.packages(spaces, F.lit("2024"))
    found = {r.record_id: r for r in backups.saved(now, f"{tmp_path}/s").collect()}
    assert {k: r.status for k, r in found.items()} == {"a": "ok", "b": "private", "c": "unreadable", "d": "ok", "e": "unreadable"} and found["b"].detail == "workspace.x.y.0.fullName"
    whole = json.loads(found["a"].package)
    assert whole["workspace"]["decisions"] == [1, "ç𝐀"] and set(backups.KEYS) <= set(whole["workspace"])
    assert whole.pop("integrity")["digest"] == plain_digest(whole)

    def edited(**edits):
        doc = json.loads(found["a"].package)
        for path, value in edits.items():
            *way, last = path.split("__")
            at = doc
            for p in way:
                at = at[p]
            if value is ...:
                del at[last]
            else:
                at[last] = value
        if "integrity" in doc and isinstance(doc["integrity"], dict) and "integrity__digest" not in edits:
            doc["integrity"]["digest"] = plain_digest({k: v for k, v in doc.items() if k != "integrity"})
        return json.dumps(doc)

    cases = {
        "foreign": edited(format="x"), "unversioned": edited(schemaVersion="2"), "newer": edited(schemaVersion=3), "unsupported": edited(schemaVersion=0), "unsealed": edited(integrity=...), "broken": edited(integrity__digest="00000000"),
        "no-workspace": edited(workspace=[]), "mismatch": edited(workspace__schemaVersion=1), "incomplete": edited(workspace__approvals=...), "private": edited(workspace__timestamps={"z": [{"rawFile": 1}]}), "old": edited(schemaVersion=1, workspace__schemaVersion=1), "ok": edited(),
    }
    df = spark.createDataFrame(list(cases.items()), "record_id string, package string")
    assert {r.record_id: r.status for r in backups.opened(df).collect()} == {k: k for k in cases}
    up = {r.record_id: r for r in backups.brought_up(df, F.lit("2025")).collect()}
    assert {k for k, r in up.items() if r.package} == {"old", "ok"} and up["ok"].package == cases["ok"]
    new = json.loads(up["old"].package)
    assert new["workspace"]["migration"] == {"sourceVersion": 1, "targetVersion": 2, "convertedAt": "2025"} and new["schemaVersion"] == new["workspace"]["schemaVersion"] == 2 and new["createdAt"] == "2024"
    again = spark.createDataFrame([("x", up["old"].package)], "record_id string, package string")
    assert backups.opened(again).first().status == "ok"


def test_records_of_odd_workspaces(spark):
    rows = backups.sealed(spark.createDataFrame([("a", 1, "{}"), ("b", 1, '{"questionApprovals":[7]}'), ("c", 2, '{"x": [{"fullName" : "n"}]}'), ("d", 2, "[]"), ("e", 2, None)], "record_id string, version int, workspace string"))
    assert {r.record_id: r.status for r in backups.inspected(rows, ["fullName"]).collect()} == {"a": "old", "b": "old", "c": "private", "d": "unreadable", "e": "broken"}
    out = {r.record_id: r for r in backups.migrated(rows, ["fullName"]).collect()}
    assert {k: r.workspace for k, r in out.items()} == {"a": '{"questionApprovals":[]}', "b": '{"questionApprovals":[7]}'}
    assert all(r.status == "ok" for r in backups.inspected(backups.migrated(rows, ["fullName"]), ["fullName"]).collect())


@pytest.mark.parametrize("row, code", [
    (("Fizik", "oral", "", 1, 1, 0), "COMPONENT"), (("Fizik", " ", None, 1, 1, 0), None), (("Fizik", "written", "x", 1, 1, 0), "UNKNOWN_PROFILE"), (("Fizik", "written", "tde-70-15-15", 1, 1, 0), "FOREIGN_PROFILE"),
    (("TÜRKÇE", "speaking", "tde-70-15-15", 1, 1, 0), "FOREIGN_PROFILE"), (("Fizik", "speaking", "", 1, 1, 0), "NEEDS_LANGUAGE_COURSE"), (("Fizik", "general", "", 0, 0, 3), "NEEDS_LANGUAGE_COURSE"), (("Türkçe", "general", "", 0, 0, 0), "NO_COMPONENT_ANALYSES"),
    (("Türkçe", "general", "", 0, 0, 3), None), (("Türkçe", "speaking", "language-50-25-25", 0, 1, 0), "NO_QUESTIONS"), (("türk dili  ve edebiyatı", "listening", "tde-70-15-15", 2, 0, 0), "NO_STUDENTS"), ((None, "written", None, 1, 1, None), None),
])
def test_request_gates(spark, row, code):
    df = spark.createDataFrame([("e", *row)], "exam string, course string, component string, profile string, questions int, students int, component_analyses int")
    assert [r.code for r in programs.request_issues(df).collect()] == ([code] if code else [])


def test_structured_and_mapping(spark):
    docs = spark.createDataFrame([("a", 0.9, 0, ["w"]), ("b", None, 1, None), ("c", float("nan"), 0, [])], "exam string, confidence double, broken_tables int, warnings array<string>")
    asked = spark.createDataFrame([("a", 1, "t", 5.0, "A"), ("a", 2, " ", 2.5, "B"), ("b", 1, "t", None, None)], "exam string, question int, text string, max_score double, answer_key string")
    there = spark.createDataFrame([("a", "7"), ("a", " 7 "), ("a", "5"), ("a", "5"), ("a", ""), ("a", None), ("c", "1")], "exam string, student_no string")
    out = {r.exam: r for r in documents.structured(docs, asked, there).collect()}
    assert (out["a"].codes, out["a"].repeated, out["a"].students, out["a"].total, out["a"].blank_texts, out["a"].warnings) == ([], ["5", "7"], 6, 7.5, 1, ["w"])
    assert out["b"].codes == ["MISSING_SCORE", "MISSING_ANSWER_KEY", "MISSING_STUDENT", "BROKEN_TABLE", "LOW_CONFIDENCE"] and out["b"].warnings == out["b"].codes
    assert out["c"].codes == ["MISSING_QUESTION", "LOW_CONFIDENCE"] and out["c"].has_answer_key
    links = spark.createDataFrame([("a", 0, "k", "C"), ("a", 0, "l", ""), ("a", 1, "k", ""), ("a", 2, "m", "")], "exam string, question int, outcome string, code string")
    assert [tuple(r) for r in documents.mapping(links).select("exam", "questions", "unmapped", "outcomes").collect()] == [("a", 3, 2, 3)]


def test_reports_and_given_averages(spark):
    exams = spark.createDataFrame([("a", "written", "p"), ("b", "written", None), ("c", "other", "p")], "exam string, component string, profile string")
    asked = spark.createDataFrame([("a", 30.0), ("a", 70.0), ("b", 0.0)], "exam string, max_score double")
    there = spark.createDataFrame([("a", 50.0), ("a", 60.0), ("a", 60.0), ("b", 1.0)], "exam string, total double")
    profiles = spark.createDataFrame([("p", {"written": 0.7}), ("p", {"written": 0.7})], "profile string, weights map<string, double>")
    out = {r.exam: r for r in measure.reports(exams, asked, there, profiles).collect()}
    assert (out["a"].component_weight, out["a"].question_count, out["a"].student_count, out["a"].exam_max, out["a"].class_average) == (0.7, 2, 3, 100.0, 56.67)
    assert out["a"].rate == pytest.approx(170 / 300) and (out["b"].component_weight, out["b"].rate) == (None, 0.0) and (out["c"].component_weight, out["c"].class_average, out["c"].rate, out["c"].student_count) == (None, None, None, 0)
    rows = spark.createDataFrame([("x", "s1", "written", 40.0), ("x", "s2", "written", 60.0), ("x", "s1", "speaking", 10.0)], "class string, student string, component string, total double")
    given = spark.createDataFrame([("x", "speaking", 80.0), ("x", "written", None), ("x", "listening", 70.0)], "class string, component string, average double")
    got = {r.component: (r.average, r.students, r.contribution) for r in measure.component_results(rows, {"written": 0.5, "speaking": 0.25, "listening": 0.25}, given).collect()}
    assert got == {"written": (50.0, 2, 25.0), "speaking": (80.0, 1, 20.0), "listening": (70.0, 0, 17.5)}


def test_packages_pass_through_python_once(spark):
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    spaces = spark.createDataFrame([(1, '{"b": {"z": 1.0, "a": "ü"}, "migration": 3, "schemaVersion": 7}'), (2, "[]"), (3, None)], "record_id int, workspace string")
    made = backups.packages(backups.dealt(spaces), F.lit("2024"), version=1)
    assert passes(made) == 1 and passes(backups.opened(made)) <= 2
    old = {r.record_id: r.package for r in made.collect()}
    assert old[2] is None and old[3] is None and json.loads(old[1])["workspace"]["schemaVersion"] == 1
    body = {k: v for k, v in json.loads(old[1]).items() if k != "integrity"}
    assert json.loads(old[1])["integrity"] == {"algorithm": backups.ALGORITHM, "digest": json_text.fnv1a([json_text._plain(body)])[0]}
    up = backups.brought_up(made, F.lit("2025"))
    new = next(r.package for r in up.collect() if r.record_id == 1)
    assert json.loads(new)["workspace"]["migration"] == {"sourceVersion": 1, "targetVersion": 2, "convertedAt": "2025"} and new.count("migration") == 1
    assert passes(up.where("status = 'old'")) == 1 and backups.opened(up.where("record_id = 1")).first().status == "ok"

"""Rosters at their edges: empty tables, blanks, nulls, more rows than expected, numbers over 999."""

from pyspark.sql import functions as F

from tallyloom.operators import rosters


def test_numbers_go_on_over_groups_and_grow(spark):
    rows = spark.range(1002).select(F.lit("e").alias("exam"), (F.col("id") >= 1000).cast("int").alias("group"), F.col("id").alias("position"))
    got = {r.position: (r.row_number, r.technical_id) for r in rosters.numbered(rows).collect()}
    assert got[0] == (1, "Ö-001") and got[999] == (1000, "Ö-1000") and got[1001] == (2, "Ö-1002")


def test_padding(spark):
    rows = spark.createDataFrame([("a", 1, "7"), ("a", 2, "8"), ("b", 1, "9")], "exam string, row_number int, student_no string")
    expected = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1), ("d", None)], "exam string, expected int")
    got = sorted(map(tuple, rosters.padded(rows, expected).collect()))
    assert got == [("a", 1, "7"), ("a", 2, "8"), ("b", 1, "9"), ("b", 2, ""), ("b", 3, ""), ("c", 1, "")]
    assert rosters.padded(rows.where("false"), expected.where("false")).count() == 0


def test_student_issues(spark):
    schema = "exam string, position int, student_no string"
    rows = spark.createDataFrame([("a", 1, "7"), ("a", 2, " 7 "), ("a", 3, None), ("a", 4, "undefined"), ("b", 1, "7")], schema)
    saved = spark.createDataFrame([("a", "7"), ("a", "7"), ("b", None)], "exam string, student_no string")
    got = sorted(map(tuple, rosters.student_issues(rows, saved).collect()))
    assert got == [("a", 1, "SAVED_BEFORE"), ("a", 2, "REPEATED"), ("a", 2, "SAVED_BEFORE"), ("a", 3, "NO_STUDENT_NUMBER"), ("a", 4, "NO_STUDENT_NUMBER")]


def test_status_at_nulls(spark):
    rows = spark.createDataFrame([(0, 1, None), (2, 1, 0), (1, 1, 5)], "saved int, current int, expected int")
    status, off = rosters.count_status(F.col("saved"), F.col("current"), F.col("expected"))
    assert [tuple(r) for r in rows.select(status, off).collect()] == [("equal", 0), ("over", 2), ("under", 3)]


def test_deleting_programs(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "n int, program string")
    assert sorted(r.n for r in rosters.without_program(rows, "p").collect()) == [2, 3]
    assert rosters.without_program(rows).count() == 0


def test_shapes_warnings_and_models(spark):
    texts = spark.createDataFrame([(' {"b": 1, "a": 2}',), ("[]",), (" x ",), (None,)], "t string")
    kind, content = rosters.shape(F.col("t"))
    assert [tuple(r) for r in texts.select(kind, content).collect()] == [("object", "b,a"), ("array", "0"), ("value", "x"), ("value", None)]
    warnings = spark.createDataFrame([("f",), ("g",), ("h",)], "source string")
    rows = spark.createDataFrame([("f", ["1", "2"]), ("g", ["1", " "]), ("g", ["1", "2"])], "source string, cells array<string>")
    assert {r.source: r.resolved for r in rosters.resolved(warnings, rows).collect()} == {"f": True, "g": False, "h": False}
    asked = spark.createDataFrame([("e", 1, 10.0, "A"), ("e", 2, None, "")], "exam string, question int, max_score double, answer_key string")
    assert tuple(rosters.scoring_model(asked).first()) == ("e", 10.0, {1: 10.0, 2: None}, False)


def test_ranges_are_not_joined_by_sorting(spark):
    from tallyloom.operators import ordered, rosters

    rows = spark.createDataFrame([(e, "g", p) for e in ("a", None) for p in range(40)] + [(f"x{i}", "g", 1) for i in range(30)], "exam string, group string, position int")
    out = ordered.running(rows, ["exam", "group"], ["position"], F.lit(1), "n")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.exam), r.position, r.n) for r in out.collect()) == sorted([(e, p, p + 1) for e in ("a", "None") for p in range(40)] + [(f"x{i}", 1, 1) for i in range(30)])
    assert rosters.row_numbers(rows).columns == ["exam", "group", "position", "row_number"]

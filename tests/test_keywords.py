"""Links of questions to outcomes by keywords."""

import pytest

from tallyloom.operators import programs


@pytest.mark.parametrize("most", [10_000, 1])
def test_links_without_a_join_of_results(spark, monkeypatch, most):
    monkeypatch.setattr(programs, "KEYWORDS", most)
    questions = spark.createDataFrame([(1, "Red steel"), (2, None), (3, "ab"), (3, "zz"), (4, "zz"), (4, "qq"), (5, "ELEMENT")], "question_id int, text string")
    outcomes = spark.createDataFrame([("a", ["STEEL", "red"]), ("b", ["ab", ""]), ("c", ["e"])], "outcome_id string, keywords array<string>")
    links = programs.keyword_links(questions, outcomes, "none")
    assert sorted(map(tuple, links.collect())) == [(1, "a"), (1, "c"), (2, "none"), (3, "b"), (4, "none"), (5, "c")]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == 1

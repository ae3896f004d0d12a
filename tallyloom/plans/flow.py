"""The analysis of exams as stages over one set of tables, with a trace of each stage."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.operators import corrections, documents, measure, rules

Tables = dict[str, DataFrame]
#: Tables that a stage adds, in the order in which they are made; one that is given as a function takes the tables so far, those before it in its stage included.
Added = dict[str, DataFrame | Callable[[Tables], DataFrame]]


@dataclass(frozen=True)
class Stage:
    """run takes the tables so far and returns those it adds; if a required stage fails the rest is skipped.

    needs: tables that must be there, which an optional stage before may have failed to add; then this one is skipped. checks: of the tables so far,
    rows that tell what is wrong at the stage's boundary, counted by name.
    """

    name: str
    run: Callable[[Tables], Added]
    required: bool = True
    needs: tuple[str, ...] = ()
    label: str = ""
    checks: Callable[[Tables], Tables] | None = None


@dataclass
class Trace:
    name: str
    state: str = "skipped"
    seconds: float = 0.0
    adds: list[str] = field(default_factory=list)
    error: str = ""
    label: str = ""
    #: rows of each table that the stage added, and of each check that found any
    rows: dict[str, int] = field(default_factory=dict)
    issues: dict[str, int] = field(default_factory=dict)

    def wire(self) -> dict:
        """The trace for a page: counts only, times in milliseconds to one place."""
        return {"agent": self.name, "label": self.label or self.name, "durationMs": round(self.seconds * 1000, 1), "outputs": self.rows, "issues": self.issues, "failed": self.state == "failed", "skipped": self.state == "skipped"}


def total_seconds(traces: list[Trace], wall: float) -> float:
    """Time of a whole run: that on the clock, but no less than its stages took."""
    return max(wall, sum(t.seconds for t in traces))


def run(stages: list[Stage], tables: Tables) -> tuple[Tables, list[Trace]]:
    """Tables after all stages and their traces. Plans are lazy: a stage fails here for what its plan is, not for its rows."""
    traces, stop = [], False
    for stage in stages:
        trace = Trace(stage.name)
        traces.append(trace)
        if stop:
            continue
        began = time.perf_counter()
        try:
            made = dict(tables)
            for name, df in (added := stage.run(tables)).items():
                made[name] = df(made) if callable(df) else df
            tables, trace.state, trace.adds = made, "done", sorted(added)
        except Exception as error:  # told in the trace; only a required stage stops the others
            trace.state, trace.error = "failed", f"{type(error).__name__}: {error}"[:300]
            stop = stage.required
        trace.seconds = time.perf_counter() - began
    return tables, traces


def _written(df: DataFrame, path: str) -> int:
    """Writes df and tells how many rows it has, which are counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def materialised(spark: SparkSession, stages: list[Stage], tables: Tables, folder: str) -> tuple[Tables, list[Trace]]:
    """run() with each stage's tables written below folder before the next stage begins, so that a stage fails for its rows, too, and its time is that of its work.

    A stage that fails stops all after it if it is required, else only those that need what it would have added; these are skipped. Its trace tells
    why. A finished stage's trace is written last, as its mark: a run that is started again with the same folder reads finished stages' tables instead
    of making them, and tells the times and rows of the first run.
    """
    traces, stop = [], False
    for stage in stages:
        at, trace = f"{folder}/{stage.name}", Trace(stage.name, label=stage.label)
        traces.append(trace)
        if missing := [n for n in stage.needs if n not in tables]:
            trace.error = f"needs {', '.join(missing)}"
        if stop or missing:
            continue
        if staging.committed(spark, f"{at}/_trace"):
            trace.__dict__ |= json.loads(spark.read.text(f"{at}/_trace").first()[0]) | {"state": "kept"}
            tables = tables | {name: spark.read.parquet(f"{at}/{name}") for name in trace.adds}
            continue
        began = time.perf_counter()
        try:
            made = dict(tables)
            for name, df in (added := stage.run(tables)).items():
                df = df(made) if callable(df) else df
                trace.rows[name] = _written(df, f"{at}/{name}")
                made[name] = spark.read.schema(df.schema).parquet(f"{at}/{name}")  # what a later table of the stage is made from
            trace.issues = {name: many for name, df in (stage.checks(made) if stage.checks else {}).items() if (many := df.count())}
            trace.state, trace.adds, trace.seconds = "done", sorted(added), time.perf_counter() - began
            spark.createDataFrame([(json.dumps(asdict(trace)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/_trace")
            tables = made
        except Exception as error:  # told in the trace; what needs this stage is skipped
            trace.state, trace.error, trace.rows = "failed", f"{type(error).__name__}: {error}"[:300], {}
            stop, trace.seconds = stage.required, time.perf_counter() - began
    return tables, traces


def _good(t: Tables) -> DataFrame:
    return t["payloads"].join(t["issues"].where("severity = 'error'").select("exam").distinct(), "exam", "left_anti")


def _read(t: Tables) -> Added:
    return {"issues": documents.payload_issues(t["payloads"]), "good": _good, "questions": lambda t: documents.questions(t["good"]), "students": lambda t: documents.students(t["good"])}


def _measure(t: Tables) -> Tables:
    totals = measure.question_totals(documents.scores(t["students"]), t["questions"], t["students"])
    return {"question_results": totals, "links": documents.links(t["questions"])}


def _outcomes(t: Tables) -> Added:
    counts = t["good"].where("correctedCells is not null").select("exam", corrections.clean_counts(t["good"]["correctedCells"]).alias("cells"))
    cells = corrections.merged(counts)
    return {"evidence": measure.evidence(t["question_results"], t["links"], cells), "outcome_results": lambda t: measure.evidence_totals(t["evidence"])}


def _boundaries(t: Tables) -> Tables:
    keys = t["questions"].select("exam", "question")
    return {"repeated_questions": rules.repeats(keys, ["exam", "question"], ["question"]), "unknown_questions": rules.unknown(t["links"], keys, ["exam", "question"])}


ANALYSIS = [Stage("documents", _read), Stage("measurement", _measure), Stage("outcomes", _outcomes), Stage("boundaries", _boundaries, required=False)]


def _boundary(t: Tables) -> Tables:
    keys = t["questions"].select("exam", "question")
    return {"repeated-question": rules.repeats(keys, ["exam", "question"], ["question"]), "unknown-question": rules.unknown(documents.scored(t["students"]), keys, ["exam", "question"])}


#: The analysis for materialised(): later stages name what they need, and each boundary is checked.
MATERIALISED = [Stage("documents", _read, checks=_boundary), Stage("measurement", _measure, needs=("students", "questions")), Stage("outcomes", _outcomes, needs=("question_results", "links"))]


def analysis(payloads: DataFrame) -> tuple[Tables, list[Trace]]:
    """All result tables for payloads(exam, course, grade, component, questions, students, correctedCells); see documents.PAYLOAD."""
    return run(ANALYSIS, {"payloads": payloads})

"""Queries of logs, of what edits make stale, and of staged analyses, over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.operators import documents, ordered
from tallyloom.plans import flow
from tallyloom.plans.registry import Registry, table
from tallyloom.streaming import audit, stale

query = Registry()


@query("with n as (select *, row_number() over (partition by user_id, event_type order by event_id) - 1 as k from events where event_type <> 'error'), p as (select user_id || '-' || event_type || '-' || (k // 2) as entry, event_type as agent, max(epoch_us(ts)) filter (k % 2 = 0) as s, max(epoch_us(ts)) filter (k % 2 = 1) as f, max(value) filter (k % 2 = 1) as v from n group by user_id, event_type, k // 2) select entry, agent, s as started_us, f as finished_us, case when f is not null then greatest(0, (f // 1000) - (s // 1000)) end as duration_ms, case when f is null then 'started' when v >= 3 then 'completed' else 'failed' end as status, coalesce(v >= 3, false) as success, case when v < 3 then cast(v as varchar) end as message from p union all select 'info-' || event_id, event_type, epoch_us(ts), null, null, 'info', true, props from events where event_type = 'error'")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """The log that a stream of the events writes: of a user's events of a type each second one ends the run that the one before began; errors are notes.

    A value below 3 ends a run as failed.
    """
    events = table(spark, d, "events")
    keys = ["user_id", "event_type"]
    runs = ordered.running(events.where("event_type <> 'error'"), keys, ["event_id"], F.lit(1), "n")
    ends, failed = F.col("n") % 2 == 0, F.col("value") < 3
    entry = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.floor((F.col("n") - 1) / 2).cast("string"))
    rows = runs.select(entry.alias("entry"), F.col("event_type").alias("agent"), F.when(ends, "finish").otherwise("start").alias("phase"), F.col("ts").alias("at"), F.when(ends, ~failed).alias("success"), F.when(ends & failed, F.col("value").cast("string")).alias("message"))
    notes = events.where("event_type = 'error'").select(F.concat(F.lit("info-"), F.col("event_id").cast("string")).alias("entry"), F.col("event_type").alias("agent"), F.lit("info").alias("phase"), F.col("ts").alias("at"), F.lit(None).cast("boolean").alias("success"), F.col("props").alias("message"))
    path = staging.scratch(spark, "audit")
    rows.unionByName(notes).withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{path}/in")
    source = spark.readStream.schema(audit.LOG).option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    audit.append_stream(source, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    out = audit.entries(audit.read(spark, f"{path}/log"))
    return out.select("entry", "agent", F.unix_micros("started").alias("started_us"), F.unix_micros("finished").alias("finished_us"), "duration_ms", "status", "success", "message")


#: Stages of an analysis and what they need; the event types that stand for them in the test tables are in the SQL too.
NEEDS = [("questions", "document"), ("students", "document"), ("analysis", "questions"), ("analysis", "students"), ("report", "analysis")]
_STAGE = {"view": "document", "click": "questions", "signup": "students", "purchase": "analysis", "error": "report"}


@query(f"with recursive n(stage, needs) as (values {', '.join(map(str, NEEDS))}), r(upstream, stage) as (select needs, stage from n union select r.upstream, n.stage from r join n on n.needs = r.stage), e as (select user_id as record, event_id as version, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in _STAGE.items())} end as stage, value < 5 as edit from events), x as (select record, r.stage, version, true as edit from e join r on e.stage = r.upstream where e.edit union all select record, stage, version, false from e where not edit), k as (select *, count(*) filter (not edit) over (partition by record, stage order by version) as run from x) select record, stage, max(version) filter (not edit) as made, min(version) filter (edit) as stale_since from k where run > 0 group by record, stage, run having stale_since is not null")
def stale_results(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user are runs of the stage that their type stands for, those of a small value edits there."""
    stages = F.create_map(*[F.lit(x) for pair in _STAGE.items() for x in pair])
    rows = table(spark, d, "events").select(F.col("user_id").alias("record"), stages[F.col("event_type")].alias("stage"), F.when(F.col("value") < 5, "edit").otherwise("made").alias("kind"), F.col("event_id").alias("version"))
    return stale.marks(rows, spark.createDataFrame(NEEDS, "stage string, needs string"))


_GOOD = "g as (select * from lineitem where l_orderkey % 5 > 0)"


@query(f"with {_GOOD}, n as (select (select count(*) from g) as lines, (select count(distinct l_orderkey) from g) as exams, (select count(distinct l_orderkey) from lineitem where l_orderkey % 5 = 0) as bad, (select count(*) from (select distinct l_orderkey, l_partkey % 3 from g)) as outcomes) select * from (select 0 as place, 'documents' as stage, 'done' as state, unnest(['issues', 'good', 'questions', 'students']) as made, unnest([bad, exams, lines, 2 * exams]) as many from n union all select 1, 'measurement', 'done', unnest(['question_results', 'links']), unnest([lines, lines]) from n union all select 2, 'outcomes', 'done', unnest(['outcome_results', 'evidence']), unnest([outcomes, outcomes]) from n union all values (3, 'limits', 'failed', null, 0), (4, 'letters', 'skipped', null, 0)) union all select 5, 'weak', 'done', 'weak', (select count(*) from (select 1 from g group by l_orderkey, l_partkey % 3 having round(sum(floor(l_quantity / 2) + floor(l_quantity / 5)) / sum(2 * l_quantity), 9) < 0.35)) from n")
def analysis_trace(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of the analysis of the orders made: lines are questions, two students have a half and a fifth of their points; an optional stage fails for its rows.

    Each fifth order is of a component that isn't known.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    exams = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order has few lines
    blank = {f: F.lit(None).cast("string") for f in documents.OUTCOME_FIELDS}
    none = F.lit(None).cast("array<struct<" + ", ".join(f"{f}: string" for f in documents.OUTCOME_FIELDS) + ">>")

    def question(x):
        fields = blank | {"outcomeCode": F.concat(F.lit("C"), (x["l_partkey"] % 3).cast("string"))}
        return F.struct(F.lit(None).cast("string").alias("number"), x["l_quantity"].cast("string").alias("maxScore"), *[c.alias(f) for f, c in fields.items()], none.alias("outcomes"))

    def student(ref: str, share: int):
        return F.struct(F.lit(1).alias("rowNumber"), F.lit(ref).alias("studentRef"), F.transform("lines", lambda x: F.floor(x["l_quantity"] / share).cast("double")).alias("scores"), F.lit(None).cast("double").alias("totalScore"))

    component = F.when(F.col("l_orderkey") % 5 == 0, "oral").otherwise(F.lit("written"))
    payloads = exams.select(F.col("l_orderkey").alias("exam"), component.alias("component"), F.transform("lines", question).alias("questions"), F.array(student("Ö-001", 2), student("Ö-002", 5)).alias("students"), F.lit(None).cast("map<string,string>").alias("correctedCells"))
    limits = flow.Stage("limits", lambda t: {"limits": t["questions"].select("exam", F.when(F.col("question") > 5, F.raise_error(F.lit("too many questions"))).otherwise(F.lit(1)).alias("fine"))}, required=False)
    letters = flow.Stage("letters", lambda t: {"letters": t["limits"]}, needs=("limits",))
    weak = flow.Stage("weak", lambda t: {"weak": t["outcome_results"].where(F.round("rate", 9) < 0.35).select("exam", "outcome")})
    _, traces = flow.materialised(spark, [*flow.MATERIALISED, limits, letters, weak], {"payloads": staging.stage(payloads)}, staging.scratch(spark, "analysis"))
    rows = [(i, t.name, t.state, name, many) for i, t in enumerate(traces) for name, many in (t.rows.items() if t.rows else [(None, 0)])]
    return spark.createDataFrame(rows, "place int, stage string, state string, made string, many long")

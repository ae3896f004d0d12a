"""What an edit makes stale: stages depend on each other, and an edit of a record at one stage invalidates what later stages made of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import ordered

MARKS = "record {0}, stage string, made long, stale_since long"


def later(needs: DataFrame) -> DataFrame:
    """upstream, stage: all pairs where stage needs upstream, at once or through others, of needs(stage, needs). Stages are few and needs have no circle."""
    spark = needs.sparkSession
    return spark.sql("with recursive r(upstream, stage) as (select needs, stage from {needs} union all select r.upstream, n.stage from r join {needs} n on n.needs = r.stage) select distinct upstream, stage from r", needs=needs)


def marks(events: DataFrame, needs: DataFrame) -> DataFrame:
    """record, stage, made, stale_since: each time that what a stage made of a record became stale.

    events(record, stage, kind, version): kind is made when the stage was run for the record, edit when its input there was changed; versions grow. What a stage
    made at a version is stale since the first later edit at a stage that it needs, and is marked once; it is made anew by the stage's next run. An edit at
    the version of a run comes before it. What was never made can't be stale. Other kinds and rows with null are ignored.

    A record with many events isn't dealt to one task: runs are counted by ranges of versions (ordered.running).
    """
    rows = events.where(F.col("kind").isin("edit", "made")).select("record", "stage", "kind", F.col("version").cast("long").alias("version")).dropna()
    after = F.broadcast(later(needs).withColumnRenamed("stage", "stale"))
    edits = rows.where("kind = 'edit'").join(after, F.col("stage") == F.col("upstream")).select("record", F.col("stale").alias("stage"), "kind", "version").distinct()
    every = edits.unionByName(rows.where("kind = 'made'").select("record", "stage", "kind", "version").distinct())
    runs = ordered.running(every, ["record", "stage"], ["version", "kind"], F.when(F.col("kind") == "made", 1).otherwise(0), "run").where("run > 0")
    made, edit = F.col("kind") == "made", F.col("kind") == "edit"
    out = runs.groupBy("record", "stage", "run").agg(F.max(F.when(made, F.col("version"))).alias("made"), F.min(F.when(edit, F.col("version"))).alias("stale_since"))
    return out.where("stale_since is not null").select("record", "stage", "made", "stale_since")


def marks_stream(events: DataFrame, needs: DataFrame) -> DataFrame:
    """marks() for a stream whose versions come in order from batch to batch: a mark is given in the batch that has the edit.

    The state of a record is, for each stage, the version of its last run and whether that is stale.
    """
    after: dict[str, list[str]] = {}
    for r in later(needs).collect():  # a small dimension
        after.setdefault(r["upstream"], []).append(r["stage"])

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, done = dict(zip(*state.get[:2], strict=True)) if state.exists else {}, []
        rows = sorted({(int(v), k, s) for b in batches for v, k, s in zip(b["version"], b["kind"], b["stage"], strict=True)})
        for version, kind, stage in rows:  # edit sorts before made
            if kind == "made":
                fresh[stage] = version
            else:
                done += [(name[0], s, fresh.pop(s), version) for s in sorted(after.get(stage, [])) if s in fresh]
        state.update((list(fresh), list(fresh.values())))
        yield pd.DataFrame(done, columns=["record", "stage", "made", "stale_since"])

    rows = events.where(F.col("kind").isin("edit", "made")).select("record", "stage", "kind", F.col("version").cast("long").alias("version")).dropna()
    return rows.groupBy("record").applyInPandasWithState(run, MARKS.format(dict(rows.dtypes)["record"]), "stages array<string>, versions array<long>", "append", GroupStateTimeout.NoTimeout)

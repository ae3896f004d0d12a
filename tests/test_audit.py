"""The append-only log, the bus and what an edit makes stale: streams against their twins over whole tables, restarts with no doubles."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.operators import ordered
from tallyloom.streaming import audit, stale


def log_rows(spark, many=60):
    rows = []
    for i in range(many):
        rows.append((f"e{i}", f"a{i % 3}", "start", f"2024-01-01 00:00:{i % 60:02d}", None, None))
        if i % 4:
            rows.append((f"e{i}", f"a{i % 3}", "finish", f"2024-01-01 00:{'00' if i % 7 == 0 else '01'}:00.250", i % 5 > 0, "x" if i % 5 == 0 else None))
    rows.append(("n", "a", "info", "2024-01-01 00:00:00", None, "note"))
    rows.append(("late", "a", "finish", "2024-01-01 00:00:00", True, None))
    return spark.createDataFrame(rows, "entry string, agent string, phase string, at string, success boolean, message string").withColumn("at", F.col("at").cast("timestamp"))


def test_a_log_that_is_restarted_twice_equals_its_twin(spark, tmp_path):
    rows = log_rows(spark)
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(audit.LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    died = []

    def dies(batch, number):
        """Writes its batch and dies before the stream can note that; once it dies amid the write."""
        if number in (1, 3) and died.count(number) == 0:
            died.append(number)
            if number == 1:
                audit.append(f"{tmp_path}/log")(batch, number)
            else:
                batch.limit(1).write.parquet(f"{tmp_path}/log/batch={number:012d}")
                (tmp_path / "log" / f"batch={number:012d}" / "_SUCCESS").unlink()
            raise RuntimeError("lost")
        audit.append(f"{tmp_path}/log")(batch, number)

    for n in range(3):
        q = source().writeStream.foreachBatch(dies).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        if n < 2:
            with pytest.raises(Exception, match="lost"):
                q.awaitTermination()
        else:
            q.awaitTermination()
    assert died == [1, 3]
    got = audit.read(spark, f"{tmp_path}/log")
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, rows.collect()))
    assert [r.batch for r in got.select("batch").distinct().orderBy("batch").collect()] == list(range(6))
    assert sorted(map(str, audit.entries(got).collect())) == sorted(map(str, audit.entries(rows).collect()))
    # a later run with nothing new adds nothing
    audit.append_stream(source(), f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
    assert audit.read(spark, f"{tmp_path}/log").count() == rows.count()


def test_entries(spark):
    out = {r.entry: r for r in audit.entries(log_rows(spark)).collect()}
    assert (out["e4"].status, out["e4"].duration_ms, out["e4"].success) == ("started", None, False)
    assert (out["e1"].status, out["e1"].duration_ms, out["e1"].success) == ("completed", 59_250, True)
    assert (out["e5"].status, out["e5"].message, out["e5"].success) == ("failed", "x", False)
    assert (out["e21"].duration_ms, out["n"].status, out["n"].success, out["n"].message) == (0, "info", True, "note")
    assert (out["late"].status, out["late"].duration_ms) == ("completed", None)
    assert audit.entries(spark.createDataFrame([], audit.LOG)).count() == 0


def test_a_log_that_is_not_there(spark, tmp_path):
    assert audit.read(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "log" / "batch=000000000000").mkdir(parents=True)
    assert audit.read(spark, f"{tmp_path}/log").count() == 0


def test_bus(spark):
    got, bus = [], audit.Bus()
    see = lambda tag: lambda rows, number: got.append((tag, number, sorted(r.v for r in rows.collect())))
    first, second = see("first"), see("second")
    bus.on("a", first)
    bus.on("a", first)
    off = bus.on("a", second)
    bus.on("b", see("b"))
    assert bus.on("a", None)() is None
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "topic string, v int")
    bus.emit("topic")(batch, 7)
    off()
    off()
    bus.emit("topic")(batch, 8)
    assert got == [("first", 7, [1, 2]), ("second", 7, [1, 2]), ("b", 7, []), ("first", 8, [1, 2]), ("b", 8, [])]


NEEDS = [("questions", "document"), ("analysis", "questions"), ("analysis", "students"), ("report", "analysis"), ("letter", "report")]


def plain_marks(events, needs):
    after, grown = {(n, s) for s, n in needs}, True
    while grown:
        more = {(a, d) for a, b in after for c, d in after if b == c} - after
        grown, after = bool(more), after | more
    out = []
    for record in {e[0] for e in events}:
        fresh = {}
        for version, kind, stage in sorted({(v, k, s) for r, s, k, v in events if r == record}):
            if kind == "made":
                fresh[stage] = version
            else:
                out += [(record, s, fresh.pop(s), version) for a, s in after if a == stage and s in fresh]
    return sorted(out)


@pytest.fixture(scope="module")
def edits():
    r = np.random.default_rng(4)
    stages = ["document", "questions", "students", "analysis", "report", "letter"]
    many = [(f"r{int(r.integers(0, 6) ** 2 // 6)}", str(r.choice(stages)), str(r.choice(["made", "edit"], p=[0.6, 0.4])), v // 2) for v in range(700)]
    return [*many, *many[:20]]


def test_stale_marks(spark, edits):
    df = spark.createDataFrame([*edits, (None, "report", "made", 3), ("r0", "report", "seen", 3), ("r0", "report", "edit", None)], "record string, stage string, kind string, version long")
    needs = spark.createDataFrame(NEEDS, "stage string, needs string")
    want = plain_marks(edits, NEEDS)
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(map(tuple, stale.marks(df, needs).collect())) == want
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert len(want) > 50 and stale.marks(df.where("false"), needs).count() == 0


def test_stale_stream_restarted(spark, edits, tmp_path):
    needs = spark.createDataFrame(NEEDS, "stage string, needs string")
    schema = "record string, stage string, kind string, version long"
    (tmp_path / "in").mkdir()
    for n in range(4):  # the stream is stopped after each file and started again from its checkpoint
        part = [e for e in edits if e[3] * 4 // 350 == n]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        shutil.copy(next((tmp_path / str(n)).glob("*.parquet")), tmp_path / "in" / f"{n}.parquet")
        rows = stale.marks_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), needs)
        audit.append_stream(rows, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = audit.read(spark, f"{tmp_path}/out", stale.MARKS.format("string")).drop("batch")
    assert sorted(map(tuple, got.collect())) == plain_marks(edits, NEEDS)


def test_running_sums_of_a_large_key(spark):
    r = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else "big" if i % 3 else f"k{i % 5}", int(p), int(r.integers(-3, 9)) if i % 4 else None) for i, p in enumerate(r.permutation(900))]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(4)
    want, sums = {}, {}
    for k, p, v in sorted(rows, key=lambda x: x[1]):
        want[p] = sums[k] = sums.get(k, 0) + (v or 0)
    assert {x.p: x.s for x in ordered.running(df, ["k"], ["p"], F.col("v"), "s").collect()} == want


def test_staging(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(f"{tmp_path}/a")
    assert staging.committed(spark, f"{tmp_path}/a") and not staging.committed(spark, f"{tmp_path}/b")
    assert staging.folders(spark, str(tmp_path)) == ["a"] and staging.folders(spark, f"{tmp_path}/b") == []
    assert sorted(r.id for r in staging.stage(df).collect()) == [0, 1, 2, 3, 4]


def test_throttle_of_a_null_key_and_equal_times(spark):
    from tallyloom.streaming import events

    rows = [(None, 0), (None, 3), (None, 5), (7, 0), (7, 0), (7, 4), (7, 5), (8, None)]
    df = spark.createDataFrame(rows, "k long, s long").withColumn("t", F.timestamp_seconds("s")).repartition(3)
    assert sorted(map(str, ((r.k, r.fired_us // 1_000_000) for r in events.throttled(df, "k", "t", 5).collect()))) == sorted(map(str, [(None, 0), (None, 5), (7, 0), (7, 5)]))
    assert len([r for r in events.throttled(df, "k", "t", 0).collect() if r.k == 7]) == 4

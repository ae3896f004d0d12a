"""Events of stages published to handlers, and an append-only log of stages' runs that a stream writes.

The log is a folder with one folder for each batch of the stream. A batch is written under its number and counts once Spark's marker of a finished write is in it;
a batch that is offered again, as after a restart, is written only if it had not been finished. So the log has each row once, however often
the stream dies between writing a batch and noting that in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom import staging

#: What a batch of a stream is given to: its rows and its number.
Handler = Callable[[DataFrame, int], None]

#: Rows of the log. phase is start, finish or info; success tells how a run finished.
LOG = "entry string, agent string, phase string, at timestamp, success boolean, message string"


class Bus:
    """Handlers of topics. Those of a topic get its rows of each batch in the order in which they were added, also when there are none."""

    def __init__(self):
        self.handlers: dict[str, list[Handler]] = {}

    def on(self, topic: str, handler: Handler) -> Callable[[], None]:
        """Adds a handler, once; returns a function that removes it. What can't be called is ignored."""
        if not callable(handler):
            return lambda: None
        own = self.handlers.setdefault(topic, [])
        if handler not in own:
            own.append(handler)
        return lambda: self.off(topic, handler)

    def off(self, topic: str, handler: Handler) -> None:
        if handler in self.handlers.get(topic, []):
            self.handlers[topic].remove(handler)
            if not self.handlers[topic]:
                del self.handlers[topic]

    def emit(self, topic: str) -> Handler:
        """A handler of whole batches: gives each topic's handlers the rows whose column topic has its name. Topics without handlers are ignored.

        A handler that fails fails the batch, so the stream offers it again: handlers must bear that, as append() does.
        """

        def run(batch: DataFrame, number: int) -> None:
            wanted = batch.where(F.col(topic).isin(list(self.handlers))).persist()
            try:
                for name, own in list(self.handlers.items()):
                    for handler in list(own):
                        handler(wanted.where(F.col(topic) == name), number)
            finally:
                wanted.unpersist()

        return run


def append(path: str) -> Handler:
    """A handler that adds each batch's rows to the log at path, once."""

    def run(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch={number:012d}"
        if not staging.committed(batch.sparkSession, at):
            batch.write.mode("overwrite").parquet(at)

    return run


def append_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream that appends rows to the log at path; trigger as in DataStreamWriter.trigger."""
    return rows.writeStream.foreachBatch(append(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """The rows of all finished batches of a log, with the number of their batch; none where there is no log."""
    done = [f"{path}/{name}" for name in staging.folders(spark, path) if name.startswith("batch=") and staging.committed(spark, f"{path}/{name}")]
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(schema).parquet(*done).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))


def entries(log: DataFrame) -> DataFrame:
    """One row for each entry of the log: entry, agent, started, finished, duration_ms, status, success, message.

    A run that has begun is started until its finish comes, then completed or failed; a clock that went back gives a duration of 0. Of several starts the first and of
    several finishes the last counts; a finish without its start has no duration. An info entry is there at once and counts as a success.
    """
    is_start, is_finish = F.col("phase") == "start", F.col("phase") == "finish"
    order = F.struct("at", "success", "message")
    out = log.groupBy("entry").agg(
        F.max("agent").alias("agent"), F.min(F.when(is_start, F.col("at"))).alias("started"), F.max(F.when(is_finish, F.col("at"))).alias("finished"),
        F.max(F.when(is_finish, order)).alias("end"), F.max(F.when(F.col("phase") == "info", F.struct("at", "message"))).alias("info"),
    )
    took = F.greatest(F.lit(0), F.unix_millis("finished") - F.unix_millis("started")).cast("long")
    ok = F.coalesce(F.col("end.success"), F.lit(False))
    return out.select(
        "entry", "agent", F.coalesce("started", "info.at").alias("started"), "finished", F.when(F.col("finished").isNotNull() & F.col("started").isNotNull(), took).alias("duration_ms"),
        F.when(F.col("end").isNotNull(), F.when(ok, "completed").otherwise("failed")).when(F.col("started").isNotNull(), "started").otherwise(F.lit("info")).alias("status"),
        F.when(F.col("end").isNotNull(), ok).otherwise(F.col("info").isNotNull() & F.col("started").isNull()).alias("success"), F.coalesce("end.message", "info.message").alias("message"),
    )

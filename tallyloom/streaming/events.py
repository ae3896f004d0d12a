"""Stateful operators over event streams, each with a twin over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttled(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """key and times (microseconds) of events that fire: the first, then the first at least seconds after the last that fired.

    What fires hangs on all that fired before, so a key's events go through one task; it reads them sorted and keeps only the last that fired.
    """
    gap = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for b in batches:
            keys, us = b["g"].to_numpy(), b["us"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(b) else []
            out_keys, out = [], []
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                if name is None or keys[i] != name:
                    name, last = keys[i], None
                at = i if last is None else i + int(np.searchsorted(us[i:j], last + gap))
                while at < j:
                    last = us[at]
                    out_keys.append(name)
                    out.append(last)
                    at = i + int(np.searchsorted(us[i:j], last + gap)) if gap else at + 1
            yield pd.DataFrame({"g": out_keys, "fired_us": np.array(out, np.int64)})

    # keys of any type as texts, null being one of them
    slim = events.select(F.to_json(F.struct(key)).alias("g"), F.unix_micros(F.col(time).cast("timestamp")).alias("us")).where("us is not null")
    fired = slim.repartition("g").sortWithinPartitions("g", "us").mapInPandas(run, "g string, fired_us long")
    return fired.select(F.from_json("g", f"{key} {dict(events.dtypes)[key]}")[key].alias(key), "fired_us")


def throttled_stream(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """throttled() for a stream: what fired last is the state of each key; later events that come out of order don't fire."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(int(x) for b in batches for x in b["us"]):
            if last is None or t - last >= seconds * 1_000_000:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), "fired_us": out})

    slim = events.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    kind = dict(slim.dtypes)[key]
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, fired_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def group_sizes(events: DataFrame, key: str, expected: int) -> DataFrame:
    """Groups of a key complete whenever expected rows have come: key, complete groups and rows that wait."""
    return events.groupBy(key).agg(F.floor(F.count("*") / expected).cast("long").alias("complete"), (F.count("*") % expected).alias("waiting"))


def group_sizes_stream(events: DataFrame, key: str, expected: int) -> DataFrame:
    """group_sizes() for a stream: key, complete groups and rows that wait after each batch in which the key has rows."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        many = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((many,))
        yield pd.DataFrame({key: [name[0]], "complete": [many // expected], "waiting": [many % expected]})

    slim = events.select(key)
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {dict(slim.dtypes)[key]}, complete long, waiting long", "many long", "update", GroupStateTimeout.NoTimeout)


def newest_stream(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """latest() for a stream: of each batch a key's row of the highest sequence number, if no batch before had one as high.

    Answers that come after a newer one are dropped, and an edit or undo record takes the place of what was before it.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        best = None
        for b in batches:
            row = b.loc[[b[sequence].idxmax()]]
            if (last is None or row[sequence].iloc[0] > last) and (best is None or row[sequence].iloc[0] > best[sequence].iloc[0]):
                best = row
        if best is not None:
            state.update((int(best[sequence].iloc[0]),))
            yield best

    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, "last long", "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: edits, undo records and answers that came late."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))  # combines before the shuffle
    return rows.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def windowed(events: DataFrame, time: str, key: str, width: str, late: str = "1 day") -> DataFrame:
    """Counts by tumbling windows of event time and key; in a stream, events later than late are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("many")).select(F.col("w.start").alias("start"), key, "many")

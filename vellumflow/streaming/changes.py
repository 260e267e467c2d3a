"""Changes of notes as a stream: debouncing, and index upkeep per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCED = "path string, kind string, fired_at timestamp, n_events long"


def debounce_sessions(events: DataFrame, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """Bursts of ``events (path, kind, ts, event_id)`` per path as one row with the last kind; batch or stream.

    A burst ends after ``gap`` without an event. A delete ends nothing: the last event of the burst decides. For a
    stream, ``late`` is the watermark.
    """
    if late:
        events = events.withWatermark("ts", late)
    session = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n_events"))
    return session.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "kind", "n_events")


def debounce_timers(events: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """The same by state and timers, for streams: an update fires ``gap_ms`` after the last event of its path; a delete
    fires at once and drops a pending update."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "kind": ["modified"], "fired_at": [pd.Timestamp(last, unit="ms") + pd.Timedelta(milliseconds=gap_ms)], "n_events": [n]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last, n = state.get if state.exists else (0, 0)
        out = []
        for kind, ts in zip(rows["kind"], rows["ts"]):
            at = int(ts.value // 1_000_000)
            if kind == "deleted":
                out.append((key[0], "deleted", ts, n + 1))
                last, n = 0, 0
            else:
                if n and at - last > gap_ms:
                    out.append((key[0], "modified", pd.Timestamp(last, unit="ms") + pd.Timedelta(milliseconds=gap_ms), n))
                    n = 0
                last, n = at, n + 1
        if n:
            state.update((last, n))
            state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["path", "kind", "fired_at", "n_events"])

    held = T.StructType([T.StructField("last", T.LongType()), T.StructField("n", T.LongType())])
    return events.groupBy("path").applyInPandasWithState(step, DEBOUNCED, held, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(events: DataFrame, beats: str, step: Callable[[DataFrame], DataFrame], out: str, state: str, late: str, last: object) -> None:
    """Run ``step`` over the stream ``events`` until all is read, then flush what its state still holds.

    ``beats`` is an empty folder that stands beside the source as a second one. When the events are read, one row without a
    path and with the time ``last`` is written there and the query runs on from its checkpoint: the watermark passes
    ``last`` and closes every burst before it. Rows without a path are the caller's to drop. Meant for the end of a
    stream: later events would be late.
    """
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("append").parquet(beats)
    beat = spark.readStream.schema(events.schema).parquet(beats)
    for flush in (False, True):
        if flush:
            time = F.lit(last).cast("timestamp")
            spark.range(1).select(*[(time if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(beats)
        both = step(events.unionByName(beat).withWatermark("ts", late))
        both.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def index_changes(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """Start a stream that hands each micro-batch's ``(updated paths, deleted paths)`` to ``apply``; deletes come first.

    ``apply`` should replace or remove a path's rows (:func:`vellumflow.operators.registry.replace_files`), so that a
    repeated batch changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("path").agg(F.max_by("kind", "fired_at").alias("kind"))
        apply(last.where("kind <> 'deleted'").select("path"), last.where("kind = 'deleted'").select("path"))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

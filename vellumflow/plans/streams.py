"""Queries over the event stream: debounced changes, as batch and as stream run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, working_path
from ..streaming.changes import debounce_sessions, debounce_timers, run_to_end

GAP = "30 minutes"


def _changes(events: DataFrame) -> DataFrame:
    """Events as changes of one note per user; an error stands for a deletion."""
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select(F.format_string("Notes/u%d.md", "user_id").alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _shown(sessions: DataFrame) -> DataFrame:
    return sessions.select("path", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "kind", "n_events")


def debounce_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(debounce_sessions(_changes(table(spark, sf, "events")), GAP))


def _flushed(spark: SparkSession, sf: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of ``step`` over the events as a stream that is run to its end and flushed."""
    events = table(spark, sf, "events")
    last = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).cast("string")).first()[0] or "2000-01-01"
    source = _changes(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    out = working_path(spark, "stream")
    run_to_end(source, f"{out}/beats", step, f"{out}/data", f"{out}/state", "1 minute", last)
    return spark.read.schema(step(source).schema).parquet(f"{out}/data").where("path is not null")


def debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same events as a stream that runs until all are read and then closes the last burst of each note."""
    return _shown(_flushed(spark, sf, lambda events: debounce_sessions(events, GAP)))


def debounce_timer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same stream by state and timers: a deletion fires at once and ends the burst, an update half an hour after the last one."""
    fired = _flushed(spark, sf, lambda events: debounce_timers(events, 1_800_000))
    return fired.select("path", "kind", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("fired_at"), "n_events")


def debounce_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each note."""
    last = _changes(table(spark, sf, "events")).groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))
    return last.select("path", "kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


QUERIES = {f.__name__: f for f in (debounce_batch, debounce_stream, debounce_timer_stream, debounce_last)}
_CHANGES = "changes as (select 'Notes/u' || user_id || '.md' as path, case when event_type = 'error' then 'deleted' else 'modified' end as kind, ts, event_id from events)"
_SESSIONS = f"""
with {_CHANGES},
gaps as (select *, case when ts - lag(ts) over (partition by path order by ts, event_id) <= interval 30 minutes then 0 else 1 end as begins from changes),
numbered as (select *, sum(begins) over (partition by path order by ts, event_id rows unbounded preceding) as s from gaps),
sessions as (select path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, arg_max(kind, (ts, event_id)) as kind, count(*) as n_events from numbered group by path, s)
select path, started, kind, n_events from sessions"""
SQL = {
    "debounce_batch": _SESSIONS,
    "debounce_stream": _SESSIONS,
    "debounce_timer_stream": f"""
with {_CHANGES},
timed as (select *, epoch_us(ts) // 1000 as ms, lag(kind) over w as before, epoch_us(lag(ts) over w) // 1000 as last from changes window w as (partition by path order by ts, event_id)),
numbered as (select *, sum(case when before is null or before = 'deleted' or (kind = 'modified' and ms - last > 1800000) then 1 else 0 end) over (partition by path order by ts, event_id rows unbounded preceding) as s from timed),
bursts as (select path, arg_max(kind, (ts, event_id)) as kind, max(ms) as ms, count(*) as n_events from numbered group by path, s)
select path, kind, strftime(epoch_ms(case when kind = 'deleted' then ms else ms + 1800000 end), '%Y-%m-%d %H:%M:%S.%g') as fired_at, n_events from bursts""",
    "debounce_last": f"with {_CHANGES} select path, arg_max(kind, (ts, event_id)) as kind, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as ts from changes group by path",
}

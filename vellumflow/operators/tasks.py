"""Tasks in notes: extraction, due-date reports, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import due_bucket, parse_task, task_id
from .resolve import within

ORDER = ["overdue", "today", "next2", "upcoming"]


def extract_tasks(notes: DataFrame, key: str, path: Column, text: Column) -> DataFrame:
    """One row per checkbox line of ``notes``: ``(key, path, line_number, raw_line, task fields, task_id, daily_date)``."""
    lines = notes.select(key, path.alias("path"), F.posexplode(F.split(text, r"\r\n|\n")).alias("line_number", "raw_line"))
    out = lines.withColumn("t", parse_task(F.col("raw_line"))).where("t is not null").select(key, "path", "line_number", "raw_line", "t.*")
    daily = F.nullif(F.regexp_extract("path", r"(?:^|/)(\d{4}-\d{2}-\d{2})\.md$", 1), F.lit(""))
    return out.withColumn("task_id", task_id(F.col("path"), F.col("line_number"), F.col("task_text"))).withColumn("daily_date", daily)


def bucketed(tasks: DataFrame, today: Column) -> DataFrame:
    """Open tasks with their due bucket."""
    return tasks.where("not completed").withColumn("bucket", due_bucket(F.col("due_date"), F.col("daily_date"), today))


def pending_report(tasks: DataFrame, today: Column, by: str, buttons: int = 15) -> DataFrame:
    """Per ``by`` and bucket the number of open tasks, and how many of them are among the first ``buttons`` of all buckets in their order.

    A bucket gets what the counts of the buckets before it leave, so only counts meet in a window: four rows per ``by``.
    """
    counts = bucketed(tasks, today).groupBy(by, "bucket").agg(F.count("*").alias("n_tasks"))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("bucket"))
    before = F.coalesce(F.sum("n_tasks").over(Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("n_buttons", F.greatest(F.lit(0), F.least(F.col("n_tasks"), F.lit(buttons) - before)))


def briefing(tasks: DataFrame, today: Column) -> DataFrame:
    """Open tasks of a morning's message: overdue, today, tomorrow and the day after; undated ones only of today's note."""
    rows = bucketed(tasks, today).where("bucket <> 'upcoming'")
    return rows.withColumn("section", F.when(F.col("bucket") != "next2", F.col("bucket")).when(F.col("due_date") == F.date_add(today, 1).cast("string"), "tomorrow").otherwise("day_after"))


def pick_task(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """``(rid, path, line_number)``: the open task that each of ``requests (rid, scope, id, pattern)`` means.

    A request with an id means the task of that id or block id; else, with a pattern, the first whose line contains it
    in any case; with neither, the first open task. Order: daily notes newest first, then notes, then the rest, by name
    and line. ``tasks`` has ``scope``. Requests of a scope without such a task give no row.
    """
    rank = F.when(F.startswith("path", F.lit("Daily Notes/")), 0).when(F.startswith("path", F.lit("Notes/")), 1).otherwise(2)
    newest = F.when(F.col("dir_rank") == 0, F.concat(F.transform(F.split(F.col("path"), ""), lambda c: -F.ascii(c)), F.array(F.lit(1))))
    order = F.struct("dir_rank", newest.alias("newest"), "path", "line_number")  # falling names of daily notes: by their characters, negated
    open_ = tasks.where("not completed").withColumn("dir_rank", rank).withColumn("o", order)
    same = open_.select("scope", "o", F.explode(F.array_distinct(F.array("task_id", "block_id"))).alias("id")).where("id is not null")
    by_id = requests.where("id is not null").select("rid", "scope", "id").join(same, ["scope", "id"]).select("rid", "o")
    asked = requests.where("id is null and pattern is not null and pattern <> ''").select(F.col("rid").alias("qid"), "scope", F.lower("pattern").alias("part"))
    lines = open_.select(F.struct("scope", "o").alias("tid"), "scope", F.lower("raw_line").alias("text"))
    by_text = within(asked, lines).select(F.col("qid").alias("rid"), "tid.o")
    first = open_.groupBy("scope").agg(F.min("o").alias("o"))
    any_ = requests.where("id is null and (pattern is null or pattern = '')").select("rid", "scope").join(first, "scope").select("rid", "o")
    return by_id.union(by_text).union(any_).groupBy("rid").agg(F.min("o").alias("o")).select("rid", "o.path", "o.line_number")


def complete(text: Column, line_number: Column) -> Column:
    """The text with the checkbox of one line ticked."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda line, i: F.when(i == line_number, F.regexp_replace(line, r"\[ \]", "[x]")).otherwise(line)), "\n")


def insert_under(text: Column, header: Column, line: Column) -> Column:
    """The text with ``line`` at the end of the section ``header``; the section is added at the end if it is missing."""
    whole = F.concat(F.lit("\n"), F.regexp_replace(text, r"\s+$", ""), F.lit("\n"))
    start = F.instr(whole, F.concat(F.lit("\n"), header, F.lit("\n")))
    head_end = start + F.length(header) + 1
    tail = F.substr(whole, head_end, F.length(whole))
    section = F.regexp_extract(tail, r"(?s)^(.*?)(?=\n##? |\s*\z)", 1)
    rest = F.substr(tail, F.length(section) + 1, F.length(tail))
    inside = F.concat(F.substr(whole, F.lit(2), head_end - 2), F.regexp_replace(section, r"\s+$", ""), F.lit("\n"), line, F.when(F.regexp_replace(rest, r"\s", "") == "", F.lit("\n")).otherwise(F.concat(F.lit("\n"), rest)))
    added = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"), header, F.lit("\n"), line, F.lit("\n"))
    return F.when(start > 0, inside).otherwise(added)

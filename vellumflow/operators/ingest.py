"""Captured items and model answers as entries ready to be filed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def item_text(modality: Column, content: Column, caption: Column, file_path: Column, url: Column, sender: Column, transcript: Column, more: dict[str, Column] | None = None) -> Column:
    """One Markdown text per captured item. ``more`` adds or replaces modalities; unknown ones are plain text."""
    name = F.coalesce(F.element_at(F.split(file_path, "/"), -1), F.lit("attachment.png"))
    voice = F.concat_ws(" - ", F.nullif(t.strip(caption), F.lit("")), t.strip(transcript))
    ways = {
        "voice": voice,
        "image": F.concat(F.lit("🖼️ "), F.coalesce(F.nullif(t.strip(caption), F.lit("")), F.lit("Visual capture")), F.lit(" [Attachment: ![["), name, F.lit("]]]")),
        "document": F.coalesce(F.nullif(content, F.lit("")), F.nullif(caption, F.lit("")), F.lit("Document capture")),
        "url": F.concat(F.lit("🔗 ["), F.coalesce(F.nullif(caption, F.lit("")), F.lit("Web resource")), F.lit("]("), F.coalesce(url, t.strip(content)), F.lit(")")),
        "forwarded": F.concat(F.lit("Forwarded from "), F.coalesce(sender, F.lit("Forwarded")), F.lit(":\n"), t.strip(content)),
    } | (more or {})
    out = None
    for kind, column in ways.items():
        out = F.when(modality == kind, column) if out is None else out.when(modality == kind, column)
    return out.otherwise(t.strip(content))


def filed_entries(entries: DataFrame, today: Column, resolve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entries as they are filed: ``entries`` has ``raw_text`` and the columns of ``interstitial_entries``.

    Chatter of an assistant gives way to the raw text; what sounds like a task becomes one, with the due date it names
    and task syntax; Markdown is normalised; links, fields and block id are read from the content, where a field that is
    already there keeps its value. Nulls: a missing content is the raw text, missing maps and arrays are empty.
    """
    raw = t.strip(F.col("raw_text"))
    content = F.when(t.is_chatter(F.col("content")) | F.col("content").isNull() | (F.col("content") == ""), raw).otherwise(F.col("content"))
    spoken = F.coalesce(t.sounds_like_task(raw), F.lit(False))
    task = spoken | F.coalesce(F.lower(t.strip(F.col("category"))).isin(t.HEADERS[t.TASKS]), F.lit(False))
    due = F.coalesce(t.due_date(raw, today), F.col("due_date"))
    stamp = F.coalesce("timestamp", today.cast("string"))
    out = entries.withColumns({"is_task": task, "content": F.when(spoken, raw).otherwise(content)})
    out = out.withColumn("content", t.normalise_markdown(F.when(F.col("is_task"), t.as_tasks(F.col("content"), stamp, due)).otherwise(F.col("content"))))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fields = F.coalesce("dataview_fields", nothing)
    new = F.map_filter(F.coalesce(t.dataview_fields(F.col("content")), nothing), lambda k, v: ~F.map_contains_key(fields, k))
    none = F.array().cast("array<string>")
    links = F.concat(F.coalesce("extracted_wikilinks", none), F.coalesce(t.links_of_loose_text(F.col("content")), none))
    links = F.transform(links, lambda x: t.strip(F.regexp_replace(F.regexp_replace(x, r"[\[\]]", ""), r"(?s)\|.*$", "")))
    return out.select(
        *[c for c in entries.columns if c not in ("category", "memory_type", "content", "due_date", "dataview_fields", "extracted_wikilinks", "block_id")],
        F.when(F.col("is_task"), F.lit("task")).otherwise(F.col("category")).alias("category"), F.when(F.col("is_task"), F.lit("task")).otherwise(F.col("memory_type")).alias("memory_type"), "content",
        F.when(F.col("is_task"), F.coalesce(t.found(F.col("content"), rf"📅\s*({t.ISO})"), due)).otherwise(F.col("due_date")).alias("due_date"),
        F.map_concat(fields, new).alias("dataview_fields"), F.array_sort(F.array_distinct(F.filter(links, lambda x: x != ""))).alias("extracted_wikilinks"),
        F.coalesce("block_id", t.block_id(F.col("content"))).alias("block_id"),
    )


def recent_excerpts(notes: DataFrame, most: int = 30, chars: int = 600) -> DataFrame:
    """The notes changed last with the beginning of each, for a summary (a top-k report)."""
    return notes.orderBy(F.desc("modified"), "path").limit(most).select("path", "title", F.substring("text", 1, chars).alias("excerpt"))

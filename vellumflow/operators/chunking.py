"""Structure-aware chunks of notes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.python_udfs import yaml_fields

_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
FOLDED = "content:string,heading:string,heading_path:array<string>,chunk_index:int"


def cut_note(body: str, title: str, most: int | None) -> list[tuple[str, str, list[str], int]]:
    """Chunks ``(content, heading, heading path, number)`` of one text.

    Lines are marked all at once: fences, what lies within them, headings outside. Chunks begin at headings; a chunk whose
    characters reach ``most`` ends behind its next blank line outside of fences. Chunks without text are left out.
    """
    lines = body.splitlines()
    if not lines:
        return []
    bare = [x.strip() for x in lines]
    fence = np.array([x.startswith("```") for x in bare])
    free = ~fence & ((np.cumsum(fence) - fence) % 2 == 0)
    heads = {int(k): m for k in np.flatnonzero(free) if (m := _HEADING.match(bare[k]))}
    ends = np.cumsum([len(x) + 1 for x in lines])
    blank = np.array([k for k in np.flatnonzero(free) if not bare[k]], dtype=np.int64)
    levels, out = {1: title}, []
    for begin, stop in zip([0, *heads], [*heads, len(lines)]):
        name = title
        if begin in heads:
            depth, name = len(heads[begin].group(1)), heads[begin].group(2).strip()
            levels = {n: x for n, x in levels.items() if n < depth} | {depth: name}
        inside = blank[(blank >= begin) & (blank < stop)]
        while begin < stop:
            reached = ends[inside] - (ends[begin - 1] if begin else 0) >= most if most is not None else np.zeros(len(inside), bool)
            upto = int(inside[np.argmax(reached)]) + 1 if reached.any() else stop
            content = "\n".join(lines[begin:upto]).strip()
            if content:
                out.append((content, name, list(levels.values()), len(out)))
            begin, inside = upto, inside[inside >= upto]
    return out


def chunk_notes(notes: DataFrame, most: int = 1500) -> DataFrame:
    """Chunks of ``notes (path, title, text, modified)`` with their links, tags, block ids, type and id.

    One pass without a shuffle: cutting and YAML are Arrow-batched Python, all else built-in functions. Tags of the
    frontmatter belong to every chunk. Notes with an empty body give no chunk; null texts neither.
    """
    base = notes.select("path", "title", "modified", t.body(F.col("text")).alias("body"), yaml_fields(t.frontmatter_block(F.col("text"))).alias("front")).where("body is not null")
    field = lambda name: F.nullif(F.element_at("front", name), F.lit(""))
    base = base.withColumns({
        "created": F.coalesce(field("created"), F.col("modified").cast("string")), "memory": F.lower(field("memory_type")), "source": F.lower(field("source_type")),
        "base_tags": F.coalesce(t.as_tags(t.listed(field("tags"))), F.array().cast("array<string>")),
    })

    @F.pandas_udf(f"array<struct<{FOLDED}>>")
    def fold(bodies: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([[{"content": c, "heading": h, "heading_path": p, "chunk_index": i} for c, h, p, i in cut_note(b or "", n or "", most)] for b, n in zip(bodies, titles)])

    kept = ["path", "title", "created", "memory", "source", "base_tags"]
    chunks = base.select(*kept, F.explode(fold("body", "title")).alias("c")).select(*kept, "c.*")
    return enrich(chunks)


def enrich(chunks: DataFrame) -> DataFrame:
    c = F.col("content")
    task = F.contains(c, F.lit("- [ ]")) | F.contains(c, F.lit("- [x]"))
    return chunks.select(
        t.uuid5(F.concat_ws("#", "path", F.col("chunk_index").cast("string"))).alias("id"), "path", "title", "heading", "heading_path", "chunk_index", "content",
        t.wikilinks(c).alias("wikilinks"), F.array_sort(F.array_union("base_tags", t.tags(c))).alias("tags"), t.block_ids(c).alias("block_ids"),
        F.coalesce("memory", F.when(task, F.lit("task")).otherwise(F.lit("user_authored"))).alias("memory_type"), F.coalesce("source", F.lit("user_authored")).alias("source_type"), "created",
    )


#: One unit of a text: a fenced block with its fences, or a line.
UNIT = r"(?d)[^\S\n]*```[^\n]*(?:\n(?![^\S\n]*```)[^\n]*)*(?:\n[^\n]*)?(?:\n|\z)|[^\n]*(?:\n|\z)"


def sections(notes: DataFrame, key: str, text: Column, title: Column) -> DataFrame:
    """Sections ``(key, section, heading, level, n_lines)`` by the chunker's rules without its size cut, in built-in functions.

    A text is cut into units (:data:`UNIT`) inside its row, headings among them begin sections, and only sections become
    rows: nothing is shuffled. Sections without text are left out; null texts give none.
    """
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    units = F.when(F.endswith(text, F.lit("\n")) | (text == ""), units).otherwise(F.slice(units, F.lit(1), F.size(units) - 1))  # the empty match at the end is a line only behind a line end
    rows = notes.where(text.isNotNull()).select(F.col(key), title.alias("title"), units.alias("units"))
    rows = rows.withColumn("heads", F.filter(F.transform("units", lambda u, i: F.when(t.strip(u).rlike(r"^#{1,6}\s+[^\n]*$"), i)), lambda i: i.isNotNull()))
    begins = F.concat(F.array(F.lit(0)), F.col("heads"))
    stops = F.concat(F.col("heads"), F.array(F.size("units")))
    spans = F.transform(F.arrays_zip(begins.alias("begin"), stops.alias("stop")), lambda s, i: F.struct(i.alias("section"), F.slice("units", s["begin"] + 1, s["stop"] - s["begin"]).alias("part"), (i > 0).alias("named")))
    rows = rows.select(key, "title", F.explode(spans).alias("s")).select(key, "title", "s.*").where(F.exists("part", lambda u: t.strip(u) != ""))
    first = t.strip(F.get("part", F.lit(0)))
    lines = F.aggregate(F.transform("part", lambda u: F.length(F.regexp_replace(F.regexp_replace(u, r"\n\z", ""), r"[^\n]", "")) + 1), F.lit(0), lambda a, b: a + b)
    return rows.select(
        key, F.col("section").cast("int").alias("section"), F.when(F.col("named"), t.strip(F.regexp_extract(first, r"^#{1,6}\s+(.*)$", 1))).otherwise(F.col("title")).alias("heading"),
        F.when(F.col("named"), F.length(F.regexp_extract(first, r"^(#{1,6})\s", 1))).otherwise(F.lit(1)).alias("level"), lines.cast("int").alias("n_lines"),
    )

"""A folder of Markdown notes as a table, and the files written back to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body, strip

# Folders of a vault that hold no notes.
IGNORED = [".git", ".obsidian", ".trash", ".stfolder", "__pycache__", ".venv"]


def scan(spark: SparkSession, root: str, hidden_folders: bool = False) -> DataFrame:
    """``(path, title, dir, dir_rank, modified, hash, text)`` of all ``*.md`` below ``root``.

    ``path`` is relative to the root. Files whose name begins with a dot, and files in ignored folders, are left out;
    in any folder beginning with a dot too, unless ``hidden_folders``. Bytes that are no UTF-8 become the replacement
    character. An empty folder gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base, -1)
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    kept = ~F.startswith(name, F.lit(".")) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED)))
    if not hidden_folders:
        kept = kept & ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")))
    folder = F.array_join(folders, "/")
    rank = F.when(folder == "Notes", 0).when(folder == "Daily Notes", 1).when(folder == "", 2)
    return files.where(kept).select(
        path.alias("path"), F.regexp_replace(name, r"\.md$", "").alias("title"), folder.alias("dir"), rank.alias("dir_rank"), F.col("modificationTime").alias("modified"),
        F.md5("content").alias("hash"), F.decode("content", "utf-8").alias("text"),
    )


def candidates(notes: DataFrame) -> DataFrame:
    """Notes of the three folders that are looked up by name, in their order: Notes, Daily Notes, the root itself."""
    return notes.where("dir_rank is not null")


def titles(notes: DataFrame) -> DataFrame:
    return notes.select("title").distinct().orderBy("title")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation file: a JSON array of ``id, category, question, expected_sources``."""
    return spark.read.schema("id string, category string, question string, expected_sources array<string>").json(path, multiLine=True)


def checked_vectors(vectors: DataFrame, size: int, column: str = "vector") -> DataFrame:
    """The same rows; the query fails if a vector has another length than ``size``."""
    wrong = F.col(column).isNotNull() & (F.size(column) != size)
    return vectors.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"vector length differs from {size}: "), F.size(column).cast("string"))).cast("array<float>")).otherwise(F.col(column)))


def open_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The vector table kept at ``path`` (:func:`..operators.registry.save_table`), empty if there is none; a vector of another length fails the query."""
    from ..operators.registry import open_table

    kept = open_table(spark, path)
    return spark.createDataFrame([], "id string, vector array<float>, content string") if kept is None else checked_vectors(kept, size)


def vector_points(chunks: DataFrame, key: str, vector: str, content: str) -> DataFrame:
    """Rows for a vector table: those with a vector, with UUID keys (others become name-based ones)."""
    from ..functions.text import uuid5

    is_uuid = F.col(key).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return chunks.where(F.col(vector).isNotNull()).withColumn(key, F.when(is_uuid, F.col(key)).otherwise(uuid5(F.col(key)))).withColumn("content", F.col(content))


def write_notes(notes: DataFrame, root: str) -> None:
    """Write ``notes (path, text)`` as files below ``root``; each executor writes its own rows. A path outside the root fails.

    For folders that all executors share; a note is written beside its place and moved there, so a repeated task does no harm.
    """

    def put(rows) -> None:
        import os

        top = os.path.realpath(root.removeprefix("file://"))
        for row in rows:
            to = os.path.realpath(os.path.join(top, row["path"]))
            if not to.startswith(top + os.sep):
                raise ValueError(f"path outside the vault: {row['path']}")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            beside = f"{to}.{os.getpid()}.tmp"
            with open(beside, "w", encoding="utf-8", newline="") as f:
                f.write(row["text"] or "")
            os.replace(beside, to)

    notes.select("path", "text").foreachPartition(put)


def readable(notes: DataFrame) -> DataFrame:
    """Text without frontmatter, stripped."""
    return notes.withColumn("text", strip(body(F.col("text"))))

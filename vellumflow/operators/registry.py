"""Incremental index upkeep: a versioned registry of indexed files, its diff against a snapshot, and the writes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes an index entry stale besides the file's content.
VERSIONS = ["model", "embedding_version", "chunker_version", "parser_version"]
MOST_DELETIONS = 50


def diff(snapshot: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """``(path, state)`` of ``snapshot (path, hash, VERSIONS...)`` against ``registry`` of the same columns:
    ``new``, ``changed`` (hash), ``outdated`` (a version), ``fresh``, ``deleted``. ``force``: fresh ones count as changed."""
    kept = [c for c in VERSIONS if c in snapshot.columns and c in registry.columns]
    old = registry.select("path", F.col("hash").alias("old_hash"), *[F.col(c).alias(f"old_{c}") for c in kept], F.lit(True).alias("known"))
    both = snapshot.withColumn("there", F.lit(True)).join(old, "path", "full_outer")
    outdated = F.lit(False)
    for c in kept:
        outdated = outdated | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    state = (
        F.when(F.col("there").isNull(), "deleted")
        .when(F.col("known").isNull(), "new")
        .when(~F.col("hash").eqNullSafe(F.col("old_hash")), "changed")
        .when(outdated, "outdated")
        .otherwise("changed" if force else "fresh")
    )
    return both.select("path", state.alias("state"))


def stale(state: Column) -> Column:
    return state.isin("new", "changed", "outdated")


def statistics(states: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, indexed, skipped and deleted, and chunks of the stale files if ``chunks (path)`` is given."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = F.col("state")
    out = states.agg(count(s != "deleted").alias("scanned"), count(stale(s)).alias("indexed"), count(s == "fresh").alias("skipped"), count(s == "deleted").alias("deleted"))
    if chunks is not None:
        n = chunks.join(states.where(stale(s)), "path", "left_semi").agg(F.count("*").alias("chunks"))
        out = out.join(n)
    return out


def guard_deletions(states: DataFrame, most: int = MOST_DELETIONS) -> None:
    """Refuse a snapshot in which more than ``most`` known files are missing: a broken mount, not a clean-up."""
    gone = states.where("state = 'deleted'").limit(most + 1).count()
    if gone > most:
        raise ValueError(f"the snapshot lacks more than {most} indexed files")


def upsert(table: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those of equal key."""
    keys = [key] if isinstance(key, str) else key
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_files(chunks: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``chunks`` with those of the ``touched (path)`` files replaced by ``new``: no surplus chunk of a shorter file stays."""
    return chunks.join(touched.select("path").distinct(), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def record(registry: DataFrame, snapshot: DataFrame, states: DataFrame) -> DataFrame:
    """The registry after indexing: stale files as in the snapshot, deleted ones gone."""
    done = snapshot.join(states.where(stale(F.col("state"))), "path", "left_semi")
    return upsert(registry.join(states.where("state = 'deleted'"), "path", "left_anti"), done, "path")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file: ``{"files": {path: record}}``, a flat ``{path: record}`` or the legacy ``{path: md5}``.

    Legacy entries get the model ``legacy`` and version 1.0, so that they are stale once. Keys beginning with ``_`` are
    metadata. A missing or broken file gives an empty registry.
    """
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    text = spark.read.text(path, wholetext=True) if exists else spark.createDataFrame([], "value string")
    whole = text.select(F.from_json("value", "map<string,string>").alias("m"))
    files = whole.select(F.coalesce(F.from_json(F.col("m")["files"], "map<string,string>"), F.col("m")).alias("m"))
    rows = files.select(F.explode("m").alias("path", "entry")).where(~F.startswith("path", F.lit("_")))
    field = lambda k, legacy: F.when(F.startswith(F.col("entry"), F.lit("{")), F.get_json_object("entry", f"$.{k}")).otherwise(F.lit(legacy) if legacy is not None else F.col("entry"))
    return rows.select(
        "path", field("content_hash", None).alias("hash"), field("embedding_model", "legacy").alias("model"), field("embedding_version", "1.0").alias("embedding_version"),
        field("chunker_version", "1.0").alias("chunker_version"), field("parser_version", "1.0").alias("parser_version"),
        F.coalesce(field("chunks_count", "0").cast("int"), F.lit(0)).alias("chunks_count"), field("indexed_at", "").alias("indexed_at"),
    )


def save_table(rows: DataFrame, path: str) -> None:
    """Keep a table (registry, chunks, vectors) at ``path``; written beside and then moved, so a failed run leaves the old one."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.new"
    rows.write.mode("overwrite").parquet(beside)
    here, there = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path.rstrip("/")))
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(there, True)
    files.rename(here, there)


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table kept at ``path``, None if there is none."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.parquet(path) if exists else None

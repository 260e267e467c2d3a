"""References to records that do not exist.

References and the validity intervals of the records they name are hashed to the same partition by key and sorted by
key and time in ONE shuffle; a linear merge then walks both streams once. The merge is a running maximum over the
sorted union (`max(end) over (partition by key order by time)`): a reference is answered iff an interval that began not
later than it ends after it. First begin and last end of the key tell missing, deleted and late apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

FOREVER = "9999-12-31 23:59:59"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def link_name(c: Column) -> Column:
    """The name in a link: trimmed, without an outer ``[[ ]]``, cut at the first ``|`` or ``#``, without folders and a
    final ``.md``, trimmed again, lower case. Empty means no reference."""
    c = strip(c)
    c = F.regexp_replace(c, r"(?s)^\[\[(.*)\]\]$", "$1")
    c = F.regexp_replace(c, r"(?s)[|#].*$", "")
    c = F.regexp_replace(c, r"(?s)^.*/", "")
    c = F.regexp_replace(strip(c), r"(?i)\.md$", "")
    return F.lower(strip(c))


def orphan_references(refs: DataFrame, parents: DataFrame, per_task: int = 500_000) -> DataFrame:
    """Orphans among ``refs (scope, name, at, ...)`` given ``parents (scope, name, since, until)``.

    A parent answers references of its scope and name with ``since <= at < until`` (null ``until``: still there).
    Result: the columns of ``refs`` other than ``name`` and ``scope`` plus ``why``: ``missing`` (no parent ever),
    ``deleted`` (all that had begun had ended) or ``late`` (all began later). A null ``at`` is answered by no parent; a
    null ``scope`` matches nothing; a parent without ``since`` is ignored. Repeated references stay repeated rows.
    The references of a name with more than ``per_task`` of them are cut by hash into parts of about so many, and its
    parents, first reduced to one row per start, are copied to each part. ``per_task`` is raised where more than a million
    names would be such, so their list is broadcast.
    """
    limit = max(per_task, refs.count() // 1_000_000)
    hot = refs.groupBy("scope", "name").count().where(F.col("count") > limit).select("scope", "name", F.ceil(F.col("count") / limit).cast("int").alias("salts"))
    hot = F.broadcast(saved(hot, "hot_names"))
    n = F.coalesce("salts", F.lit(1))
    payload = F.struct(*[F.col(f"`{c}`") for c in refs.columns if c not in ("scope", "name")])
    r = refs.join(hot, ["scope", "name"], "left").select(
        "scope", "name", F.pmod(F.xxhash64("at", *[F.col(f"`{c}`") for c in refs.columns if c not in ("scope", "name", "at")]), n).cast("int").alias("salt"), F.col("at").cast("timestamp").alias("t"),
        F.lit(1).alias("side"), F.lit(None).cast("timestamp").alias("until"), payload.alias("row"),
    )
    p = (
        parents.where("since is not null")
        .groupBy("scope", "name", F.col("since").cast("timestamp").alias("t"))
        .agg(F.max(F.coalesce(F.col("until").cast("timestamp"), F.lit(FOREVER).cast("timestamp"))).alias("until"))
        .join(hot, ["scope", "name"], "left")
        .select("scope", "name", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), "t", F.lit(0).alias("side"), "until")
    )
    key = Window.partitionBy("scope", "name", "salt")
    merged = r.unionByName(p, allowMissingColumns=True).select(
        "*",
        F.max("until").over(key.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)).alias("reach"),
        # what comes after in the same stream: a parent that began later
        F.max("until").over(key.orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)).alias("later"),
    )
    why = (
        F.when(F.col("scope").isNull(), F.lit("missing"))
        .when(F.col("reach").isNotNull(), F.lit("deleted"))
        .when(F.col("later").isNotNull(), F.lit("late"))
        .otherwise(F.lit("missing"))
    )
    answered = F.col("scope").isNotNull() & F.coalesce(F.col("reach") > F.col("t"), F.lit(False))
    return merged.where((F.col("side") == 1) & ~answered).select("row.*", why.alias("why"))

"""Messages delivered more than once: an identifier index of sorted arrays, searched batch by batch.

The index is a folder of immutable *runs*. A run holds, per hash prefix, the identifiers of some batches as arrays sorted
by hash, with the lowest delivery that brought each; its files are bucketed by prefix, so a search shuffles the batch and
never the index. A batch is first reduced to its distinct identifiers (partial aggregation before the shuffle, so one hot
identifier is one row per task), packed per prefix, looked up in each run by binary search, and only its novel identifiers
become a new run. Runs of one level are merged into one of the next when there are ``fan`` of them, so an identifier is
written anew once per level, not once per batch. Identifiers that were ever delivered together (an update number and a
message number in one row) are joined into classes by label contraction over the links between their owners, as
distributed joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, working_path

KEY = ["kind", "scope", "id"]
RUN_SCHEMA = "prefix int, hashes array<long>, kinds array<tinyint>, scopes array<long>, ids array<long>, owners array<long>"
FOUND = "kind byte, scope long, id long, owner long"


def identifiers(updates: DataFrame) -> DataFrame:
    """Rows ``(delivery_id, kind, scope, id)``: kind 0 is an update number within its vault, 1 a message number within its chat.

    A null identifier, vault or chat identifies nothing and gives no row.
    """
    return (
        updates.select(
            "delivery_id",
            F.explode(
                F.array(
                    F.struct(F.lit(0).cast("byte").alias("kind"), F.col("vault_id").alias("scope"), F.col("update_id").alias("id")),
                    F.struct(
                        F.lit(1).cast("byte").alias("kind"),
                        F.when(F.col("update_kind") == "message", F.col("chat_id")).alias("scope"),
                        F.col("message_id").alias("id"),
                    ),
                )
            ).alias("k"),
        )
        .select("delivery_id", "k.*")
        .where("delivery_id is not null and scope is not null and id is not null")
    )


def _prefix(h: Column, bits: int) -> Column:
    """The upper ``bits`` of a hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _packed(df: DataFrame, bits: int, buckets: int) -> DataFrame:
    """``df (kind, scope, id, owner)`` as one row per prefix with arrays sorted by hash."""
    hashed = df.select(*KEY, "owner", F.xxhash64(*KEY).alias("h")).withColumn("prefix", _prefix(F.col("h"), bits)).repartition(buckets, "prefix")
    grouped = hashed.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("h", *KEY, "owner"))).alias("a"))
    return grouped.select("prefix", F.col("a.h").alias("hashes"), F.col("a.kind").alias("kinds"), F.col("a.scope").alias("scopes"), F.col("a.id").alias("ids"), F.col("a.owner").alias("owners"))


def _find(run: list[np.ndarray], want: list[np.ndarray]) -> np.ndarray:
    """Owners in one run of the wanted identifiers (-1: not there), both ``(hashes, kinds, scopes, ids, owners)``; rows of equal hash are told apart by the identifier itself."""
    hashes, kinds, scopes, ids, owners = run
    h, k, s, i, _ = want
    at = np.searchsorted(hashes, h)
    found = np.full(len(h), -1, dtype=np.int64)
    open_ = np.flatnonzero(at < len(hashes))
    while len(open_):
        pos = at[open_]
        same_hash = hashes[pos] == h[open_]
        open_, pos = open_[same_hash], pos[same_hash]
        hit = (kinds[pos] == k[open_]) & (scopes[pos] == s[open_]) & (ids[pos] == i[open_])
        found[open_[hit]] = owners[pos[hit]]
        open_ = open_[~hit]
        at[open_] += 1
        open_ = open_[at[open_] < len(hashes)]
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            want, run = ([batch.column(c)[k].values.to_numpy() for c in range(5 * side, 5 * side + 5)] for side in (0, 1))
            found = _find(run, want)
            hit = found >= 0
            yield pa.RecordBatch.from_arrays([pa.array(want[1][hit], pa.int8()), pa.array(want[2][hit], pa.int64()), pa.array(want[3][hit], pa.int64()), pa.array(found[hit], pa.int64())], names=["kind", "scope", "id", "owner"])


class IdentifierIndex:
    """Index of delivered identifiers in the folder ``path``; opening a folder that holds one goes on from it.

    ``add`` takes batches in order of arrival, from one writer at a time. ``per_prefix``: identifiers that one row of a run
    holds at most, about; a larger run has more prefixes. ``fan``: runs of a level that are merged. A run's name tells the
    batches it covers, its level, prefix bits and buckets; a run that another covers (a merge that failed before it
    removed its parts) is passed over.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, per_prefix: int = 100_000, fan: int = 4):
        self.spark, self.path, self.per_prefix, self.fan = spark, (path or working_path(spark, "index")).rstrip("/"), per_prefix, fan
        self.written = 0  # identifiers written by this object, merges included
        self._tables: dict[str, DataFrame] = {}

    def _files(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int, int, int, int, str]]:
        """``(first batch, last batch, level, bits, buckets, name)`` of the runs that count, in order."""
        at, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        found = sorted((*map(int, n.split("-")[1:6]), n) for n in names if n.startswith("run-"))
        return [r for r in found if not any(o[0] <= r[0] and r[1] <= o[1] and o != r for o in found)]

    def _open(self, run: tuple) -> DataFrame:
        name = run[5]
        if name not in self._tables:
            table = f"vellumflow_run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {table} ({RUN_SCHEMA}) using parquet clustered by (prefix) into {run[4]} buckets location '{self.path}/{name}'")
            self._tables[name] = self.spark.table(table)
        return self._tables[name]

    def _write(self, owned: DataFrame, rows: int, first: int, last: int, level: int) -> None:
        """A run of ``owned``; it gets its name when all its files are there."""
        bits = max(0, int(np.ceil(np.log2(max(1, rows / self.per_prefix)))) + (rows > self.per_prefix // 8) * 3)
        buckets = min(1 << bits, 1024)
        name, beside, table = f"run-{first:08d}-{last:08d}-{level}-{bits}-{buckets}", f"new-{uuid.uuid4().hex}", f"vellumflow_run_{uuid.uuid4().hex}"
        _packed(owned, bits, buckets).write.bucketBy(buckets, "prefix").option("path", f"{self.path}/{beside}").format("parquet").saveAsTable(table)
        self.spark.sql(f"drop table {table}")  # its files stay
        _, files = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files.rename(path(f"{self.path}/{beside}"), path(f"{self.path}/{name}"))
        self.written += rows

    def _rows(self, run: tuple) -> DataFrame:
        flat = self._open(run).select(F.explode(F.arrays_zip("kinds", "scopes", "ids", "owners")).alias("e"))
        return flat.select(F.col("e.kinds").cast("byte").alias("kind"), F.col("e.scopes").alias("scope"), F.col("e.ids").alias("id"), F.col("e.owners").alias("owner"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Owners ``(kind, scope, id, owner, novel)`` of the distinct identifiers of ``batch (delivery_id, kind, scope, id)``; novel ones enter the index."""
        own = saved(batch.groupBy(*KEY).agg(F.min("delivery_id").alias("owner")), "batch")
        runs = self.runs()
        owned = own.withColumn("novel", F.lit(True))
        for run in runs:
            wanted = _packed(own, run[3], run[4]).select("prefix", *[F.col(c).alias(f"w_{c}") for c in ("hashes", "kinds", "scopes", "ids", "owners")])
            both = self._open(run).join(wanted.hint("shuffle_hash"), "prefix")
            found = both.select("w_hashes", "w_kinds", "w_scopes", "w_ids", "w_owners", "hashes", "kinds", "scopes", "ids", "owners").mapInArrow(_search, FOUND)
            owned = owned.unionByName(found.withColumn("novel", F.lit(False)))
        owned = saved(owned.groupBy(*KEY).agg(F.min("owner").alias("owner"), F.min("novel").alias("novel")), "owners") if runs else owned
        number = runs[-1][1] + 1 if runs else 1
        novel = owned.where("novel")
        rows = novel.count()
        if rows:
            self._write(novel, rows, number, number, 0)
            self._merge()
        return owned

    def _merge(self) -> None:
        while True:
            runs = self.runs()
            level = next((n for n in sorted({r[2] for r in runs}) if sum(r[2] == n for r in runs) >= self.fan), None)
            if level is None:
                return
            parts = [r for r in runs if r[2] == level]
            rows = self._rows(parts[0])
            for r in parts[1:]:
                rows = rows.unionByName(self._rows(r))
            rows = rows.groupBy(*KEY).agg(F.min("owner").alias("owner"))
            self._write(saved(rows, "merged"), rows.count(), parts[0][0], parts[-1][1], level + 1)
            _, files = self._files()
            for r in parts:
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r[5]}"), True)


def contract(links: DataFrame, max_rounds: int = 60, per_task: int = 100_000) -> DataFrame:
    """Lowest node reachable from each node of ``links (a, b)`` as ``(node, label)``, over any number of links.

    Alternating large-star and small-star steps: every step is one aggregation and one join on the node, and the number
    of steps grows with the logarithm of the longest chain. A node with more than ``per_task`` links is one row after
    the aggregation and is cut into parts of about so many links in the join; at most a million such nodes are told apart
    (``per_task`` is raised beyond that), so their list is broadcast.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()  # noqa: E731  distinct rows: equal marks, equal edges
    now = mark(edges)
    for _ in range(max_rounds):
        if not now["n"]:
            break
        limit = max(per_task, 2 * now["n"] // 1_000_000)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_lowest(large, limit)
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v")))
        edges = saved(down.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star")
        before, now = now, mark(edges)
        if before == now:
            break
    else:
        raise RuntimeError("label contraction did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _with_lowest(edges: DataFrame, limit: int) -> DataFrame:
    """``edges (u, v)`` with ``m``, the lowest of each ``u`` and its neighbours; the links of a large ``u`` spread over several tasks."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    hubs = F.broadcast(low.where("parts > 1").select("u", F.col("parts").alias("cut")))
    spread = edges.join(hubs, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("cut", F.lit(1))).cast("int")).drop("cut")
    return spread.join(low.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["u", "part"]).select("u", "v", "m")


def surplus_deliveries(updates: DataFrame, batches: int = 4, per_prefix: int = 100_000, per_task: int = 100_000) -> DataFrame:
    """``delivery_id`` of every delivery that an earlier one makes surplus.

    Two deliveries are the same if they share an update number of a vault or a message number of a chat, and sameness
    carries on from row to row; the lowest ``delivery_id`` of each such class is kept. ``batches``: the deliveries are
    fed to the index in that many batches, in order of ``delivery_id``.

    Null identifiers identify nothing: such rows are never surplus by them. Rows with a null ``delivery_id`` are
    ignored. An empty table gives no rows. Extra columns are ignored. The deliveries of an identifier with more than
    ``per_task`` of them are cut into parts of about so many in the join back; ``per_task`` is raised where more than a
    million identifiers would be such, so their list is broadcast.
    """
    spark = updates.sparkSession
    keys = saved(identifiers(updates), "identifiers")
    stat = keys.agg(F.count("*").alias("n"), F.min("delivery_id").alias("lo"), F.max("delivery_id").alias("hi")).first()
    if not stat["n"]:
        return updates.select("delivery_id").limit(0)
    cuts = [stat["lo"] + (stat["hi"] + 1 - stat["lo"]) * k // batches for k in range(batches + 1)]
    index = IdentifierIndex(spark, per_prefix=per_prefix, fan=3)
    owners = None
    for lo, hi in zip(cuts, cuts[1:]):
        got = index.add(keys.where(F.col("delivery_id").between(lo, hi - 1)))
        owners = got if owners is None else owners.unionByName(got)
    owners = owners.groupBy(*KEY).agg(F.min("owner").alias("owner"))
    limit = max(per_task, stat["n"] // 1_000_000)
    hot = keys.groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY, F.ceil(F.col("count") / limit).cast("int").alias("salts"))
    hot = F.broadcast(saved(hot, "hot"))
    salted = keys.join(hot, KEY, "left").withColumn("salt", F.pmod(F.xxhash64("delivery_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = owners.join(hot, KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    per_row = saved(salted.join(spread, [*KEY, "salt"]).groupBy("delivery_id").agg(F.min("owner").alias("low"), F.max("owner").alias("high")), "row_owners")
    # A row that owns one of its identifiers and not the other links the two owners, one of them itself.
    links = per_row.select(F.col("low").alias("a"), F.col("high").alias("b")).where("a <> b")
    classes = contract(links.distinct(), per_task=per_task)
    of = per_row.join(classes, per_row["low"] == classes["node"], "left")
    return of.where(F.coalesce("label", "low") < F.col("delivery_id")).select("delivery_id")

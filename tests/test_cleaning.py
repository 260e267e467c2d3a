"""Duplicate deliveries and orphan references against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellumflow.operators.dedup import IdentifierIndex, _with_lowest, contract, identifiers, surplus_deliveries
from vellumflow.operators.orphans import link_name, orphan_references

UPDATES = "delivery_id long, vault_id long, update_id long, update_kind string, chat_id long, message_id long, h string, prefix int"


def brute(rows):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for d, v, u, k, c, m, *_ in rows:
        for key in [("u", v, u) if None not in (v, u) else None, ("m", c, m) if k == "message" and None not in (c, m) else None]:
            if key is not None:
                a, b = find(first.setdefault(key, d)), find(d)
                root[max(a, b)] = min(a, b)
    return {d for d in root if find(d) != d}


def test_surplus_against_union_find(spark):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(i, some(2), some(60), rng.choice(["message", "callback_query", None]), some(3), some(40), "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, UPDATES)
    assert {r[0] for r in surplus_deliveries(df, batches=6, per_prefix=20).collect()} == brute(rows)


def test_long_chain_and_hot_identifier(spark):
    # every delivery shares one number with the next: one class
    chain = [(i, 1, i // 2, "message", 1, (i + 1) // 2, "x", 1) for i in range(60)]
    hot = [(1000 + i, 2, 7, "message", 2, i, "x", 1) for i in range(3000)]
    rows = chain + hot
    got = {r[0] for r in surplus_deliveries(spark.createDataFrame(rows, UPDATES)).collect()}
    assert got == brute(rows) == {*range(1, 60), *range(1001, 4000)}


def test_no_deliveries(spark):
    assert surplus_deliveries(spark.createDataFrame([], UPDATES)).count() == 0
    assert surplus_deliveries(spark.createDataFrame([(1, None, None, None, None, None, "", 0)], UPDATES)).count() == 0


def test_index_over_batches(spark, tmp_path):
    df = identifiers(spark.createDataFrame([(i, 1, i % 5, "message", None, None, "x", 1) for i in range(20)], UPDATES))
    index = IdentifierIndex(spark, str(tmp_path / "index"), fan=2)
    novel = [index.add(df.where(F.col("delivery_id").between(a, a + 2))).where("novel").count() for a in range(0, 18, 3)]
    assert novel == [3, 2, 0, 0, 0, 0] and len(index.runs()) == 1


def test_index_lives_on_and_rewrites_little(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, 1, rng.randrange(900), "message", 1, rng.randrange(500), "x", 1) for i in range(600)]
    df = identifiers(spark.createDataFrame(rows, UPDATES))
    seen, written, adds = {}, 0, 6
    for n in range(adds):
        index = IdentifierIndex(spark, str(tmp_path / "index"), per_prefix=40, fan=2)  # opened anew each time
        part = df.where(F.col("delivery_id").between(n * 100, n * 100 + 99))
        got = {(r.kind, r.scope, r.id): (r.owner, r.novel) for r in index.add(part).collect()}
        own = {}
        for r in part.collect():
            own[r.kind, r.scope, r.id] = min(r.delivery_id, own.get((r.kind, r.scope, r.id), r.delivery_id))
        assert got == {k: (seen.get(k, d), k not in seen) for k, d in own.items()}
        for k, d in own.items():
            seen.setdefault(k, d)
        written += index.written
        assert max([sum(r[2] == level for r in index.runs()) for level in range(4)]) < 2
    assert written <= 4 * len(seen)  # once new, once per level: three levels of two for six batches


def test_hot_identifier_is_spread_over_tasks(spark):
    rows = [(i, 1, 7 if i % 10 else i, "message", 1, i, "x", 1) for i in range(20_000)]
    df = spark.createDataFrame(rows, UPDATES)
    got = {r[0] for r in surplus_deliveries(df, per_task=500).collect()}
    assert got == brute(rows)
    # the links of the hub: no part of the join has more than a few times the limit
    hub = spark.range(1, 20_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).union(spark.range(1, 20_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")))
    joined = _with_lowest(hub, 500)
    assert joined.count() == 2 * 19_999 and joined.agg(F.max("m")).first()[0] == 0
    sizes = hub.where("u = 0").groupBy(F.pmod(F.xxhash64("v"), F.lit(40))).count().agg(F.max("count"), F.percentile("count", 0.5)).first()
    assert sizes[0] < 2 * sizes[1]


def test_contract(spark):
    got = contract(spark.createDataFrame([(9, 8), (8, 7), (7, 3), (5, 5), (20, 21)], "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(9, 3), (8, 3), (7, 3), (21, 20)}


T0 = datetime(2025, 1, 1)


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    at = lambda: T0 + timedelta(hours=rng.randrange(40))
    parents = [(rng.choice([1, 2, None]), rng.choice("abcd"), rng.choice([at(), at(), None]), rng.choice([None, at()])) for _ in range(40)]
    refs = [(rng.choice([1, 2, None]), rng.choice("abcde"), rng.choice([at(), at(), at(), None]), i, "z") for i in range(200)]
    got = orphan_references(spark.createDataFrame(refs, "scope int, name string, at timestamp, k int, salt string"), spark.createDataFrame(parents, "scope int, name string, since timestamp, until timestamp"))
    want = {}
    for scope, name, when, k, _ in refs:
        own = [p for p in parents if scope is not None and p[:2] == (scope, name) and p[2] is not None]
        begun = [p for p in own if when is not None and p[2] <= when]
        if not any(p[3] is None or p[3] > when for p in begun):
            want[k] = "deleted" if begun else "late" if own else "missing"
    assert {r["k"]: r["why"] for r in got.collect()} == want


def test_hot_name_is_salted_whole(spark):
    refs = spark.range(5000).select(F.lit(1).alias("scope"), F.lit("hot").alias("name"), F.lit("2025-01-02").cast("timestamp").alias("at"), "id")
    parents = spark.createDataFrame([(1, "hot", datetime(2025, 1, 3), None)], "scope int, name string, since timestamp, until timestamp")
    assert orphan_references(refs, parents, per_task=300).groupBy("why").count().collect() == [("late", 5000)]
    assert orphan_references(refs, parents.limit(0)).count() == 5000 and orphan_references(refs.limit(0), parents).count() == 0


def test_link_names(spark):
    links = ["[[A|b]]", " [[Dir/Sub/ Note.md #h]] ", "#only", "x.MD", "[[open", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in links], "l string").select(link_name(F.col("l"))).collect()]
    assert got == ["a", "note", "", "x", "[[open", "", None]

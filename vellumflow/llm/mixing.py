"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources one text occurs in). Between patterns and sources
runs a flow of tokens: a pattern offers its tokens once per round, every further round at a higher cost (convex
repetition costs), and each source takes its quota. The network has one node per pattern and source, so its size depends
on the number of sources and not on the documents. The total is the largest for which every source that occurs reaches
its share. Documents are then taken in seeded order up to what the flow grants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved


def source_name(c: Column) -> Column:
    """One spelling of a source: case, spaces and separators don't count."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^[\s_\-]+|[\s_\-]+$", ""), r"(?U)[\s_\-]+", "_"), F.lit(""))


def largest_total(patterns: dict[frozenset[str], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """Largest total for which all sources that occur can reach their quotas together.

    A total is tried on the flow network; where it doesn't fit, the minimum cut names the sources that ask for more than
    their patterns offer, and the total that just fits these is tried next. Every try rules out one more set of sources.
    """
    room = {p: t * min(repeats[s] for s in p) for p, t in patterns.items()}
    there = [s for s in shares if shares[s] > 0 and any(s in p for p in patterns)]
    if not there:
        return 0
    fits = lambda group: sum(r for p, r in room.items() if not p.isdisjoint(group)) / sum(shares[s] for s in group)
    total = min([fits(there), *(fits([s]) for s in there)])
    while True:
        lacking = _unserved(room, {s: total * shares[s] for s in there})
        lower = fits(lacking) if lacking else total
        if not lacking or lower >= total * (1 - 1e-12):
            return int(total)
        total = lower


def _unserved(room: dict[frozenset[str], int], quotas: dict[str, float]) -> list[str]:
    """Sources on the far side of the minimum cut if the quotas can't all be met, else none."""
    sent: dict[tuple[frozenset[str], str], float] = {}
    left, open_ = dict(room), dict(quotas)
    small = 1e-9 * max(1.0, sum(quotas.values()))
    of = {s: [p for p in room if s in p] for s in quotas}
    while True:
        # breadth first from patterns with room over sources, back over what they already take from other patterns
        came: dict = {p: None for p in room if left[p] > small}
        queue, end = list(came), None
        for node in queue:
            if isinstance(node, frozenset):
                steps = [s for s in quotas if s in node and s not in came]
            else:
                if open_[node] > small:
                    end = node
                    break
                steps = [p for p in of[node] if p not in came and sent.get((p, node), 0) > small]
            for step in steps:
                came[step] = node
                queue.append(step)
        if end is None:
            unmet = sum(x for x in open_.values() if x > small)
            return [s for s in quotas if s not in came] if unmet > small else []
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        push = min([left[path[0]], open_[end], *(sent[path[n + 1], path[n]] for n in range(1, len(path) - 1, 2))])
        left[path[0]] -= push
        open_[end] -= push
        for n in range(len(path) - 1):
            if n % 2 == 0:
                sent[path[n], path[n + 1]] = sent.get((path[n], path[n + 1]), 0) + push
            else:
                sent[path[n + 1], path[n]] -= push


def route(patterns: dict[frozenset[str], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[frozenset[str], str], int]:
    """Tokens that each source takes from each pattern at least repetition cost: successive shortest paths."""
    graph: dict = {}

    def edge(a, b, room: int, cost: int) -> None:
        graph.setdefault(a, []).append([b, room, cost, len(graph.setdefault(b, []))])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, tokens in patterns.items():
        for turn in range(min(repeats[s] for s in p)):
            edge("from", p, tokens, turn)
        for s in sorted(p):
            edge(p, s, sum(quotas.values()) + 1, 0)
    for s, quota in quotas.items():
        edge(s, "to", quota, 0)
    graph.setdefault("from", []), graph.setdefault("to", [])
    while True:
        cost, via, queue = {"from": 0}, {}, ["from"]
        while queue:
            a = queue.pop(0)
            for n, (b, room, c, _) in enumerate(graph[a]):
                if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, (a, n)
                    queue.append(b)
        if "to" not in cost:
            break
        path, at = [], "to"
        while at != "from":
            a, n = via[at]
            path.append((a, n))
            at = a
        push = min(graph[a][n][1] for a, n in path)
        for a, n in path:
            b, _, _, back = graph[a][n]
            graph[a][n][1] -= push
            graph[b][back][1] += push
    taken = {}
    for p in patterns:
        for b, _, _, back in graph[p]:
            if b in quotas and (flow := graph[b][back][1]):
                taken[p, b] = flow
    return taken


def mix(docs: DataFrame, targets: list[tuple[str, str, float, int]], seed: int = 42, per_bucket: int = 20_000) -> DataFrame:
    """``(mix_name, source, doc_id, n_tokens, uses)`` of the documents of each mix.

    ``docs (doc_id, sources array<string>, n_tokens)``: one row per text with all sources it occurs in. ``targets``:
    ``(mix_name, source, target_share, max_repeats)``; a short list read on the driver. A document serves any of its
    sources, and all its uses together stay within the least ``max_repeats`` of those of its sources that the mix names.
    The order of documents is that of a seeded hash, those of more than about half a grant behind the others; the last one taken for a source is the one that brings it nearest
    to its quota. Texts without tokens or without a source of the mix are not used. A source that doesn't occur gets
    nothing; the others keep their proportions. Prefix sums run over hash ranges of about ``per_bucket`` documents per
    pattern, then within a range, so no task holds a whole pattern.
    """
    spark = docs.sparkSession
    docs = docs.where("n_tokens > 0 and size(sources) > 0")
    buckets = max(16, docs.count() // per_bucket)
    names = sorted({t[0] for t in targets})
    parts = []
    for name in names:
        wanted = sorted(t[1] for t in targets if t[0] == name)
        pattern = F.array_join(F.array_sort(F.array_intersect("sources", F.array(*map(F.lit, wanted)))), "|")
        parts.append(F.struct(F.lit(name).alias("mix_name"), pattern.alias("pattern")))
    spread = docs.select("doc_id", "n_tokens", F.explode(F.array(*parts)).alias("m")).select("doc_id", "n_tokens", "m.*").where("pattern <> ''")
    spread = spread.withColumn("h", F.xxhash64("mix_name", "doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    spread = spread.withColumn("size_class", F.floor(F.log2(F.col("n_tokens").cast("double"))).cast("int"))
    ranges = saved(spread.groupBy("mix_name", "pattern", "bucket", "size_class").agg(F.sum("n_tokens").cast("long").alias("tokens")), "p7_ranges")
    sums = ranges.groupBy("mix_name", "pattern").agg(F.sum("tokens").alias("tokens")).collect()  # at most 2^sources rows a mix

    grants = []
    for name in names:
        own = [t for t in targets if t[0] == name]
        shares, repeats = {t[1]: t[2] for t in own}, {t[1]: t[3] for t in own}
        patterns = {frozenset(r["pattern"].split("|")): r["tokens"] for r in sums if r["mix_name"] == name}
        total = largest_total(patterns, shares, repeats)
        quotas = {s: int(total * share) for s, share in shares.items()}
        taken = route(patterns, quotas, repeats)
        for p in patterns:
            start = 0
            for s in sorted(p):
                if flow := taken.get((p, s), 0):
                    grants.append((name, "|".join(sorted(p)), s, start, start + flow, patterns[p], -(-(start + flow) // patterns[p])))
                    start += flow
    grants = spark.createDataFrame(grants, "mix_name string, pattern string, source string, lo long, hi long, size long, rounds long")
    # the k-th use of a document stands at k times the pattern's size plus what comes before it in seeded order
    # documents of more than half the least grant of their pattern come last: one of them would miss the quota by much
    least = F.broadcast(grants.groupBy("mix_name", "pattern").agg(F.floor(F.log2(F.min(F.col("hi") - F.col("lo")).cast("double"))).cast("int").alias("least")))
    late = lambda df: df.join(least, ["mix_name", "pattern"]).withColumn("late", F.col("size_class") >= F.col("least")).drop("least", "size_class")
    before = Window.partitionBy("mix_name", "pattern").orderBy("late", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = late(ranges).groupBy("mix_name", "pattern", "late", "bucket").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("mix_name", "pattern", "late", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("mix_name", "pattern", "late", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = late(spread).withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(ranges, ["mix_name", "pattern", "late", "bucket"])
    placed = placed.withColumn("middle", F.col("base") + F.col("inner") + F.floor(F.col("n_tokens") / 2).cast("long"))
    used = placed.join(F.broadcast(grants), ["mix_name", "pattern"])  # at most sources * 2^sources rows a mix
    upto = lambda x: F.greatest(F.lit(0), F.ceil((F.col(x) - F.col("middle")) / F.col("size")))
    used = used.withColumn("uses", (upto("hi") - upto("lo")).cast("int")).where("uses > 0")
    return used.select("mix_name", "source", "doc_id", "n_tokens", "uses")


def mix_shares(mixed: DataFrame, targets: list[tuple[str, str, float, int]]) -> DataFrame:
    """Per mix and source: target and reached share of all tokens, documents, tokens, the most often a document is used, the tokens of the largest one."""
    wanted = mixed.sparkSession.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    got = mixed.groupBy("mix_name", "source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.max("n_tokens").alias("largest")
    )
    all_ = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return wanted.join(got, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("tokens") / all_, F.lit(0.0)).alias("actual_share"), F.coalesce("largest", F.lit(0)).alias("largest"),
    )

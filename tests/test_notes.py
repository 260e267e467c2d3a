"""Retrieval, graph, resolution, tasks, registry, chunks: the behaviour expected of each on small tables."""

import difflib
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumflow.functions.text import lexical_tokens, same_source
from vellumflow.operators import chunking, graph, registry, resolve, retrieval, tasks


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")


def test_bm25_against_formula(spark):
    texts = ["vector search engine", "hybrid search with search ranks", "cooking recipes", "", None, "vector vector vector"]
    queries = spark.createDataFrame([(1, "vector search search"), (2, "unknown"), (3, "")], "qid int, text string")
    got = {(r.qid, r.id): (r.rank, r.score) for r in retrieval.bm25_topk(retrieval.postings(docs(spark, texts)), queries, 4).collect()}
    tokens = [[w for w in (x or "").split() if w not in ("with",)] or ["empty"] for x in texts]
    avg = sum(map(len, tokens)) / len(tokens)

    def score(d):
        total = 0.0
        for term in ["vector", "search", "search"]:
            df = sum(term in x for x in tokens)
            tf = tokens[d].count(term)
            total += math.log((len(tokens) + 1) / df) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(tokens[d]) / avg) + tf))
        return round(total, 9)

    order = sorted(range(len(texts)), key=lambda d: (-score(d), d))[:4]
    assert got == {(1, d + 1): (n, pytest.approx(score(d))) for n, d in enumerate(order, 1)}


def test_kept_index_after_updates_equals_a_new_one(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "none")], "qid int, text string")
    now = {}
    for _ in range(4):
        new = {rng.randrange(30): " ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(8)}
        gone = set(rng.sample(range(30), 3)) - set(new)
        now = {k: v for k, v in now.items() if k not in gone} | new
        index = retrieval.KeptIndex(spark, str(tmp_path / "index"), parts=4, fan=3)
        index.add(spark.createDataFrame(list(new.items()), "id long, text string"), spark.createDataFrame([(g,) for g in gone], "id long"))
        fresh = retrieval.postings(spark.createDataFrame(list(now.items()), "id long, text string"))
        rows = lambda x: sorted(map(tuple, retrieval.bm25_topk(x, queries, 5).select("qid", "rank", "id", "score").collect()))
        assert rows(retrieval.KeptIndex(spark, str(tmp_path / "index"), parts=4)) == rows(fresh)
    assert len(index.segments()) < 3


def test_fusion_boost_and_rerank(spark):
    cols = "qid int, id string, score double, rank int"
    dense = spark.createDataFrame([(1, "docA", 0.9, 1), (1, "docB", 0.8, 2), (1, None, 0.7, 3)], cols)
    sparse = spark.createDataFrame([(1, "docB", 5.0, 1), (1, "docC", 4.0, 2)], cols)
    fused = retrieval.rrf(dense, sparse)
    assert [r.id for r in fused.orderBy("rank").collect()] == ["docB", "docA", "docC"]
    none = F.lit(None).cast("string")
    boosted = retrieval.temporal_boost(fused, F.when(F.col("id") == "docC", "2025-03-09").otherwise(""), F.lit("x.md"), F.lit("2025-03-09"), none)
    assert boosted.where("id = 'docC'").first()["boosted"] == pytest.approx(1.8 / 62)
    top = retrieval.rerank(fused, None, 2)
    assert [r.id for r in top.orderBy("rank").collect()] == ["docB", "docA"]


def test_neighbours_are_appended(spark):
    ranked = spark.createDataFrame([(1, 1, 0.001, 1), (1, 2, 0.0005, 2)], "qid int, id int, score double, rank int")
    titles = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "C")], "id int, title string")
    near = spark.createDataFrame([("A", "C"), ("A", "B")], "title string, neighbour string")
    got = retrieval.expand_with_neighbours(ranked, titles, near).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3, 4]
    assert [r.id for r in retrieval.expand_with_neighbours(ranked, titles, near, resort=True).orderBy("rank").collect()] == [3, 4, 1, 2]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "id int, vector array<float>")
    got = retrieval.dense_topk(v, v.where("id = 1").selectExpr("id as qid", "vector"), 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(5, 1.0), (2, pytest.approx(0.8))]
    vectors = retrieval.hashed_vectors(docs(spark, ["a search", "search engine", ""]), "id", "text", 16).collect()
    assert all(len(r.vector) == 16 for r in vectors) and sum(x * x for x in vectors[1].vector) == pytest.approx(1.0)


def test_threshold_search_has_no_other_bound(spark, tmp_path):
    from vellumflow.plans import notes

    rows = [(i, [1.0, i / 10000], "a") for i in range(1, 1203)] + [(2000, [-1.0, 0.1], "b")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.qid: r.n for r in notes.dense_threshold(spark, str(tmp_path)).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert got == {q: 1201 for q in range(20, 1203, 20)}


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "Notes/other.md", "[[Other]]"), (1, 2, "Notes/Docker Notes.md", "[[Docker Notes]]"), (2, 7, "x/linux.md", "Linux")], "qid int, rank int, path string, title string")
    expected = spark.createDataFrame([(1, "docker notes.md"), (1, "zzz"), (2, "Area/Linux.md"), (3, "nothing")], "qid int, source string")
    got = retrieval.evaluated(results, expected).first()
    assert got == (3, round(1 / 3, 6), round(2 / 3, 6), round((0.5 + 1 / 7) / 3, 6), round(1 / 3, 6))
    rows = spark.createDataFrame([("[[Docker Notes]]", "Notes/docker.md", True), ("Notes/a/b.md", "b", True), ("Area/x.md", "y.md", False)], "g string, w string, ok boolean")
    assert all(r.x == r.ok for r in rows.select("ok", same_source(F.col("g"), F.col("w")).alias("x")).collect())
    assert retrieval.evaluated(results.limit(0), expected.limit(0)).first()[0] == 0


def test_dense_rounds_filters_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3 if i % 9 else 2)] if i % 11 else None, rng.choice(["a", "b", None])) for i in range(300)]
    v = spark.createDataFrame(rows, "id int, vector array<float>, label string")
    q = v.where("id % 7 = 0").selectExpr("id as qid", "vector", "label")
    got = {}
    for r in retrieval.dense_topk(v, q, 4, same=["label"], per_round=10).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 9)
    for i, x, label in rows:
        if i % 7 == 0 and x and any(x) and label:
            near = sorted((-cos(x, y), j) for j, y, other in rows if j != i and other == label and y and any(y) and len(y) == len(x))[:4]
            assert sorted(got.get(i, [])) == [(n, j, pytest.approx(-c)) for n, (c, j) in enumerate(near, 1)]
        else:
            assert i not in got
    assert retrieval.dense_topk(v, q.limit(0)).count() == 0 and retrieval.dense_topk(v.limit(0), q).count() == 0


def test_older_hybrid_search(spark):
    d = docs(spark, ["red apple pie", "red car", "apple tree and red leaves", "", None])
    vectors = retrieval.hashed_vectors(d, "id", "text")
    q = docs(spark, ["red apple"]).withColumnRenamed("id", "qid")
    asked = q.join(retrieval.hashed_vectors(q, "qid", "text").withColumnRenamed("id", "qid"), "qid")
    got = [r.id for r in retrieval.matched_hybrid(vectors, asked, d, 3).orderBy("rank").collect()]
    assert got[:2] == [1, 3]


NOTES = [(1, "Alpha", ["A1", "First"], ["Beta", "gamma", "Nowhere", "[[Beta|b]]"], 1), (1, "Beta", None, ["first#x"], 2), (1, "Gamma", [], None, 3), (2, "Alpha", [], ["Beta"], 4), (1, None, [], ["Alpha"], 5)]


def test_graph(spark):
    nodes = spark.createDataFrame(NOTES, "scope int, title string, aliases array<string>, links array<string>, order int")
    edges = graph.edges(nodes)
    assert {tuple(r) for r in edges.collect()} == {(1, "Alpha", "Beta"), (1, "Alpha", "Gamma"), (1, "Beta", "Alpha")}
    near = {(r.title, r.neighbour) for r in graph.neighbours(edges).collect()}
    assert near == {("Alpha", "Beta"), ("Alpha", "Gamma"), ("Beta", "Alpha"), ("Gamma", "Alpha")}
    seeds = spark.createDataFrame([(1, "Beta")], "scope int, title string")
    assert {r.neighbour for r in graph.neighbours(edges, seeds, hops=2).collect()} == {"Alpha", "Gamma"}
    assert {r.title for r in graph.expand(seeds, edges).collect()} == {"Alpha", "Beta"}
    assert graph.drop_notes(edges, seeds).count() == 1
    back = {r.title: (r.n_backlinks, r.n_links) for r in graph.backlinks(edges).collect()}
    assert back == {"Alpha": (1, 2), "Beta": (1, 1), "Gamma": (1, 0)}
    assert graph.edges(nodes.limit(0)).count() == 0


def test_graph_update_equals_a_new_graph(spark):
    rng = random.Random(4)
    names = [f"N{i}" for i in range(12)]
    make = lambda: [(1, n, rng.sample(["x", "y", "z", "n1"], 2), rng.sample([*names, "x", "y", "none"], 4), i) for i, n in enumerate(names)]
    cols = "scope int, title string, aliases array<string>, links array<string>, order int"
    old = make()
    for gone, new in ((3, 0), (0, 5), (7, 2)):
        nodes = [r for r in old if r[4] != gone] + [(1, "Fresh", ["x"], ["N1", "Fresh"], 20)]
        nodes = [r if r[4] != new else (1, r[1], ["q"], ["N2", "q", "y"], r[4]) for r in nodes]
        changed = spark.createDataFrame([(1, "Fresh"), (1, names[new])] + [(1, names[gone])], "scope int, title string")
        after = graph.update_notes(graph.edges(spark.createDataFrame(old, cols)), spark.createDataFrame(nodes, cols), changed)
        assert sorted(map(tuple, after.collect())) == sorted(map(tuple, graph.edges(spark.createDataFrame(nodes, cols)).collect()))


def test_nodes_of_notes(spark):
    text = "---\naliases:\n  - One\n  - 'Two words'\ntags: A, b\n---\n# H\nsee [[X]] #c ^id1\n## K"
    n = graph.parse_nodes(spark.createDataFrame([("a.md", "a", text), ("b.md", "b", None)], "path string, title string, text string")).orderBy("path").collect()
    assert (n[0].aliases, n[0].tags, n[0].headings, n[0].links, n[0].block_ids) == (["One", "Two words"], ["#a", "#b", "#c"], ["H", "K"], ["X"], ["^id1"])
    assert n[1].aliases == n[1].links == []


def test_resolution(spark):
    notes = spark.createDataFrame([(1, x) for x in ["Distributed Systems", "Database Notes", "Local AI Architecture"]], "scope int, title string")
    aliases = spark.createDataFrame([(1, "ds", "Distributed Systems")], "scope int, alias string, title string")
    terms = spark.createDataFrame([(1, x) for x in ["Distributed Systems", "distributed system", "DS", "Database", "Local AI", "Zebra", "", None, "Datbase Notes"]], "scope int, term string")
    got = {r.term: (r.title, r.score) for r in resolve.resolve_terms(terms, notes, aliases).collect()}
    assert got["Distributed Systems"] == ("Distributed Systems", 1.0) and got["DS"] == ("Distributed Systems", 0.95)
    assert got["distributed system"] == ("Distributed Systems", 0.9) and got["Database"][0] == "Database Notes" and got["Zebra"][0] is None
    assert got["Local AI"] == ("Local AI Architecture", pytest.approx(0.7 + 0.2 * 2 / 3, abs=1e-6))
    assert got["Datbase Notes"][1] == pytest.approx(difflib.SequenceMatcher(None, "datbase notes", "database notes").ratio(), abs=1e-6)
    link = spark.range(1).select(resolve.safe_link(F.lit("ds"), F.lit("Distributed Systems")).alias("x")).first().x
    assert link == "[[Distributed Systems|ds]]"


def test_terms_without_a_shared_word_meet_all_titles(spark):
    names = ["Cobalt Frameework", "falcon hydroponcs", "Systems", "Tools guide", "!!"]
    asked = ["Canyon Framework", "Basalt Hydroponics", "System", "Tool concepts", "qqq", "??", "zzqz"]
    notes = spark.createDataFrame([(1, x) for x in names] + [(2, "Canyon Frame")], "scope int, title string")
    terms = spark.createDataFrame([(1, x) for x in asked] + [(3, "System")], "scope int, term string")
    got = {(r.scope, r.term): (r.title, r.score) for r in resolve.resolve_terms(terms, notes).collect()}
    for term in asked:
        stem = {"System": "Systems", "Tool concepts": "Tools guide"}.get(term)
        best = max(difflib.SequenceMatcher(None, term.lower(), x.lower()).ratio() for x in names)
        title = stem or next(x for x in sorted(names) if difflib.SequenceMatcher(None, term.lower(), x.lower()).ratio() == best)
        score = 0.9 if stem else best
        assert got[1, term] == (title if score >= 0.65 else None, pytest.approx(score, abs=1e-6)), term
    assert got[1, "Canyon Framework"][0] == "Cobalt Frameework" and got[1, "Basalt Hydroponics"][0] == "falcon hydroponcs" and got[3, "System"] == (None, 0.0)
    lonely, titles = terms.where("scope = 1"), notes.select("scope", "title")
    best = lambda most: resolve._without_shared_word(lonely, titles, True, most).where("term = 'Canyon Framework'").agg(F.max(F.struct("score", "title"))).first()
    assert best((200, 4000)) == best((2, 2))


def test_duplicate_titles(spark):
    t = spark.createDataFrame([(1, x) for x in ["Local AI", "Local AI Architecture", "Cooking Recipes", "Local AI", None]], "scope int, title string")
    got = resolve.duplicate_titles(t).collect()
    assert [(r.note_a, r.note_b) for r in got] == [("Local AI", "Local AI Architecture")]


def test_look_up(spark):
    notes = spark.createDataFrame([(1, "Notes/AWS Architecture and Costs.md", "AWS Architecture and Costs", 0), (1, "Daily Notes/2026-08-15.md", "2026-08-15", 1), (1, "Notes/a_b.md", "a_b", 0)], "scope int, path string, stem string, dir_rank int")
    names = ["aws architecture and costs", "AWS Arch", "Costs", "2026-08-15", "zzz", None, "tecture an", "st", "2026-08-15 more", "a:b", "", "8"]
    asked = spark.createDataFrame([(i, 1, n) for i, n in enumerate(names, 1)] + [(99, 2, "Costs")], "qid int, scope int, name string")
    assert {r.qid: r.match for r in resolve.look_up(asked, notes).collect()} == {1: 2, 2: 3, 3: 4, 4: 1, 7: 4, 8: 4, 9: 3, 10: 1, 12: 4}


def test_within_against_all_pairs(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(n)))
    texts, parts = [(i, i % 2, text(30)) for i in range(80)], [(i, i % 3, text(7)) for i in range(60)]
    got = resolve.within(spark.createDataFrame(parts, "qid int, scope int, part string"), spark.createDataFrame(texts, "tid int, scope int, text string"))
    assert {(r.qid, r.tid) for r in got.collect()} == {(q, t) for q, s, p in parts for t, o, x in texts if s == o and p and p in x}


def test_runs_and_notes_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "a/Estimate.md", "Estimate", 0), (1, "b/Meeting.md", "Meeting", 1)], "scope int, path string, stem string, dir_rank int").write.parquet(f"{tmp_path}/notes")
    spark.createDataFrame([(1, 1, "estimate"), (2, 1, "eetin"), (3, 1, "Meeting v2")], "qid int, scope int, name string").write.parquet(f"{tmp_path}/asked")
    notes, asked = spark.read.parquet(f"{tmp_path}/notes"), spark.read.parquet(f"{tmp_path}/asked")  # tables of files have a known size
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 50))  # the planner takes runs to be as small as their texts
    try:
        found = resolve.look_up(asked, notes)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.qid: r.match for r in found.collect()} == {1: 2, 2: 4, 3: 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks(spark):
    text = "# Day\n## 🎯 Priorities & Tasks\n- [ ] first 📅 2026-08-20 ^t1\n* [x] done\n+ [ ] second"
    notes = spark.createDataFrame([(1, "Daily Notes/2026-08-21.md", text), (1, "Notes/x.md", None)], "scope int, path string, text string")
    found = tasks.extract_tasks(notes, "scope", F.col("path"), F.col("text"))
    today = F.lit("2026-08-21").cast("date")
    assert {r.task_text: r.bucket for r in tasks.bucketed(found, today).collect()} == {"first": "overdue", "second": "today"}
    assert {r.task_text: r.section for r in tasks.briefing(found, today).collect()} == {"first": "overdue", "second": "today"}
    asked = spark.createDataFrame([(1, 1, "t1", None), (2, 1, None, "SECOND"), (3, 1, "zz", None), (4, 1, None, None), (5, 2, None, None)], "rid int, scope int, id string, pattern string")
    assert {r.rid: r.line_number for r in tasks.pick_task(found, asked).collect()} == {1: 2, 2: 4, 4: 2}
    days = spark.createDataFrame([(1, f"Daily Notes/2026-08-{d:02d}.md", "- [ ] x\n- [ ] y") for d in (3, 21, 9)] + [(1, "Notes/a.md", "- [ ] x")], "scope int, path string, text string")
    picked = tasks.pick_task(tasks.extract_tasks(days, "scope", F.col("path"), F.col("text")), spark.createDataFrame([(1, 1, None, "x"), (2, 1, None, "Y")], asked.schema)).collect()
    assert {(r.rid, r.path, r.line_number) for r in picked} == {(1, "Daily Notes/2026-08-21.md", 0), (2, "Daily Notes/2026-08-21.md", 1)}
    many = spark.createDataFrame([(1, "Daily Notes/2026-08-20.md", "\n".join(["- [ ] late 📅 2026-08-01"] * 12 + ["- [ ] now 📅 2026-08-21"] * 2 + ["- [ ] soon 📅 2026-08-22"] * 9))], "scope int, path string, text string")
    report = tasks.pending_report(tasks.extract_tasks(many, "scope", F.col("path"), F.col("text")), today, "scope").collect()
    assert {r.bucket: (r.n_tasks, r.n_buttons) for r in report} == {"overdue": (12, 12), "today": (2, 2), "next2": (9, 1)}
    ticked = notes.where("text is not null").select(tasks.complete(F.col("text"), F.lit(2)).alias("x")).first().x
    assert "- [x] first" in ticked and "+ [ ] second" in ticked
    added = notes.where("text is not null").select(tasks.insert_under(F.col("text"), F.lit("## 🎯 Priorities & Tasks"), F.lit("- [ ] new")).alias("a"), tasks.insert_under(F.col("text"), F.lit("## Log"), F.lit("- x")).alias("b")).first()
    assert added.a.rstrip().endswith("+ [ ] second\n- [ ] new") and added.b.endswith("## Log\n- x\n")


def test_registry(spark):
    cols = "path string, hash string, model string"
    old = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "1", "old"), ("gone", "1", "m")], cols)
    now = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", "1", "m"), ("new", "1", "m")], cols)
    states = registry.diff(now, old)
    assert {tuple(r) for r in states.collect()} == {("a", "fresh"), ("b", "changed"), ("c", "outdated"), ("new", "new"), ("gone", "deleted")}
    after = registry.record(old, now, states)
    assert {r.state for r in registry.diff(now, after).collect()} == {"fresh"}
    chunks = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "path string, n int")
    left = registry.replace_files(chunks, spark.createDataFrame([("b", 0)], "path string, n int"), states.where("state = 'changed'"))
    assert sorted(map(tuple, left.collect())) == [("a", 0), ("b", 0)]
    with pytest.raises(ValueError):
        registry.guard_deletions(states, most=0)


def test_legacy_registry(spark, tmp_path):
    for name, text in {"flat": '{"a.md": "abc"}', "new": '{"_metadata": {}, "files": {"a.md": {"content_hash": "abc", "embedding_model": "m", "chunks_count": 3}}}'}.items():
        (tmp_path / name).write_text(text)
    legacy, new = (registry.load_registry(spark, str(tmp_path / n)).first() for n in ("flat", "new"))
    assert (legacy.path, legacy.hash, legacy.model, legacy.embedding_version) == ("a.md", "abc", "legacy", "1.0")
    assert (new.hash, new.model, new.chunks_count) == ("abc", "m", 3)


def test_missing_and_kept_tables(spark, tmp_path):
    assert registry.load_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "broken.json").write_text("{oops")
    assert registry.load_registry(spark, str(tmp_path / "broken.json")).count() == 0
    assert registry.open_table(spark, str(tmp_path / "kept")) is None
    for n in (1, 2):
        registry.save_table(spark.range(n), str(tmp_path / "kept"))
        assert registry.open_table(spark, str(tmp_path / "kept")).count() == n


NOTE = "---\ncreated: 2026-08-15\nmemory_type: fact\n---\n# Docker\nintro [[Linux]] ^b1\n\n## Setup\n```\n# not a heading\n```\n- [ ] try #ops\n\n## Use\ntext"


def test_chunks(spark):
    notes = spark.createDataFrame([("Notes/Docker.md", "Docker", NOTE, datetime(2026, 1, 1)), ("e.md", "e", "---\na: 1\n---\n", datetime(2026, 1, 1)), ("n.md", "n", None, None)], "path string, title string, text string, modified timestamp")
    got = chunking.chunk_notes(notes).orderBy("chunk_index").collect()
    assert [r.heading_path for r in got] == [["Docker"], ["Docker", "Setup"], ["Docker", "Use"]]
    assert got[0].wikilinks == ["Linux"] and got[0].block_ids == ["^b1"] and "# not a heading" in got[1].content and got[1].tags == ["#ops"]
    plain = spark.createDataFrame([("p.md", "p", "just words #x", datetime(2026, 1, 1)), ("t.md", "t", "---\ntags: [A, '#b']\nsource_type: Web\n---\n- [ ] do #b #c", datetime(2026, 1, 1)), ("u.md", "u", "---\ntags:\n  - k/l\n---\nx", None)], "path string, title string, text string, modified timestamp")
    other = {r.path: r for r in chunking.chunk_notes(plain).collect()}
    assert other["p.md"].content == "just words #x" and other["p.md"].tags == ["#x"] and other["p.md"].source_type == "user_authored"
    assert other["t.md"].tags == ["#a", "#b", "#c"] and other["t.md"].source_type == "web" and other["t.md"].memory_type == "task" and other["u.md"].tags == ["#k/l"]
    assert {r.memory_type for r in got} == {"fact"} and {r.created for r in got} == {"2026-08-15"}
    long = "\n".join(["x" * 90] * 20 + [""] + ["y" * 90] * 3)
    assert [len(c[0]) > 1500 for c in chunking.cut_note(long, "t", 1500)] == [True, False]


def test_native_sections_match_the_fold(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["# A", "## B", "### C ", "```", "text", "", "#no", "###### F"]) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in chunking.sections(df, "k", F.col("text"), F.lit("T")).orderBy("k", "section").collect():
        got.setdefault(r.k, []).append(r.heading)
    assert got == {k: h for k, t in enumerate(texts) if (h := [c[1] for c in chunking.cut_note(t, "T", None)])}


def test_tokens_keep_empty_texts(spark):
    assert docs(spark, ["", None]).select(lexical_tokens(F.col("text")).alias("t")).collect() == [([],), ([],)]

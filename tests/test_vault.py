"""A vault on disk: scan, incremental index, search, streams."""

from datetime import datetime, timedelta

import pytest

from vellumflow.engine import NoteEngine
from vellumflow.sources import vault
from vellumflow.streaming.changes import debounce_sessions, debounce_timers, index_changes


@pytest.fixture()
def root(tmp_path):
    files = {
        "Notes/Docker.md": "---\naliases: [Containers]\n---\n# Docker\nContainers run on [[Linux]].\n\n## Tips\nuse compose",
        "Notes/Linux.md": "# Linux\nKernel notes 2026-08-15",
        "Daily Notes/2026-08-15.md": "- [ ] learn [[Docker]] 📅 2026-08-16\n- [x] rest",
        "Root note.md": "Cooking recipes",
        ".obsidian/x.md": "hidden", ".secret/y.md": "hidden", "Notes/.z.md": "hidden", "Notes/image.png": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_scan(spark, root):
    got = {r.path: r.dir_rank for r in vault.scan(spark, str(root)).collect()}
    assert got == {"Notes/Docker.md": 0, "Notes/Linux.md": 0, "Daily Notes/2026-08-15.md": 1, "Root note.md": 2}
    assert [r.title for r in vault.titles(vault.scan(spark, str(root))).collect()] == ["2026-08-15", "Docker", "Linux", "Root note"]


def test_engine(spark, root):
    engine = NoteEngine(spark, str(root))
    first = engine.reindex()
    assert (first["scanned"], first["indexed"], first["skipped"]) == (4, 4, 0)
    again = engine.reindex()
    assert (again["indexed"], again["skipped"], again["total_vault_chunks"]) == (0, 4, first["total_vault_chunks"])
    (root / "Notes/Docker.md").write_text("# Docker\nshort")
    (root / "Root note.md").unlink()
    third = engine.reindex()
    assert (third["indexed"], third["deleted"]) == (1, 1) and third["total_vault_chunks"] == first["total_vault_chunks"] - 2
    questions = spark.createDataFrame([(1, "kernel notes"), (2, " ")], "qid int, text string")
    hits = engine.search(questions, "2026-08-15").orderBy("rank").collect()
    assert "Linux" in {h.title for h in hits} and {h.qid for h in hits} == {1}
    answers = {r.qid: r for r in engine.ask(questions, "2026-08-15").collect()}
    assert "Notes/Linux.md" in answers[1].sources and answers[2].answer.startswith("Nothing")
    assert [r.due_date for r in engine.tasks().collect()] == ["2026-08-16"]
    assert {(r.src, r.dst) for r in engine.edges().collect()} == {("2026-08-15", "Docker")}


def test_a_later_session_goes_on_from_the_store(spark, root, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store"))
    first = NoteEngine(spark, str(root), store=store).reindex()
    again = NoteEngine(spark, str(root), store=store)
    row = again.reindex()
    assert (row["indexed"], row["skipped"]) == (0, 4) and row["total_vault_chunks"] == first["total_vault_chunks"]
    questions = spark.createDataFrame([(1, "kernel notes")], "qid int, text string")
    plain = NoteEngine(spark, str(root))
    plain.reindex()
    order = lambda e: [r.id for r in e.search(questions, "2026-08-15").orderBy("rank").collect()]
    assert order(again) == order(plain)
    (root / "Notes/Linux.md").write_text("# Linux\nkernel kernel notes")
    (root / "Root note.md").unlink()
    again.reindex(), plain.reindex()
    assert order(again) == order(plain)
    assert {(r.title, tuple(r.aliases)) for r in again.nodes().collect()} >= {("Docker", ("Containers",))}


def test_candidates_questions_and_vectors(spark, root, tmp_path):
    assert {r.title for r in vault.candidates(vault.scan(spark, str(root))).collect()} == {"Docker", "Linux", "2026-08-15", "Root note"}
    (tmp_path / "q.json").write_text('[{"id": "1", "question": "what?", "expected_sources": ["a.md", "b"]}]')
    assert vault.read_questions(spark, str(tmp_path / "q.json")).first().expected_sources == ["a.md", "b"]
    assert [r.text for r in vault.readable(spark.createDataFrame([("---\na: 1\n---\n x ",), (None,)], "text string")).collect()] == ["x", None]
    assert vault.open_vectors(spark, str(tmp_path / "none"), 3).count() == 0


def test_index_follows_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "modified", T0, 1), ("b", "modified", T0, 1), ("b", "deleted", T0 + timedelta(seconds=5), 1)], "path string, kind string, fired_at timestamp, n_events long").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, kind string, fired_at timestamp, n_events long").parquet(str(tmp_path / "in"))
    seen = []
    run = index_changes(source, lambda new, gone: seen.append(({r.path for r in new.collect()}, {r.path for r in gone.collect()})), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert seen == [({"a"}, {"b"})]


def test_write_notes(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "x"), ("c.md", None)], "path string, text string")
    vault.write_notes(df, str(tmp_path))
    assert (tmp_path / "a/b.md").read_text() == "x" and (tmp_path / "c.md").read_text() == ""
    with pytest.raises(Exception, match="outside"):
        vault.write_notes(spark.createDataFrame([("../x.md", "x")], "path string, text string"), str(tmp_path))


def test_vectors(spark):
    df = spark.createDataFrame([("a#0", [1.0, 2.0], "t"), ("b", None, "t")], "id string, vector array<float>, text string")
    points = vault.vector_points(df, "id", "vector", "text").collect()
    assert len(points) == 1 and len(points[0].id) == 36
    with pytest.raises(Exception, match="vector length"):
        vault.checked_vectors(df, 3).collect()


T0 = datetime(2026, 1, 1)
EVENTS = [("a", "modified", T0, 1), ("a", "modified", T0 + timedelta(seconds=1), 2), ("a", "modified", T0 + timedelta(seconds=10), 3), ("b", "deleted", T0, 4), ("c", "modified", T0 + timedelta(seconds=100), 5)]
COLS = "path string, kind string, ts timestamp, event_id long"


def test_sessions(spark):
    got = debounce_sessions(spark.createDataFrame(EVENTS, COLS)).orderBy("path", "started").collect()
    assert [(r.path, r.kind, r.n_events) for r in got] == [("a", "modified", 2), ("a", "modified", 1), ("b", "deleted", 1), ("c", "modified", 1)]


def test_timers_in_a_stream(spark, tmp_path):
    spark.createDataFrame(EVENTS, COLS).coalesce(1).write.parquet(str(tmp_path / "in1"))
    spark.createDataFrame([("z", "modified", T0 + timedelta(hours=1), 9)], COLS).coalesce(1).write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(COLS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")).withWatermark("ts", "1 second")
    run = debounce_timers(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("path", "fired_at").collect()
    assert [(r.path, r.kind, r.n_events) for r in got] == [("a", "modified", 2), ("a", "modified", 1), ("b", "deleted", 1), ("c", "modified", 1)]
    assert got[0].fired_at == T0 + timedelta(seconds=3)


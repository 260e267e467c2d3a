"""One object for a vault: index it incrementally, search it, ask it, list its tasks and doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import citation, temporal_filter
from .operators import chunking, graph, registry, resolve, retrieval, tasks
from .session import saved
from .sources import vault

VERSIONS = {"model": "hashed-64", "embedding_version": "1.0", "chunker_version": "1.0", "parser_version": "1.0"}


class NoteEngine:
    """Tables of one vault. ``encode``: batch encoder; without one, hashed token vectors. ``store``: a folder in which the
    registry and the chunks are kept, so that another session goes on from them; without one they end with the session."""

    def __init__(self, spark: SparkSession, root: str, encode: Callable | None = None, store: str | None = None):
        self.spark, self.root, self.encode, self.store = spark, root, encode, store
        self.registry: DataFrame | None = registry.open_table(spark, f"{store}/registry") if store else None
        self.chunks: DataFrame | None = registry.open_table(spark, f"{store}/chunks") if store else None
        if self.registry is None or self.chunks is None:  # one without the other: index anew
            self.registry = self.chunks = None
        self.notes: DataFrame | None = None

    def snapshot(self) -> DataFrame:
        notes = vault.scan(self.spark, self.root)
        for name, value in VERSIONS.items():
            notes = notes.withColumn(name, F.lit(value))
        return notes

    def reindex(self, force: bool = False, guard: bool = True) -> dict[str, int]:
        """Chunk and encode what changed; returns how many files were scanned, indexed, skipped and deleted, and chunks written.
        The registry follows the chunk table, so a failed run is repeated. ``guard``: refuse a snapshot that lost many files."""
        now = saved(self.snapshot(), "notes")
        known = self.registry if self.registry is not None else now.limit(0)
        states = saved(registry.diff(now, known, force), "states")
        if guard:
            registry.guard_deletions(states)
        stale = now.join(states.where(registry.stale(F.col("state"))), "path", "left_semi")
        new = chunking.chunk_notes(stale)
        if self.encode:
            new = retrieval.encode_with(new, "content", self.encode)
        else:
            new = new.join(retrieval.hashed_vectors(new, "id", "content"), "id", "left")
        new = saved(new, "chunks")
        touched = states.where("state <> 'fresh'")
        old = self.chunks
        self.chunks = new if self.chunks is None else saved(registry.replace_files(self.chunks, new, touched), "chunks")
        self.registry = saved(registry.record(known, now, states), "registry")
        self.notes = now
        if self.store:
            before = self.spark.createDataFrame([], "id string") if old is None else old.join(touched.select("path"), "path", "left_semi").select("id")
            retrieval.KeptIndex(self.spark, f"{self.store}/lexical").add(new, before, "id", "content")
        if self.store:  # the chunks first: a run that fails between the two is repeated
            registry.save_table(self.chunks, f"{self.store}/chunks")
            registry.save_table(self.registry, f"{self.store}/registry")
        row = registry.statistics(states).first().asDict()
        return row | {"chunks": new.count(), "total_vault_chunks": self.chunks.count()}

    def nodes(self) -> DataFrame:
        return graph.parse_nodes(self.notes).withColumns({"scope": F.lit(0), "order": F.col("path")})

    def edges(self) -> DataFrame:
        return graph.edges(self.nodes())

    def search(self, questions: DataFrame, as_of: str, top_k: int = 5, expand: bool = True, filters: dict[str, str] | None = None, score=None) -> DataFrame:
        """The whole pipeline for ``questions (qid, text)``: ``(qid, id, path, title, heading, content, rank)``. Blank questions give no rows."""
        questions = questions.where("trim(text) <> ''")
        pool = self.chunks
        for column, value in (filters or {}).items():
            pool = pool.where(F.col(column) == value)
        asked = retrieval.hashed_vectors(questions, "qid", "text").withColumnRenamed("id", "qid") if not self.encode else retrieval.encode_with(questions, "text", self.encode).select("qid", "vector")
        numbered = pool.select("id", "vector", "content", "title", "path", "created")
        dense = retrieval.dense_topk(numbered.select("id", "vector"), asked, skip_self=False)
        kept = retrieval.KeptIndex(self.spark, f"{self.store}/lexical") if self.store and not filters else retrieval.postings(numbered, "id", "content")
        sparse = retrieval.bm25_topk(kept, questions)
        fused = retrieval.rrf(dense, sparse).join(numbered.select("id", "path", "created"), "id")
        when = questions.select("qid", temporal_filter(F.col("text"), F.lit(as_of).cast("date")).alias("when"))
        boosted = retrieval.temporal_boost(fused.join(when, "qid"), F.col("created"), F.col("path"), F.col("when.date"), F.col("when.month"))
        result = boosted.select("qid", "id", F.col("boosted").alias("score"), "rank")
        if expand:
            near = graph.neighbours(self.edges()).select("title", "neighbour")
            result = retrieval.expand_with_neighbours(result, numbered.select("id", "title"), near).select("qid", "id", "rank")
        result = result.where("rank <= 10").join(self.chunks.select("id", "path", "title", "heading", "content", "block_ids"), "id")
        if score is not None:
            result = result.join(questions.withColumnRenamed("text", "question"), "qid")
        return retrieval.rerank(result, score, top_k)

    def ask(self, questions: DataFrame, as_of: str, answer: Callable | None = None, top_k: int = 5) -> DataFrame:
        """``(qid, answer, sources, citations)``: the context of each question, an injected answer column function, and citations."""
        hits = self.search(questions, as_of, top_k).withColumn("cite", citation(F.col("title"), F.col("heading"), F.get("block_ids", F.lit(0))))
        gathered = F.array_sort(F.collect_list(F.struct("rank", "path", "cite", "content")))  # top_k rows a question
        out = hits.groupBy("qid").agg(gathered.alias("x")).join(questions, "qid", "right")
        context = F.array_join(F.col("x.content"), "\n\n")
        said = answer(F.col("text"), context) if answer else F.when(F.size("x") > 0, context).otherwise(F.lit("Nothing about this was found in the notes."))
        return out.select("qid", said.alias("answer"), F.array_distinct("x.path").alias("sources"), F.array_distinct("x.cite").alias("citations"))

    def tasks(self, include_completed: bool = False) -> DataFrame:
        found = tasks.extract_tasks(self.notes, "title", F.col("path"), F.col("text"))
        return found if include_completed else found.where("not completed")

    def duplicates(self) -> DataFrame:
        return resolve.duplicate_titles(self.notes.select(F.lit(0).alias("scope"), "title"))

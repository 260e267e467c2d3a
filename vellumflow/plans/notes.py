"""Queries over the note tables: parsing, retrieval, graph, tasks, index upkeep, resolution, evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.python_udfs import yaml_fields
from ..operators import chunking, graph, ingest, registry, resolve, retrieval, tasks
from ..session import table, working_path
from . import notes_sql

#: The day that reports are made for.
TODAY = "2026-05-01"


def today():
    return F.lit(TODAY).cast("date")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "markdown_chunks")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "interstitial_entries")


# --- text functions ---------------------------------------------------------------------------------------------------


def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_no", F.posexplode(t.wikilinks(F.col("content"))).alias("pos", "link"))


def loose_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of documents after the Markdown was normalised."""
    return _documents(spark, sf).select("doc_id", F.explode(t.links_of_loose_text(F.col("text"))).alias("link")).groupBy("doc_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_targets"))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags in the text of chunks."""
    return _chunks(spark, sf).select("chunk_no", F.explode(t.tags(F.col("content"))).alias("tag"))


def frontmatter_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags in the frontmatter of documents, in one form."""
    fields = _documents(spark, sf).select("doc_id", yaml_fields(t.frontmatter_block(F.col("text"))).alias("fields"))
    return fields.select("doc_id", F.explode(t.as_tags(t.listed(F.element_at("fields", "tags")))).alias("tag"))


def tag_names(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of notes as they would be file names and buttons."""
    return table(spark, sf, "note_nodes").select("node_no", t.safe_file_name(F.col("title")).alias("file"), t.button_text(F.concat(F.lit("[["), F.col("rel_path"), F.lit("|"), F.col("title"), F.lit("]] note"))).alias("button"))


def note_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as they are shown for reading: digests of the text without frontmatter and first heading."""
    return _documents(spark, sf).select("doc_id", F.md5(t.view_text(F.col("text"))).alias("digest"))


def atomic_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the notes written from the entries that asked for one of their own."""
    e = _entries(spark, sf).where("atomic_note_title is not null")
    note = t.atomic_note(F.col("atomic_note_title"), F.coalesce("atomic_note_content", F.lit("")), F.coalesce("extracted_tags", F.array().cast("array<string>")), F.col("entry_date"), F.col("entry_date"))
    return e.select("entry_no", t.safe_file_name(F.col("atomic_note_title")).alias("file"), F.md5(note).alias("digest"))


def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents wrapped as a model's answer and taken out again; chatter is told from content."""
    c = F.coalesce(F.col("text"), F.lit(""))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(c.alias("response")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), c, F.lit("\n```"))).otherwise(c)
    return _documents(spark, sf).where("text is null or not text like '%`%'").select("doc_id", F.md5(t.payload_of(wrapped)).alias("digest"), F.coalesce(t.is_chatter(c), F.lit(False)).alias("chatter"))


def dataview_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.explode(t.dataview_fields(F.col("text"))).alias("field", "value"))


def entry_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("entry_no", F.explode("dataview_fields").alias("field", "value"))


def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_no", F.explode(t.block_ids(F.col("content"))).alias("block"))


def headings(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_no", F.posexplode(t.headings(F.col("content"))).alias("pos", "heading"))


def frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a frontmatter block: its ``created`` value and the sizes of block and body."""
    c = F.col("text")
    return _documents(spark, sf).where(t.frontmatter_block(c).isNotNull()).select("doc_id", F.length(t.frontmatter_block(c)).alias("block_chars"), F.length(t.body(c)).alias("body_chars"))


def frontmatter_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the YAML frontmatter."""
    fields = _documents(spark, sf).select("doc_id", yaml_fields(t.frontmatter_block(F.col("text"))).alias("fields"))
    return fields.select("doc_id", F.explode("fields").alias("field", "value"))


def term_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of all note titles and how many titles share each."""
    notes = table(spark, sf, "note_nodes").where("title is not null")
    return notes.select(t.term_stem(F.col("title")).alias("stem"), "title").groupBy("stem").agg(F.countDistinct("title").alias("n_titles"))


def uuid5_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk ids from vault, path and index."""
    name = F.concat_ws("#", "file_path", F.col("chunk_index").cast("string"))
    return _chunks(spark, sf).select("chunk_no", t.uuid5(name).alias("uuid"))


def temporal_intent(spark: SparkSession, sf: str) -> DataFrame:
    """What date or month each chat message asks about."""
    asked = table(spark, sf, "telegram_updates").select("delivery_id", t.temporal_filter(F.col("text"), today()).alias("x"))
    return asked.select("delivery_id", "x.date", "x.month").where("date is not null or month is not null")


def task_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages that sound like tasks, with the due date they name."""
    c = F.col("text")
    return table(spark, sf, "telegram_updates").where(t.sounds_like_task(c)).select("delivery_id", t.due_date(c, today()).alias("due_date"))


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """Where each delivery goes."""
    updates = table(spark, sf, "telegram_updates").select("delivery_id", t.route(F.coalesce("text", "caption"), F.col("callback_data")).alias("route"))
    return updates.groupBy("route").agg(F.count("*").alias("n_updates"))


def section_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).groupBy(t.section_header(F.col("category")).alias("header")).agg(F.count("*").alias("n_entries"))


def _line() -> Column:
    return t.entry_line(F.col("content"), F.col("timestamp"), F.col("category"), F.col("due_date"), F.col("dataview_fields"), F.col("block_id"), F.col("callout_type"), F.col("entry_date"))


def entry_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as the lines of their daily note."""
    return _entries(spark, sf).select("entry_no", t.section_header(F.col("category")).alias("header"), _line().alias("line"))


def daily_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Daily notes put together from their entries: per vault and date the lines of each section, in order of arrival."""
    e = _entries(spark, sf)
    parts = e.select("vault_id", "entry_date", "entry_no", t.section_header(F.col("category")).alias("header"), _line().alias("line")).where("line is not null")
    parts = parts.groupBy("vault_id", "entry_date", "header").agg(F.array_sort(F.collect_list(F.struct("entry_no", "line"))).alias("x"))
    section = F.concat(F.col("header"), F.lit("\n"), F.array_join("x.line", "\n"))
    return parts.groupBy("vault_id", "entry_date").agg(F.array_join(F.array_sort(F.collect_list(section)), "\n\n").alias("body"), F.sum(F.size("x")).alias("n_entries"))


def notes_with_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a line put under a section of the daily note: digests of the new texts."""
    d = _documents(spark, sf).where("text is not null")
    header = F.when(F.col("doc_id") % 2 == 0, F.lit(t.LOG)).otherwise(F.coalesce(F.nullif(F.regexp_extract("text", r"(?md)^(## .*\S)$", 1), F.lit("")), F.lit(t.TASKS)))
    return d.select("doc_id", F.md5(tasks.insert_under(F.col("text"), header, F.concat(F.lit("- filed "), F.col("doc_id").cast("string")))).alias("digest"))


def captured_items(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries as the Markdown text each would be filed with."""
    u = table(spark, sf, "telegram_updates").where("update_kind = 'message'")
    kind = F.when(F.col("voice_file_id").isNotNull(), "voice").when(F.col("audio_file_name").isNotNull(), "document").when(F.col("text").rlike(r"^https?://\S+$"), "url").otherwise("text")
    item = ingest.item_text(kind, F.col("text"), F.col("caption"), F.col("audio_file_name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"))
    return u.select("delivery_id", kind.alias("modality"), item.alias("item"))


def filed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries after task detection, normalisation and extraction."""
    done = ingest.filed_entries(_entries(spark, sf).withColumn("raw_text", F.col("content")), today())
    return done.select("entry_no", "category", "content", "due_date", F.size("extracted_wikilinks").alias("n_links"), "block_id")


def message_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chat messages of at most 4000 characters."""
    parts = _documents(spark, sf).select("doc_id", F.posexplode(t.message_parts(F.col("text"), 4000)).alias("part", "message"))
    return parts.select("doc_id", "part", F.length("message").alias("n_chars"))


def chat_rendering(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks rendered for a chat."""
    return _chunks(spark, sf).select("chunk_no", F.md5(t.chat_html(t.chat_markdown(F.col("content")))).alias("digest"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return c.select("chunk_no", t.citation(F.col("title"), F.col("heading"), F.get("block_ids", F.lit(0))).alias("citation"))


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunk_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into structure-aware chunks."""
    notes = _documents(spark, sf).select(F.col("file_path").alias("path"), F.col("doc_id").cast("string").alias("title"), "text", F.col("created_at").alias("modified"))
    return chunking.chunk_notes(notes).select("id", "path", "chunk_index", "heading", F.length("content").alias("n_chars"), F.size("wikilinks").alias("n_links"), "memory_type")


def sections_native(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sections(_chunks(spark, sf), "chunk_no", F.col("content"), F.col("title"))


# --- retrieval --------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.postings(_documents(spark, sf), "doc_id", "text")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topic_terms").where("term_id % 20 = 0").select(F.col("term_id").alias("qid"), F.col("term").alias("text"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25_topk(_index(spark, sf), _questions(spark, sf), 30)


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_statistics(_index(spark, sf))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical index after the files of one source were taken out: statistics and ranks are those of what is left."""
    docs = _documents(spark, sf)
    gone = docs.where("source = 'web_clip'").select(F.col("file_path").alias("path"))
    left = registry.replace_files(docs.select("doc_id", "text", F.col("file_path").alias("path")), docs.select("doc_id", "text", F.col("file_path").alias("path")).where("doc_id is null"), gone)
    return retrieval.bm25_topk(retrieval.postings(left, "doc_id", "text"), _questions(spark, sf), 10)


def bm25_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The same as :func:`bm25_filtered` over a kept index: all documents, a part of them indexed again, and the files of one source taken out."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "source")
    path = working_path(spark, "lexical")
    retrieval.KeptIndex(spark, path).add(docs.withColumn("text", F.when(F.col("id") % 7 == 0, F.lit("an older text")).otherwise(F.col("text"))))
    index = retrieval.KeptIndex(spark, path)  # as another session would open it
    index.add(docs.where("id % 7 = 0"), docs.where("source = 'web_clip' and id % 7 <> 0"))
    index.add(docs.limit(0), docs.where("source = 'web_clip'"))
    return retrieval.bm25_topk(index, _questions(spark, sf), 10)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("qid"), "vector", "label")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_topk(_vectors(spark, sf), _asked_vectors(spark, sf), 30)


def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_topk(_vectors(spark, sf), _asked_vectors(spark, sf), 10, same=["label"])


def dense_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_topk(_vectors(spark, sf), _asked_vectors(spark, sf), None, threshold=0.3)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth topic as a question, with the vector of its words."""
    q = _questions(spark, sf)
    return q.join(retrieval.hashed_vectors(q, "qid", "text").withColumnRenamed("id", "qid"), "qid")


def _text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hashed_vectors(_documents(spark, sf), "doc_id", "text")


def _hybrid(spark: SparkSession, sf: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical lists of the same questions over the same documents."""
    return retrieval.dense_topk(_text_vectors(spark, sf), _asked(spark, sf), k, skip_self=False), retrieval.bm25_topk(_index(spark, sf), _questions(spark, sf), k)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf(*_hybrid(spark, sf)).drop("dense_rank", "sparse_rank")


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and lexical lists, the lexical side weighing 1.5."""
    return retrieval.rrf(*_hybrid(spark, sf), sparse_weight=1.5).where("rank <= 10").drop("dense_rank", "sparse_rank")


def matched_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The older hybrid search: dense, fused with dense among the documents that have all words of the question."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return retrieval.matched_hybrid(_text_vectors(spark, sf), _asked(spark, sf), docs).select("qid", "id", "rrf_score", "rank")


def _boosted(spark: SparkSession, sf: str) -> DataFrame:
    fused = retrieval.rrf(*_hybrid(spark, sf)).join(_documents(spark, sf).select(F.col("doc_id").alias("id"), "created_at", "file_path"), "id")
    return retrieval.temporal_boost(fused, F.col("created_at").cast("string"), F.col("file_path"), F.lit(None).cast("string"), F.lit("2025-03"))


def temporal_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Fused results with those of one month raised."""
    return _boosted(spark, sf).select("qid", "id", "boosted", "rank")


def _document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, vault, title)``: a document's title is the first note that it links to, else its file's name."""
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.md$", "")
    return _documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("vault_id").alias("vault"), F.coalesce(F.get(t.wikilinks(F.col("text")), F.lit(0)), name).alias("title"))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline: fuse, boost, append neighbours in the graph of notes, cut, rerank, keep 5."""
    docs = _documents(spark, sf)
    boosted = _boosted(spark, sf).select("qid", "id", F.col("boosted").alias("score"), "rank")
    key = lambda scope, title: F.concat_ws("/", F.col(scope).cast("string"), F.col(title))
    titles = _document_titles(spark, sf).select("id", key("vault", "title").alias("title"))
    near = graph.neighbours(graph.edges(_nodes(spark, sf))).select(key("scope", "title").alias("title"), key("scope", "neighbour").alias("neighbour"))
    pool = retrieval.expand_with_neighbours(boosted, titles, near).where("rank <= 10")
    pool = pool.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(_questions(spark, sf).withColumnRenamed("text", "question"), "qid")
    return retrieval.rerank(pool, F.round(retrieval.overlap_score(F.col("question"), F.col("text")), 9)).select("qid", "id", "rerank_score", "rank")


def eval_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval quality of the dense search: a vector of the same label is a right answer. Queries whose label no other vector has don't count."""
    label = _vectors(spark, sf).select("id", "label")
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    asked = _asked_vectors(spark, sf).select("qid", "label").join(sizes.where("n > 1"), "label").select("qid", F.col("label").alias("wanted"))
    found = dense_topk(spark, sf).join(asked, "qid").join(label, "id")
    return retrieval.recall_and_mrr(found.select("qid", "id", "rank", (F.col("label") == F.col("wanted")).alias("hit")), asked)


def eval_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Recall, MRR and citation accuracy of the lexical search: right are the files of documents that name the topic as it is written."""
    docs = _documents(spark, sf)
    best = retrieval.bm25_topk(_index(spark, sf), _questions(spark, sf), 10).join(docs.select(F.col("doc_id").alias("id"), F.col("file_path").alias("path")), "id")
    results = best.select("qid", "rank", "path", F.concat(F.lit("[["), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""), F.lit("]]")).alias("title"))
    named = resolve.mentions(docs.select(F.col("file_path").alias("tid"), F.lower("text").alias("text")), _questions(spark, sf).select("qid", F.lower("text").alias("part")))
    return retrieval.evaluated(results, named.select("qid", F.col("tid").alias("source")))


def qa_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Per question the distinct sources of its best five documents, in order."""
    best = retrieval.bm25_topk(_index(spark, sf), _questions(spark, sf), 5)
    named = best.join(_documents(spark, sf).select(F.col("doc_id").alias("id"), "file_path"), "id")
    first = named.groupBy("qid", "file_path").agg(F.min("rank").alias("rank"))
    return first.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]), "\n").alias("sources"))


# --- graph ------------------------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "note_nodes").where("deleted_at is null").select(F.col("vault_id").alias("scope"), "title", "aliases", F.col("outgoing_links").alias("links"), F.col("node_no").alias("order"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(_nodes(spark, sf))


def graph_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    return graph.backlinks(graph_edges(spark, sf))


def graph_neighbors_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(graph_edges(spark, sf))


def graph_neighbors_2hop(spark: SparkSession, sf: str) -> DataFrame:
    """Notes up to two links away from every twentieth note."""
    seeds = table(spark, sf, "note_nodes").where("node_no % 20 = 0").select(F.col("vault_id").alias("scope"), "title")
    return graph.neighbours(graph_edges(spark, sf), seeds, hops=2)


def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "note_nodes").where("node_no % 20 = 0 and title is not null").select(F.col("vault_id").alias("scope"), "title")
    return graph.expand(seeds, graph_edges(spark, sf))


# --- tasks ------------------------------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("Daily Notes/"), F.col("entry_date"), F.lit(".md"))
    return tasks.extract_tasks(_entries(spark, sf), "entry_no", path, F.col("content"))


def tasks_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).select("entry_no", "line_number", "completed", "task_text", "created_date", "due_date", "task_id", "daily_date")


def tasks_all(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of the documents with their priority and block id."""
    out = tasks.extract_tasks(_documents(spark, sf), "doc_id", F.col("file_path"), F.col("text"))
    return out.select("doc_id", "line_number", "completed", "due_date", "priority", "block_id")


def tasks_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.bucketed(_tasks(spark, sf), today()).groupBy("bucket").agg(F.count("*").alias("n_tasks"))


def tasks_report(spark: SparkSession, sf: str) -> DataFrame:
    """Open tasks per vault and bucket, and how many of them get a button."""
    path = F.concat(F.lit("Daily Notes/"), F.col("entry_date"), F.lit(".md"))
    return tasks.pending_report(tasks.extract_tasks(_entries(spark, sf), "vault_id", path, F.col("content")), today(), "vault_id")


def tasks_briefing(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.briefing(_tasks(spark, sf), today()).select("entry_no", "line_number", "section")


def _scoped_tasks(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("Daily Notes/"), F.col("entry_date"), F.lit(".md"))
    keyed = _entries(spark, sf).withColumn("key", F.struct("entry_no", F.col("vault_id").alias("scope")))
    return tasks.extract_tasks(keyed, "key", path, F.col("content")).select("key.*", "path", "line_number", "raw_line", "completed", "task_text", "task_id", "block_id")


def mark_task_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The task each "done" button means: its note, line and the line's new text."""
    scoped, none = _scoped_tasks(spark, sf), F.lit(None).cast("string")
    asked = table(spark, sf, "telegram_updates").where("callback_data like 'done:%'").select(F.col("delivery_id").alias("rid"), F.col("vault_id").alias("scope"), F.substring("callback_data", 6, 40).alias("id"), none.alias("pattern"))
    own = scoped.where("not completed").select(F.col("entry_no").alias("rid"), "scope", F.col("task_id").alias("id"), none.alias("pattern"))
    return tasks.pick_task(scoped, asked.unionByName(own))


def mark_task_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """The task that two words of it mean, or any open one where nothing is named."""
    scoped = _scoped_tasks(spark, sf)
    words = F.regexp_extract("task_text", r"(\S+ \S+)$", 1)
    asked = scoped.where("not completed").select(F.col("entry_no").alias("rid"), "scope", F.lit(None).cast("string").alias("id"), F.when(F.col("entry_no") % 5 != 0, F.upper(words)).alias("pattern"))
    return tasks.pick_task(scoped, asked)


# --- index upkeep -----------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: some edited, some added, some gone, some indexed by an older model."""
    d = _documents(spark, sf).select("doc_id", F.col("file_path").alias("path"), "text")
    now = d.where("doc_id % 13 <> 0").select("path", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.coalesce("text", F.lit("")))).alias("hash"), F.lit("current").alias("model"))
    old = d.where("doc_id % 11 <> 0").select("path", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.when(F.col("doc_id") % 17 == 0, "legacy").otherwise("current").alias("model"))
    return now, old


def registry_diff(spark: SparkSession, sf: str) -> DataFrame:
    return registry.diff(*_snapshots(spark, sf))


def registry_stats(spark: SparkSession, sf: str) -> DataFrame:
    return registry.statistics(registry_diff(spark, sf))


def registry_after(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _snapshots(spark, sf)
    return registry.record(old, now, registry.diff(now, old))


def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table as its first index run left it, with the rows that later runs wrote again in their place."""
    run = F.struct("indexed_at", "chunk_no")
    c = _chunks(spark, sf).groupBy("id").agg(F.min_by("chunk_no", run).alias("first"), F.max_by("chunk_no", run).alias("last"))
    return registry.upsert(c.select("id", F.col("first").alias("chunk_no")), c.where("first <> last").select("id", F.col("last").alias("chunk_no")), "id")


# --- resolution -------------------------------------------------------------------------------------------------------


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "note_nodes").where("title is not null").select(F.col("vault_id").alias("scope"), "title")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf)
    return e.select(F.col("vault_id").alias("scope"), F.explode("extracted_wikilinks").alias("term"))


def resolve_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of entries by exact title, title in any case or alias."""
    return resolve.resolve_terms(_terms(spark, sf), _titles(spark, sf), graph.alias_table(_nodes(spark, sf)), threshold=0.95, fuzzy=False).where("title is not null")


def resolve_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_terms(_terms(spark, sf), _titles(spark, sf), graph.alias_table(_nodes(spark, sf)))


def grounded_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf).select("entry_no", F.col("vault_id").alias("scope"), "extracted_wikilinks")
    linked = resolve.ground_links(rows, "entry_no", F.col("extracted_wikilinks"), resolve_fuzzy(spark, sf))
    return linked.select("entry_no", F.array_join("links", "\n").alias("links"))


def note_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The note that each name means: of every twentieth note the title in another case, its aliases, a part of the title and the title with more behind it."""
    n = table(spark, sf, "note_nodes").where("title is not null")
    rank = F.when(F.startswith("rel_path", F.lit("Notes/")), 0).when(F.startswith("rel_path", F.lit("Daily Notes/")), 1).otherwise(2)
    notes = n.select(F.col("vault_id").alias("scope"), F.col("rel_path").alias("path"), F.col("title").alias("stem"), rank.alias("dir_rank"))
    names = F.concat(F.array(F.lower("title"), F.substring("title", 3, 7), F.concat("title", F.lit(" v2"))), F.coalesce("aliases", F.array().cast("array<string>")))
    asked = n.where("node_no % 20 = 0").select("node_no", F.col("vault_id").alias("scope"), F.posexplode(names).alias("pos", "name")).select((F.col("node_no") * 100 + F.col("pos")).alias("qid"), "scope", "name")
    return resolve.look_up(asked, notes)


def dup_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.blocks(_titles(spark, sf))


def dup_subset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.duplicate_titles(_titles(spark, sf), fuzzy=False)


def dup_fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.duplicate_titles(_titles(spark, sf))


def recent_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 notes indexed last (a top-k report)."""
    return table(spark, sf, "note_nodes").orderBy(F.desc("indexed_at"), "node_no").limit(30).select("node_no", "title")


# --- declarative note queries ------------------------------------------------------------------------------------------


def dql_open_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """TASK FROM "Daily Notes" WHERE !completed: open tasks with their note, newest first."""
    return _tasks(spark, sf).where("not completed").orderBy(F.desc("path"), "entry_no", "line_number").select("entry_no", "line_number", "path")


def dql_recent_daily(spark: SparkSession, sf: str) -> DataFrame:
    """TABLE FROM "Daily Notes" SORT file.name DESC LIMIT 7, for each vault."""
    n = table(spark, sf, "note_nodes").where("rel_path like 'Daily Notes/%'").select("vault_id", "file_name").distinct()
    return n.withColumn("n", F.row_number().over(Window.partitionBy("vault_id").orderBy(F.desc("file_name")))).where("n <= 7")


def dql_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """LIST FROM #tag: notes per vault and tag."""
    return table(spark, sf, "note_nodes").select("vault_id", "node_no", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("vault_id", "tag").agg(F.count("*").alias("n_notes"))


def dql_recent_notes(spark: SparkSession, sf: str) -> DataFrame:
    """TABLE created, tags FROM "Notes" SORT file.ctime DESC LIMIT 12, for each vault (a top-k report)."""
    n = table(spark, sf, "note_nodes").where("rel_path like 'Notes/%'")
    return n.withColumn("n", F.row_number().over(Window.partitionBy("vault_id").orderBy(F.desc("indexed_at"), "node_no"))).where("n <= 12").select("vault_id", "n", "node_no", "created", F.array_join("tags", ",").alias("tags"))


def _tagged_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).where(F.array_contains("extracted_tags", "#log") | F.array_contains("extracted_tags", "#field-notes"))


def dql_tagged_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """TASK FROM #tag WHERE file.name = this.file.name AND !completed: open tasks of the tagged entries of each daily note."""
    path = F.concat(F.lit("Daily Notes/"), F.col("entry_date"), F.lit(".md"))
    return tasks.extract_tasks(_tagged_entries(spark, sf), "entry_no", path, F.col("content")).where("not completed").select("entry_no", "daily_date", "line_number", "task_text")


def dql_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    """LIST FROM [[#]]: the notes that link to each note."""
    return graph_edges(spark, sf).select("scope", F.col("dst").alias("title"), F.col("src").alias("linked_from"))


def dql_entries_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """TABLE timestamp, category, content FROM #tag SORT timestamp ASC: tagged entries with their place in their daily note, unknown times last."""
    place = F.row_number().over(Window.partitionBy("vault_id", "entry_date").orderBy(F.asc_nulls_last("timestamp"), "entry_no"))
    return _tagged_entries(spark, sf).select("vault_id", "entry_date", "entry_no", "timestamp", "category", "content", place.alias("place"))


def dql_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """TASK WHERE !due OR due > today + 2 SORT file.mtime DESC: upcoming tasks, in order of their note's last change within each vault."""
    path = F.concat(F.lit("Daily Notes/"), F.col("entry_date"), F.lit(".md"))
    keyed = _entries(spark, sf).withColumn("key", F.struct("entry_no", "vault_id", "received_at"))
    open_ = tasks.bucketed(tasks.extract_tasks(keyed, "key", path, F.col("content")), today()).where("bucket = 'upcoming'")
    return open_.select("key.entry_no", "key.vault_id", "line_number", "due_date", F.date_format("key.received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed")).orderBy("vault_id", F.desc("changed"), "entry_no", "line_number")


def recent_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 documents changed last with the beginning of each (a top-k report)."""
    d = _documents(spark, sf).select(F.col("file_path").alias("path"), F.col("doc_id").cast("string").alias("title"), "text", F.col("created_at").alias("modified"))
    return ingest.recent_excerpts(d)


def node_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes of the graph: numbers of their tags, headings, block ids and links, and their aliases."""
    n = graph.parse_nodes(_documents(spark, sf).select(F.col("doc_id").alias("path"), F.col("file_path").alias("title"), "text"))
    return n.select(F.col("path").alias("doc_id"), F.array_join("tags", ",").alias("tags"), F.size("headings").alias("n_headings"), F.size("block_ids").alias("n_blocks"), F.size("links").alias("n_links"), F.size("aliases").alias("n_aliases"))


def graph_update(spark: SparkSession, sf: str) -> DataFrame:
    """The graph after every third note was left out and then indexed again."""
    nodes = _nodes(spark, sf).where("title is not null")
    changed = nodes.where("order % 3 = 0").select("scope", "title").distinct()
    before = graph.edges(nodes.join(changed, ["scope", "title"], "left_anti"))
    return graph.update_notes(before, nodes, changed)


QUERIES = {
    f.__name__: f
    for f in (
        wikilinks, loose_links, tags, frontmatter_tags, tag_names, note_bodies, atomic_notes, model_answers, notes_with_entry, dataview_fields, entry_fields, block_ids, headings, frontmatter, frontmatter_yaml, term_stems, uuid5_ids, temporal_intent,
        task_sentences, routes, section_headers, entry_lines, daily_notes, captured_items, filed_entries, message_split, chat_rendering, citations, chunk_exact, sections_native, bm25_topk,
        bm25_term_stats, bm25_filtered, bm25_kept, dense_topk, dense_filtered, dense_threshold, rrf_fuse, rrf_weighted, matched_hybrid, temporal_boost, hybrid_topk, eval_recall_mrr, eval_sources, qa_sources, graph_update, node_fields,
        graph_edges, graph_backlinks, graph_neighbors_1hop, graph_neighbors_2hop, graph_expand, tasks_parse, tasks_all, tasks_buckets, tasks_report, tasks_briefing,
        mark_task_pick, mark_task_by_text, registry_diff, registry_stats, registry_after, upsert_chunks, resolve_exact, resolve_fuzzy, grounded_links, note_lookup, dup_blocks,
        dup_subset_pairs, dup_fuzzy_pairs, recent_notes, recent_excerpts, dql_open_tasks, dql_recent_daily, dql_tagged, dql_recent_notes, dql_tagged_tasks, dql_backlinks,
        dql_entries_by_time, dql_backlog,
    )
}
SQL = notes_sql.SQL

"""Lexical and dense retrieval, rank fusion, date boost, graph expansion and reranking, for batches of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, same_source
from ..session import saved

K1, B, DELTA = 1.5, 0.75, 1.0
RRF_K = 60
DATE_BOOST, MONTH_BOOST, NEIGHBOUR_SCORE = 1.8, 1.4, 0.015


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(id, tokens, dl)``: the lexical index; a text without tokens counts as the token ``empty``."""
    tokens = lexical_tokens(F.col(text))
    tokens = F.when(F.size(tokens) == 0, F.array(F.lit("empty"))).otherwise(tokens)
    return docs.select(F.col(key).alias("id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


class KeptIndex:
    """A lexical index in the folder ``path``: opened again by the next session, updated by what changed.

    A segment holds the postings ``(term, id, tf, dl)`` of some documents, partitioned by a hash of the term, their ids and
    lengths, and the ids that it takes out of the segments before it. A search reads only the partitions of its terms.
    ``fan`` segments are merged into one. One writer at a time; a segment gets its name when all its files are there.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, fan: int = 8):
        self.spark, self.path, self.parts, self.fan = spark, path.rstrip("/"), parts, fan

    def _files(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        at, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        found = sorted(n for n in names if n.startswith("segment-"))
        whole = [n for n in found if n.endswith("-merged")]  # a merged segment stands for all up to its number
        return [n for n in found if not whole or n >= whole[-1]]

    def add(self, docs: DataFrame, gone: DataFrame | None = None, key: str = "id", text: str = "text") -> None:
        """Index ``docs`` in place of what the index has of their ids, and take out those of ``gone (id)``."""
        tokens = saved(postings(docs, key, text), "postings")
        names = tokens.select("id")
        self._write(tokens.select("id", "dl"), self._counted(tokens), names if gone is None else names.union(gone.select("id")).distinct(), "")
        if len(self.segments()) >= self.fan:
            self._write(self.documents(), self._all("postings"), names.limit(0), "-merged")

    def _counted(self, tokens: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int")
        return tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).withColumn("part", part)

    def _write(self, documents: DataFrame, terms: DataFrame, gone: DataFrame, end: str) -> None:
        last = self.segments()
        number = int(last[-1].split("-")[1]) + 1 if last else 1
        beside = f"{self.path}/new-{uuid.uuid4().hex}"
        documents.write.parquet(f"{beside}/documents")
        terms.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{beside}/postings")
        gone.write.parquet(f"{beside}/gone")
        _, files = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files.rename(path(beside), path(f"{self.path}/segment-{number:08d}{end}"))
        if end:
            for old in last:
                files.delete(path(f"{self.path}/{old}"), True)

    def _all(self, what: str) -> DataFrame:
        kinds = {"documents": "id {0}, dl int", "postings": "id {0}, dl int, term string, tf long, part int", "gone": "id {0}"}
        names = self.segments()
        if not names:
            return self.spark.createDataFrame([], kinds[what].format("string"))
        kind = self.spark.read.parquet(f"{self.path}/{names[0]}/gone").schema["id"].dataType.simpleString()
        read = lambda n, w: self.spark.read.schema(kinds[w].format(kind)).parquet(f"{self.path}/{n}/{w}")
        out, later = None, None
        for n in reversed(names):
            rows = read(n, what) if later is None else read(n, what).join(later, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
            later = read(n, "gone") if later is None else later.union(read(n, "gone"))
        return out

    def documents(self) -> DataFrame:
        """``(id, dl)`` of all documents."""
        return self._all("documents")

    def hits(self, terms: DataFrame) -> DataFrame:
        """Postings ``(id, dl, term, tf)`` of ``terms (term)``, the words of a batch of questions."""
        numbers = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int")).distinct().collect()]  # at most ``parts``
        return self._all("postings").where(F.col("part").isin(numbers)).join(terms.select("term").distinct(), "term").select("id", "dl", "term", "tf")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, term, qtf)`` of ``queries (qid, text)``; a repeated word counts as often."""
    return queries.select("qid", F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def term_statistics(index: DataFrame) -> DataFrame:
    return index.select("id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def ranked(scores: DataFrame, score: str = "score", tie: str = "id", by: str = "qid") -> Column:
    """Rank from 1 by falling score; equal scores (of copies) fall back on the id."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))


def bm25_topk(index: DataFrame | KeptIndex, queries: DataFrame, k: int = 30) -> DataFrame:
    """``index``: that of :func:`postings`, or a kept one. BM25Plus ``(qid, id, score, rank)`` of the best ``k`` documents per query.

    Only documents with a query term are scored term by term; the share that every document gets from a term (delta)
    is one constant per query, and documents without any of its terms all score that constant, so ``k`` of them, by id,
    are enough to fill up. Query terms are joined before the postings are aggregated. Scores are rounded to 9 digits
    before ranking so that copies tie exactly. A query without known terms gives no row.
    """
    terms = query_terms(queries)
    if isinstance(index, KeptIndex):
        hits, index = index.hits(terms), index.documents()
    else:
        index = saved(index, "postings")  # tokens are made once; statistics, postings and fill-up read them
        hits = index.select("id", "dl", F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    stats = index.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()  # two numbers
    n, average = stats["n"], stats["avgdl"] or 1.0
    hits = saved(hits, "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").select("qid", "term", (F.col("qtf") * F.log((F.lit(n) + 1) / F.col("df"))).alias("w"))
    base = weights.groupBy("qid").agg((F.sum("w") * DELTA).alias("base"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (K1 * (1 - B + B * F.col("dl") / F.lit(average)) + F.col("tf"))
    scored = hits.join(weights, "term").groupBy("qid", "id").agg(F.sum(part).alias("matched"))
    found = scored.join(base, "qid").select("qid", "id", F.round(F.col("base") + F.col("matched"), 9).alias("score"))
    best = found.withColumn("rank", ranked(found)).where(F.col("rank") <= k)
    # a query with fewer than k matches is filled up: of the lowest 2k ids at least k are no matches of it
    spare = [r["id"] for r in index.select("id").orderBy("id").limit(2 * k).collect()]
    few = base.join(best.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < k)
    fill = few.select("qid", "base", F.explode(F.array(*map(F.lit, spare))).alias("id")).join(best.select("qid", "id"), ["qid", "id"], "left_anti")
    both = best.select("qid", "id", "score").unionByName(fill.select("qid", "id", F.round("base", 9).alias("score")))
    return both.withColumn("rank", ranked(both)).where(F.col("rank") <= k).withColumn("score", F.greatest("score", F.lit(0.01)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(
    vectors: DataFrame, queries: DataFrame, k: int | None = 30, same: list[str] | None = None, threshold: float | None = None, skip_self: bool = True, per_round: int = 20_000
) -> DataFrame:
    """Cosine top ``k`` ``(qid, id, score, rank)`` of ``queries (qid, vector)`` among ``vectors (id, vector, ...)``.

    Exact: a stated query set against all rows, in rounds of about ``per_round`` queries. A round's queries are one matrix
    that goes to the tasks; each batch of vectors is multiplied with it once and keeps the best ``k`` of each query, so
    only those are shuffled. ``same``: columns that must be equal on both sides (payload filter). With ``skip_self`` a
    vector is not its own neighbour. Null or zero vectors and other lengths don't rank; nor do null values of ``same``.
    ``k`` None: no bound, for a search by ``threshold`` that returns every vector at or above it. Queries with equal
    ``qid`` count as one query each.
    """
    same = same or []
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast("string").alias(f"q_{c}") for c in same]).where("vector is not null")
    rounds = -(-asked.count() // per_round)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    rows = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast("string").alias(c) for c in same])
    scored = None
    for n in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == n).toPandas()  # about per_round rows
        found = rows.mapInArrow(_scores(part, k, same, threshold, skip_self), kinds)
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = vectors.sparkSession.createDataFrame([], kinds)
    out = scored.withColumn("rank", ranked(scored))
    return out if k is None else out.where(F.col("rank") <= k)


def _scores(asked: pd.DataFrame, k: int | None, same: list[str], threshold: float | None, skip_self: bool) -> Callable:
    """Scores of one round's queries for batches of vectors: per batch the best ``k`` of each query, ties by id."""
    lengths = {}
    for size, part in asked.groupby(asked["vector"].map(len)):
        matrix = np.stack(part["vector"].to_list()).astype(np.float64)
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        there = norms > 0
        if size and there.any():
            lengths[int(size)] = (part["qid"].to_numpy()[there], matrix[there] / norms[there, None], [part[f"q_{c}"].to_numpy()[there] for c in same])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sizes = batch.column(1).value_lengths().to_numpy()
                for size, (qids, matrix, wanted) in lengths.items():
                    mine = batch.take(pa.array(np.flatnonzero(sizes == size)))
                    if not mine.num_rows:
                        continue
                    ids = mine.column(0).to_numpy(zero_copy_only=False)
                    v = mine.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    norms = np.sqrt((v * v).sum(axis=1))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        v = v / norms[:, None]
                    for low in range(0, len(qids), 1024):
                        score = np.round(matrix[low : low + 1024] @ v.T, 9)
                        ok = np.isfinite(score)
                        if skip_self:
                            ok &= qids[low : low + 1024, None] != ids[None, :]
                        for column, want in zip(mine.columns[2:], wanted):
                            have = column.to_numpy(zero_copy_only=False)
                            ok &= (want[low : low + 1024, None] == have[None, :]) & np.array([x is not None for x in have])[None, :]
                        if threshold is not None:
                            ok &= score >= threshold
                        score = np.where(ok, score, -np.inf)
                        if k is not None and score.shape[1] > k:
                            # everything that ties with the k-th stays, so that the rank decides among all of them
                            ok &= score >= np.partition(score, -k, axis=1)[:, -k][:, None]
                        q, n = np.nonzero(ok)
                        yield pa.RecordBatch.from_arrays([pa.array(qids[low + q]), pa.array(ids[n], mine.column(0).type), pa.array(score[q, n])], names=["qid", "id", "score"])

    return run


def hashed_vectors(docs: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """A deterministic stand-in for an encoder: token counts hashed to ``size`` signed dimensions, unit length. No model: for tests and as the default where none is given."""
    digest = lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int")
    slots = F.transform(lexical_tokens(F.col(text)), lambda w: digest(w))
    raw = docs.select(F.col(key).alias("id"), F.transform(slots, lambda h: F.pmod(F.floor(h / 2), F.lit(size)).cast("int") * 2 + h % 2).alias("slots"))
    count = lambda i, sign: F.size(F.filter("slots", lambda s: s == i * 2 + sign))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (count(i, 0) - count(i, 1)).cast("double"))
    raw = raw.withColumn("v", cells).withColumn("n", F.sqrt(dot(F.col("v"), F.col("v"))))
    return raw.select("id", F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0)).cast("float")).alias("vector"))


def encode_with(docs: DataFrame, text: str, encode: Callable, out: str = "vector") -> DataFrame:
    """Vectors by an injected batch encoder ``list[str] -> list[list[float]]``, loaded once per Python worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return docs.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ``(qid, id, rrf_score, dense_score, sparse_score, dense_rank, sparse_rank, rank)``.

    Ties: the better dense rank first, unranked last, then the sparse rank. A missing side counts 0. Null ids are skipped.
    """
    d = dense.where("id is not null").select("qid", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.where("id is not null").select("qid", "id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    one = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = d.join(s, ["qid", "id"], "full_outer").withColumn("rrf_score", F.round(one("dense_rank", dense_weight) + one("sparse_rank", sparse_weight), 12))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    return both.select("qid", "id", "rrf_score", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), "dense_rank", "sparse_rank", F.row_number().over(order).alias("rank"))


def matched_hybrid(vectors: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """The older hybrid search: the dense list fused with the dense list of only those documents that have all words of the
    question, the latter weighing 1.5. ``vectors (id, vector)``, ``queries (qid, vector, text)``, ``docs (id, text)``; twice ``k`` of each list.

    A question without words has no second list. The documents of a question come from an equality join on words.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))
    first = dense_topk(vectors, queries, 2 * k, skip_self=False)
    asked = queries.select("qid", words(F.col("text")).alias("w")).where("size(w) > 0")
    terms = asked.select("qid", F.size("w").alias("n"), F.explode("w").alias("word"))
    has = docs.select("id", F.explode(words(F.col("text"))).alias("word")).join(terms, "word").groupBy("qid", "id").agg(F.count("*").alias("got"), F.first("n").alias("n")).where("got = n")
    both = has.join(vectors.select("id", "vector"), "id").join(queries.select("qid", F.col("vector").alias("asked")), "qid")
    norm = lambda c: F.sqrt(dot(F.col(c).cast("array<double>"), F.col(c).cast("array<double>")))
    score = F.round(dot(F.col("vector"), F.col("asked")) / F.nullif(norm("vector") * norm("asked"), F.lit(0.0)), 9)
    second = both.select("qid", "id", score.alias("score")).where("score is not null")
    second = second.withColumn("rank", ranked(second)).where(F.col("rank") <= 2 * k)
    return rrf(first, second, sparse_weight=1.5).where(F.col("rank") <= k)


def temporal_boost(fused: DataFrame, when: Column, path: Column, date: Column, month: Column) -> DataFrame:
    """Raise results whose date or path contains the asked date (x 1.8) or month (x 1.4) and rank anew."""
    has = lambda x: F.coalesce(F.contains(when, x), F.lit(False)) | F.coalesce(F.contains(path, x), F.lit(False))
    factor = F.when(date.isNotNull() & has(date), DATE_BOOST).when(month.isNotNull() & has(month), MONTH_BOOST).otherwise(1.0)
    out = fused.withColumn("boosted", F.round(F.col("rrf_score") * factor, 12))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("boosted"), "rank")))


def expand_with_neighbours(ranked_: DataFrame, titles: DataFrame, neighbours: DataFrame, seeds: int = 5, resort: bool = False) -> DataFrame:
    """Append the documents of notes next to those of the first ``seeds`` results.

    ``ranked_ (qid, id, score, rank)``, ``titles (id, title)``, ``neighbours (title, neighbour)``. They get a fixed low
    score and, unless ``resort``, follow behind all results whatever these score.
    """
    top = ranked_.where(F.col("rank") <= seeds).join(titles, "id").select("qid", "title").distinct()
    near = top.join(neighbours, "title").select("qid", F.col("neighbour").alias("title")).distinct()
    extra = near.join(titles, "title").select("qid", "id").join(ranked_.select("qid", "id"), ["qid", "id"], "left_anti").distinct()
    both = ranked_.select("qid", "id", "score", "rank", F.lit(False).alias("added")).unionByName(extra.select("qid", "id", F.lit(NEIGHBOUR_SCORE).alias("score"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("added")))
    order = [F.desc("score"), "added"] if resort else ["added", F.asc_nulls_last("rank")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, "id")))


def rerank(pool: DataFrame, score: Column | None, k: int = 5, most: int = 10) -> DataFrame:
    """Cut the pool to ``most``, order it by ``score`` (None: as it comes) and keep ``k``."""
    pool = pool.where(F.col("rank") <= most)
    if score is not None:
        pool = pool.withColumn("rerank_score", score)
        pool = pool.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")))
    return pool.where(F.col("rank") <= k)


def overlap_score(question: Column, content: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's distinct tokens that the content has."""
    q, c = F.array_distinct(lexical_tokens(question)), lexical_tokens(content)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)


def recall_and_mrr(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: number of queries, Recall@5, Recall@10 and MRR over ``results (qid, id, rank, hit)``; of ``queries (qid)`` those without a hit count 0."""
    first = results.where("hit").groupBy("qid").agg(F.min("rank").alias("first"))
    per = queries.select("qid").distinct().join(first, "qid", "left")
    hit = lambda n: F.round(F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0)), 6)
    return per.agg(F.count("*").alias("n_queries"), hit(5).alias("recall_5"), hit(10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def evaluated(results: DataFrame, expected: DataFrame, cited: int = 5) -> DataFrame:
    """One row of :func:`recall_and_mrr` and ``citation_accuracy`` over ``results (qid, rank, path, title)``, a few a question, and ``expected (qid, source)``.

    A result is right if its path answers for an expected source (:func:`..functions.text.same_source`); a question's
    citations, the titles of its first ``cited`` results, are right if one of them does. Expected sources are joined by
    question, so a question's pairs are its few results times its sources.
    """
    paired = results.join(expected.select("qid", "source"), "qid", "left")
    right = lambda c: F.coalesce(F.max(F.coalesce(same_source(F.col(c), F.col("source")), F.lit(False))), F.lit(False))
    judged = paired.groupBy("qid", "rank").agg(right("path").alias("hit"), right("title").alias("cited_hit"))
    asked = expected.select("qid").distinct()
    cites = asked.join(judged.where((F.col("rank") <= cited) & F.col("cited_hit")).select("qid").distinct().withColumn("ok", F.lit(1.0)), "qid", "left")
    return recall_and_mrr(judged, asked).crossJoin(cites.agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("citation_accuracy")))  # one row each

"""Resolving free terms to note titles, looking notes up, and finding titles that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python_udfs import nearest_titles, sequence_ratio
from ..functions.text import safe_file_name, strip, term_stem
from ..session import saved, shuffle_width

THRESHOLD = 0.65
BLOCK = (2, 50)


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))


def match_score(term: Column, title: Column, is_alias: Column | None = None) -> Column:
    """How surely a term means a title: 1 equal in any case, .95 alias, .90 same stem, .92 same words, .70 to .90 one's words within the other's, else the sequence ratio."""
    a, b = words(term), words(title)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    within = (both == F.size(a)) | (both == F.size(b))
    stem_a, stem_b = term_stem(term), term_stem(title)
    out = F.when(F.lower(strip(term)) == F.lower(strip(title)), 1.0)
    if is_alias is not None:
        out = out.when(is_alias, 0.95)
    out = out.when((stem_a != "") & (stem_a == stem_b), 0.90).when((F.size(a) > 0) & (both == either), 0.92)
    return out.when((F.size(a) > 0) & (F.size(b) > 0) & within, F.round(0.70 + 0.20 * both / either, 6))


def _without_shared_word(lonely: DataFrame, titles: DataFrame, fuzzy: bool, most: tuple[int, int] = (200, 4000)) -> DataFrame:
    """``(scope, term, title, score)``: the best of all titles of the scope for terms that share a word with none of them.

    Terms and titles of a scope are cut by hash into parts of about ``most`` and every part meets every part, so a task
    holds a bounded number of both however large the scope. Without ``fuzzy`` only the stem can match.
    """
    lonely, titles = lonely.withColumn("stem", term_stem(F.col("term"))), titles.withColumn("stem", term_stem(F.col("title")))
    if not fuzzy:
        return lonely.where("stem <> ''").join(titles, ["scope", "stem"]).select("scope", "term", "title", F.lit(0.90).alias("score"))
    count = lambda df, n, name: df.groupBy("scope").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    parts = count(lonely, most[0], "m").join(count(titles, most[1], "n"), "scope")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    width = shuffle_width(lonely.sparkSession)  # a fixed number: little data, much work
    left = lonely.join(parts, "scope").select("scope", "term", "stem", own("term", "m").alias("i"), all_("n").alias("j")).repartition(width, "scope", "i", "j")
    right = titles.join(parts, "scope").select("scope", "title", "stem", all_("m").alias("i"), own("title", "n").alias("j")).repartition(width, "scope", "i", "j")
    schema = f"scope {lonely.schema['scope'].dataType.simpleString()}, term string, title string, score double"
    return left.groupBy("scope", "i", "j").cogroup(right.groupBy("scope", "i", "j")).applyInPandas(nearest_titles, schema)


def resolve_terms(terms: DataFrame, notes: DataFrame, aliases: DataFrame | None = None, threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """``(scope, term, title, score)``: the note each term of a scope means; title null below ``threshold``.

    ``terms (scope, term)``, ``notes (scope, title)``, ``aliases (scope, alias, title)`` with lower-case aliases.
    Candidates share a word with the term (an equality join on words); with ``fuzzy`` those without a sure match are
    compared by sequence ratio. A term that shares no word with any note of its scope is compared with all of them.
    Ties: the first title. Terms are compared once however often they occur.
    """
    asked = terms.select("scope", F.regexp_replace(strip(F.col("term")), r"\[\[|\]\]", "").alias("term")).where("term <> ''").distinct()
    titles = notes.select("scope", "title").where("title is not null").distinct()
    sure = asked.withColumn("low", F.lower("term")).join(titles.withColumn("low", F.lower("title")), ["scope", "low"]).select("scope", "term", "title", F.when(F.col("term") == F.col("title"), 2.0).otherwise(1.0).alias("score"))
    if aliases is not None:
        known = aliases.select("scope", F.col("alias").alias("low"), "title")
        sure = sure.unionByName(asked.withColumn("low", F.lower("term")).join(known, ["scope", "low"]).select("scope", "term", "title", F.lit(0.95).alias("score")))
    open_ = asked.join(sure.select("scope", "term").distinct(), ["scope", "term"], "left_anti")
    left = open_.select("scope", "term", F.explode(words(F.col("term"))).alias("w"))
    right = titles.select("scope", "title", F.explode(words(F.col("title"))).alias("w"))
    pairs = saved(left.join(right, ["scope", "w"]).select("scope", "term", "title").distinct(), "shared_words")
    lonely = open_.join(pairs.select("scope", "term").distinct(), ["scope", "term"], "left_anti")
    score = match_score(F.col("term"), F.col("title"))
    pairs = pairs.withColumn("score", F.coalesce(score, sequence_ratio("term", "title")) if fuzzy else F.coalesce(score, F.lit(0.0)))
    every = sure.unionByName(pairs).unionByName(_without_shared_word(lonely, titles, fuzzy))
    best = every.withColumn("n", F.row_number().over(Window.partitionBy("scope", "term").orderBy(F.desc("score"), "title"))).where("n = 1")
    best = asked.join(best.drop("n"), ["scope", "term"], "left")
    score = F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))
    return best.select("scope", "term", F.when(score >= threshold, F.col("title")).alias("title"), F.round(score, 6).alias("score"))


def safe_link(term: Column, title: Column, shown: Column | None = None) -> Column:
    """``[[title]]``, ``[[title|shown]]``, or the plain text if nothing was resolved."""
    text = shown if shown is not None else term
    return F.when(title.isNull(), text).when(text == title, F.concat(F.lit("[["), title, F.lit("]]"))).otherwise(F.concat(F.lit("[["), title, F.lit("|"), text, F.lit("]]")))


def ground_links(rows: DataFrame, key: str, links: Column, resolved: DataFrame) -> DataFrame:
    """Per row the sorted distinct targets of its links, each by its resolved title or, unresolved, as it stands."""
    flat = rows.select(key, "scope", F.explode(links).alias("raw")).select(key, "scope", strip(F.regexp_replace(F.regexp_replace("raw", r"\[\[|\]\]", ""), r"\|.*$", "")).alias("term")).where("term <> ''")
    named = flat.join(resolved.select("scope", "term", "title"), ["scope", "term"], "left")
    return named.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("title", "term"))).alias("links"))


def within(queries: DataFrame, texts: DataFrame, size: int = 3) -> DataFrame:
    """``(qid, tid)``: which of ``texts (tid, scope, text)`` contain ``queries (qid, scope, part)`` of the same scope; exact.

    A text that contains a part has all its runs of ``size`` characters. Of a part only the run that the fewest texts of
    its scope have is joined, and ``contains`` decides. Parts shorter than ``size`` are joined by themselves with the runs of
    their own length. Empty parts are in nothing.

    Runs are many times their texts, which the planner doesn't know of: their joins are by sorting, or it would send
    all runs to the driver to broadcast them.
    """
    # all runs of n characters in one pass: a look-ahead takes no character
    runs = lambda c, n: F.array_distinct(F.regexp_extract_all(c, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1)))
    q = queries.where("part is not null and part <> ''").select("qid", "scope", "part", F.least(F.lit(size), F.length("part")).alias("n"))
    lengths = [r[0] for r in q.select("n").distinct().collect()]  # 1 to size
    if not lengths:
        return queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, tid {texts.schema['tid'].dataType.simpleString()}")
    t = texts.where("text is not null").select("tid", "scope", "text").distinct()
    t = t.select("tid", "scope", "text", F.explode(F.flatten(F.array(*[runs(F.col("text"), F.lit(n)) for n in lengths]))).alias("run"))
    asked = q.select("qid", "scope", "part", F.explode(runs(F.col("part"), F.col("n"))).alias("run"))
    common = t.groupBy("scope", "run").agg(F.count("*").alias("texts"))
    rarest = asked.join(common.hint("merge"), ["scope", "run"], "left").groupBy("qid", "scope", "part").agg(F.min_by("run", F.struct(F.coalesce("texts", F.lit(0)), "run")).alias("run"))
    return rarest.join(t.hint("merge"), ["scope", "run"]).where(F.contains("text", F.col("part"))).select("qid", "tid")


def mentions(texts: DataFrame, parts: DataFrame, per_round: int = 1000) -> DataFrame:
    """``(qid, tid)``: which of the long ``texts (tid, text)`` contain ``parts (qid, part)``, a stated set taken in rounds of about ``per_round``; each text is read once a round."""
    parts = parts.where("part is not null and part <> ''")
    rounds = max(1, -(-parts.count() // per_round))
    found = None
    for n in range(rounds):
        asked = parts.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == n).collect()  # about per_round rows
        known = F.array(*[F.struct(F.lit(r["qid"]).alias("qid"), F.lit(r["part"]).alias("part")) for r in asked]) if asked else F.lit(None).cast("array<struct<qid:long,part:string>>")
        hits = texts.select("tid", F.explode(F.filter(known, lambda k: F.contains("text", k["part"]))).alias("k")).select("k.qid", "tid")
        found = hits if found is None else found.union(hits)
    return found


def look_up(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """``(qid, path, match)``: the note meant by each of ``queries (qid, scope, name)`` among ``notes (scope, path, stem, dir_rank)``:
    1 the exact stem, 2 the same in any case, 3 one a prefix of the other, 4 the query within the stem; then the folder's rank and the name.

    Exact: stems that contain a name come from :func:`within`, stems that a name begins with from an equality join on the
    name's beginnings. A name without the characters that file names can't have is tried beside the name as it stands.
    """
    names = queries.select("qid", "scope", F.explode(F.array_distinct(F.array(strip(F.col("name")), safe_file_name(F.col("name"))))).alias("name")).where("name <> ''")
    q = names.withColumn("low", F.lower("name")).withColumn("k", F.xxhash64("scope", "low"))
    n = notes.where("stem is not null").withColumn("stem_low", F.lower("stem"))
    stems = n.select("scope", "stem_low").distinct().withColumn("tid", F.xxhash64("scope", "stem_low"))
    parts = q.select(F.col("k").alias("qid"), "scope", F.col("low").alias("part")).distinct()
    inside = within(parts, stems.select("tid", "scope", F.col("stem_low").alias("text"))).select(F.col("qid").alias("k"), "tid")
    begins = parts.select(F.col("qid").alias("k"), "scope", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.substr("part", F.lit(1), i))).alias("stem_low"))
    begun = begins.join(stems.hint("merge"), ["scope", "stem_low"]).select("k", "tid")
    pairs = inside.union(begun).distinct().join(stems.hint("merge"), "tid").select("k", "scope", "stem_low")
    hits = q.join(pairs.hint("merge"), ["k", "scope"]).join(n.hint("merge"), ["scope", "stem_low"])
    match = (
        F.when(F.col("stem") == F.col("name"), 1).when(F.col("stem_low") == F.col("low"), 2)
        .when(F.startswith(F.col("stem_low"), F.col("low")) | F.startswith(F.col("low"), F.col("stem_low")), 3)
        .when(F.contains(F.col("stem_low"), F.col("low")), 4)
    )
    hits = hits.withColumn("match", match).where("match is not null")
    best = hits.groupBy("qid").agg(F.min(F.struct("match", "dir_rank", "stem", "path")).alias("b"))
    return best.select("qid", "b.path", "b.match")


def blocks(titles: DataFrame) -> DataFrame:
    """``(scope, word, n)``: how many titles of a scope have each word of three letters or more."""
    return titles.select("scope", "title").distinct().select("scope", "title", F.explode(words(F.col("title"))).alias("word")).where("length(word) > 2").groupBy("scope", "word").agg(F.count("*").alias("n"))


def duplicate_titles(titles: DataFrame, ratio: float = 0.70, fuzzy: bool = True, block: tuple[int, int] = BLOCK) -> DataFrame:
    """Pairs ``(scope, note_a, note_b, similarity)`` of titles that share a word of 2 to 50 titles and whose words are
    contained in one another (the first with two words or more) or, with ``fuzzy``, whose sequence ratio reaches ``ratio``.

    The bounds on a word's titles, ``block``, are part of the definition: words of more titles say nothing about sameness.
    """
    t = titles.select("scope", "title").where("title is not null").distinct().withColumn("ws", words(F.col("title")))
    flat = t.select("scope", "title", "ws", F.explode("ws").alias("word")).where("length(word) > 2")
    useful = blocks(titles).where(F.col("n").between(*block)).select("scope", "word")
    flat = flat.join(useful, ["scope", "word"])
    pairs = flat.select("scope", "word", F.col("title").alias("note_a"), F.col("ws").alias("wa")).join(flat.select("scope", "word", F.col("title").alias("note_b"), F.col("ws").alias("wb")), ["scope", "word"])
    pairs = pairs.where((F.col("note_a") < F.col("note_b")) & (F.lower("note_a") != F.lower("note_b"))).select("scope", "note_a", "note_b", "wa", "wb").distinct()
    inside = (F.size("wa") >= 2) & ((F.size(F.array_except("wa", "wb")) == 0) | (F.size(F.array_except("wb", "wa")) == 0))
    if not fuzzy:
        return pairs.where(inside).select("scope", "note_a", "note_b")
    pairs = pairs.withColumn("r", sequence_ratio("note_a", "note_b"))
    return pairs.where(inside | (F.col("r") >= ratio)).select("scope", "note_a", "note_b", F.format_string("%.2f", "r").alias("similarity"))

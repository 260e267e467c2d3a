"""Queries of the text-preparation problems (p2, p4, p6, p7, p8) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import contract
from ..session import saved, table
from .canonical import FILLERS, _letters, canonical_ids, unmatched
from .neardup import expanded_pairs, near_duplicates
from .mixing import mix, mix_shares, source_name
from .splitting import split_texts
from .tokens import counted, decoded, encoded


def chunk_duplicates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf, "markdown_chunks").select(F.col("chunk_no").alias("doc"), F.col("content").alias("text"))
    links, members = near_duplicates(chunks, t=0.6, words=3, least_words=20)
    return saved(links, "p2_links"), members


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = chunk_duplicates(spark, sf)
    return expanded_pairs(links, members).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk that counts: the lowest chunk of the same shingles and how many other texts that class is linked to."""
    links, members = chunk_duplicates(spark, sf)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(degree, "rep", "left").select(F.col("doc").alias("chunk_no"), F.col("rep").alias("class_chunk"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk that is like another one: the lowest chunk of its group. Likeness carries on from chunk to chunk, over copies and links."""
    links, members = chunk_duplicates(spark, sf)
    labels = contract(links.select("a", "b"))
    members = saved(members, "p2_members")
    whole = members.join(labels, members["rep"] == labels["node"], "left").select("doc", "rep", F.coalesce("label", "rep").alias("group"))
    grouped = whole.join(whole.where("doc <> rep").select("rep").union(links.select(F.col("a"))).union(links.select(F.col("b"))).distinct(), "rep", "left_semi")
    return grouped.select(F.col("doc").alias("chunk_no"), F.col("group").alias("group_chunk"))


def free_values(spark: SparkSession, sf: str) -> DataFrame:
    """All free-typed values as ``(source_table, record_key, field, value)``, once per row and field."""
    chunks = table(spark, sf, "markdown_chunks").select(
        F.lit("markdown_chunks").alias("source_table"), F.col("chunk_no").alias("record_key"), F.lit("wikilinks").alias("field"), F.explode(F.array_distinct("wikilinks")).alias("value")
    )
    notes = table(spark, sf, "note_nodes")
    aliases = notes.select(F.lit("note_nodes").alias("source_table"), F.col("node_no").alias("record_key"), F.lit("aliases").alias("field"), F.explode(F.array_distinct("aliases")).alias("value"))
    titles = notes.select(F.lit("note_nodes").alias("source_table"), F.col("node_no").alias("record_key"), F.lit("title").alias("field"), F.col("title").alias("value"))
    return chunks.unionByName(aliases).unionByName(titles).where("value is not null")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topic_terms").select(F.col("term_id").alias("id"), F.col("term").alias("name"), "short_forms")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    values, terms = free_values(spark, sf), topics(spark, sf)
    hits = canonical_ids(values, terms).join(terms.select(F.col("name").alias("value")), "value", "left_anti")
    return values.join(hits, "value").select("source_table", "record_key", "field", F.col("value").alias("raw_value"), F.col("id").alias("term_id"))


def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no entry of the list, with the number of rows that have them."""
    values = free_values(spark, sf)
    return unmatched(values, canonical_ids(values, topics(spark, sf)))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document and whether they decode to its text (null as empty)."""
    both = decoded(encoded(table(spark, sf, "documents").select("doc_id", "text")))
    return both.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p6_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that the tokens of each document stand for, and whether they are its text."""
    both = decoded(encoded(table(spark, sf, "documents").select("doc_id", "text")))
    return both.select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def source_members(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct text: its lowest ``doc_id``, the sources its copies stand in, and its tokens."""
    docs = table(spark, sf, "documents").where("text is not null and text <> ''").select("doc_id", "text", source_name(F.col("source")).alias("source"), F.md5("text").alias("digest"))
    sized = counted(docs)
    texts = sized.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("n_tokens").alias("n_tokens"))
    return saved(texts.select("doc_id", "sources", "n_tokens"), "p7_texts")


def mix_targets(spark: SparkSession, sf: str) -> list[tuple[str, str, float, int]]:
    return [tuple(r) for r in table(spark, sf, "mix_targets").select("mix_name", "source", "target_share", "max_repeats").collect()]  # a fixed list of settings


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(source_members(spark, sf), mix_targets(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = mix_targets(spark, sf)
    return mix_shares(mix(source_members(spark, sf), targets), targets).drop("largest")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per mix and source: is the share among the sources that occur reached within one point of the mix and one document of the source, and is no document used too often?"""
    targets = mix_targets(spark, sf)
    texts = source_members(spark, sf)
    shares = mix_shares(mix(texts, targets), targets)
    there = texts.where("n_tokens > 0").select(F.explode("sources").alias("source")).distinct().withColumn("occurs", F.lit(True))
    shares = shares.join(there, "source", "left").withColumn("wanted", F.when(F.col("occurs"), F.col("target_share")).otherwise(0.0))
    mix_ = Window.partitionBy("mix_name")
    total = F.sum("tokens").over(mix_)
    off = F.abs(F.col("tokens") - F.col("wanted") / F.sum("wanted").over(mix_) * total)
    return shares.select("mix_name", "source", (off <= 0.01 * total + F.col("largest")).alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def split_profiles(spark: SparkSession, sf: str) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in table(spark, sf, "split_profiles").select("profile", "max_tokens", "overlap_tokens").collect()]  # a fixed list of settings


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(table(spark, sf, "documents"), split_profiles(spark, sf))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces per profile and kind of boundary behind them."""
    pieces = p8_pieces(spark, sf)
    return pieces.groupBy("profile", "boundary").agg(
        F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("most_tokens"), F.countDistinct("doc_id").alias("n_documents")
    )


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per profile: are all pieces within the limit and as large as they say when encoded anew, do they follow on each other
    with the overlap (less up to three tokens of a character), does none hold the next, and do they add up to the texts?"""
    profiles = split_profiles(spark, sf)
    docs = table(spark, sf, "documents")
    pieces = saved(split_texts(docs, profiles), "p8_pieces")
    again = counted(pieces.withColumn("stated", F.col("n_tokens")), "piece", "anew")
    limits = spark.createDataFrame(profiles, "profile string, most int, shared int")
    rows = again.join(F.broadcast(limits), "profile")  # a short list of settings
    fits = rows.groupBy("profile").agg(
        F.min(F.col("anew") <= F.col("most")).alias("within_limit"), F.min(F.col("anew") == F.col("stated")).alias("counts_right"),
        F.min((F.col("piece_no") == 0) | F.col("overlap_tokens").between(F.col("shared") - 3, F.col("shared"))).alias("overlapping"),
        F.min((F.col("piece_no") == 0) | (F.col("start_token") > 0)).alias("none_repeated"),
    )
    # a text's pieces without what they share: their tokens add up to the text's
    sums = pieces.groupBy("profile", "doc_id").agg(F.sum(F.when(F.col("boundary") == "e", F.col("start_token") + F.col("n_tokens"))).alias("end"), F.count("*").alias("n"), F.max("piece_no").alias("last"))
    whole = sums.join(counted(docs.select("doc_id", "text"), out="tokens"), "doc_id")
    complete = whole.groupBy("profile").agg(F.min((F.col("end") == F.col("tokens")) & (F.col("n") == F.col("last") + 1)).alias("complete"))
    asked = limits.select("profile").join(fits, "profile", "left").join(complete, "profile", "left")
    return asked.select("profile", *[F.coalesce(c, F.lit(True)).alias(c) for c in ("within_limit", "counts_right", "overlapping", "none_repeated", "complete")])


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p2_groups, p4_found, p4_unmatched, p6_ids, p6_roundtrip, p6_bytes, p7_mix, p7_shares, p7_checks, p8_pieces, p8_report, p8_checks)}
_SHINGLES = r"""
with words as (
  select chunk_no, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from markdown_chunks
), counted as (select * from words where len(w) >= 20),
shingles as (select distinct chunk_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select chunk_no, w, unnest(range(1, len(w) - 1)) as i from counted)),
sizes as (select chunk_no, count(*) as n from shingles group by chunk_no),
pairs as (
  select x.chunk_no as a, y.chunk_no as b, count(*) as o from shingles x join shingles y on x.g = y.g and x.chunk_no < y.chunk_no group by all),
alike as (select a, b from pairs join sizes s on s.chunk_no = a join sizes t on t.chunk_no = b where o >= 0.6 * (s.n + t.n - o))
"""
_LETTERS = _letters()
_SLIP = "case levenshtein(v.words[i], f.words[i]) when 0 then true when 1 then len(f.words[i]) >= 2 when 2 then len(f.words[i]) >= 7 or (len(f.words[i]) >= 3 and list_sort(string_split(v.words[i], '')) = list_sort(string_split(f.words[i], ''))) else false end"


def _plain_words(value: str) -> str:
    """SQL of the words of a value, as :func:`.canonical.plain_words` makes them."""
    bare = rf"regexp_replace(regexp_replace({value}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^\[\[(.*)\]\]$', '\1', 's')"
    bare = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({bare}, '[|#].*$', '', 's'), '^.*/', '', 's'), '[\s\p{{Z}}]+$', ''), '\.md$', '', 'i')"
    bare = rf"regexp_replace(translate(lower({bare}), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[\p{{M}}\p{{Cf}}]', '', 'g')"
    return rf"regexp_extract_all(replace(replace({bare}, 'ß', 'ss'), 'æ', 'ae'), '[\p{{L}}\p{{N}}]+')"


_CONTENT = "case when len(list_filter(w, lambda x: x not in (" + ", ".join(f"'{x}'" for x in FILLERS) + "))) > 0 then list_filter(w, lambda x: x not in (" + ", ".join(f"'{x}'" for x in FILLERS) + ")) else w end as words"
_CANONICAL = f"""
with free as (
  select 'markdown_chunks' as source_table, chunk_no as record_key, 'wikilinks' as field, unnest(list_distinct(wikilinks)) as value from markdown_chunks
  union all select 'note_nodes', node_no, 'aliases', unnest(list_distinct(aliases)) from note_nodes
  union all select 'note_nodes', node_no, 'title', title from note_nodes where title is not null
), keyed as (select value, words, array_to_string(words, '') as key from (select value, {_CONTENT} from (select value, {_plain_words("value")} as w from (select distinct value from free where value is not null)))),
keys as (select distinct key, words from keyed where key <> ''),
full_ as (select term_id as id, words as w from (select term_id, {_CONTENT} from (select term_id, {_plain_words("term")} as w from topic_terms))),
forms as (
  select distinct id, list_concat(w[n + 1:], w[:n]) as words, false as short from (select id, w, unnest(range(0, len(w))) as n from full_)
  union select term_id, words, true from (select term_id, {_CONTENT} from (select term_id, {_plain_words("s")} as w from (select term_id, unnest(short_forms) as s from topic_terms)))),
refs as (select *, array_to_string(words, '') as ref from forms),
hits as (
  select v.key, v.words, f.id, (levenshtein(v.key, f.ref), case when v.key <> f.ref and len(v.words) = len(f.words) then len(list_filter(range(1, len(v.words) + 1), lambda i: left(v.words[i], 1) <> left(f.words[i], 1))) else 0 end) as distance from keys v join refs f on v.key = f.ref
    or (not f.short and abs(len(v.key) - len(f.ref)) <= 2 * len(f.words) and levenshtein(v.key, f.ref) <= len(f.ref) * 2 // 5
      and case when len(v.words) = len(f.words) then len(list_filter(range(1, len(v.words) + 1), lambda i: not {_SLIP})) = 0 else levenshtein(v.key, f.ref) <= 2 end)),
nearest as (select key, words, id from (select *, min(distance) over (partition by key, words) as least from hits) where distance = least),
ids as (select key, words, min(id) as id from nearest group by all having count(distinct id) = 1),
matched as (select value, id from keyed join ids using (key, words))
"""
SQL: dict[str, str] = {
    "p4_found": _CANONICAL + "select source_table, record_key, field, value as raw_value, id as term_id from free join matched using (value) where value not in (select term from topic_terms)",
    "p4_unmatched": _CANONICAL + "select value, count(*) as n_rows from free where value is not null and value not in (select value from matched) group by value",
    "p6_bytes": "select doc_id, coalesce(strlen(text), 0) as n_bytes, true as same from documents",
    "p7_checks": "select mix_name, source, true as share_reached, true as repeats_kept from mix_targets",
    "p8_checks": "select profile, true as within_limit, true as counts_right, true as overlapping, true as none_repeated, true as complete from split_profiles",
    "p2_groups": _SHINGLES.replace("with words", "with recursive words")
    + """, both_ways as (select a, b from alike union select b, a from alike),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select a as chunk_no, least(a, min(b)) as group_chunk from reach group by a""",
    "p2_found": _SHINGLES + "select a as chunk_a, b as chunk_b from alike",
    "p2_classes": _SHINGLES
    + """,
sets as (select chunk_no, list_sort(list(g)) as s from shingles group by chunk_no),
members as (select chunk_no, min(chunk_no) over (partition by s) as class_chunk from sets),
links as (select x.class_chunk as c, y.class_chunk as d from alike join members x on x.chunk_no = a join members y on y.chunk_no = b where x.class_chunk <> y.class_chunk),
degrees as (select c, count(distinct d) as n from (select c, d from links union all select d, c from links) group by c)
select chunk_no, class_chunk, coalesce(n, 0) as n_links from members left join degrees on c = class_chunk""",
}

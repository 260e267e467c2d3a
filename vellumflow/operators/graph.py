"""The directed graph of notes: nodes, aliases, resolved links, backlinks, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.python_udfs import yaml_fields
from .orphans import strip


def link_target(c: Column) -> Column:
    """A link as typed, without brackets, display text and heading."""
    c = F.regexp_replace(strip(c), r"\[\[|\]\]", "")
    return strip(F.regexp_replace(c, r"(?s)[|#].*$", ""))


def parse_nodes(notes: DataFrame) -> DataFrame:
    """``(path, title, aliases, tags, headings, block_ids, links)`` of ``notes (path, title, text)``.

    Aliases and tags come from the frontmatter, as a list of any YAML form or comma-separated; tags also from the whole
    text; headings, block ids and links from the body. Null texts give empty lists.
    """
    none = F.array().cast("array<string>")
    n = notes.select("path", "title", F.coalesce("text", F.lit("")).alias("text")).withColumn("front", yaml_fields(t.frontmatter_block(F.col("text")))).withColumn("body", t.body(F.col("text")))
    listed = lambda name: F.coalesce(t.listed(F.element_at("front", name)), none)
    return n.select(
        "path", "title", listed("aliases").alias("aliases"), F.array_sort(F.array_union(t.as_tags(listed("tags")), t.tags(F.col("text")))).alias("tags"),
        t.headings(F.col("body")).alias("headings"), t.block_ids(F.col("body")).alias("block_ids"), t.wikilinks(F.col("body")).alias("links"),
    )


def alias_table(nodes: DataFrame) -> DataFrame:
    """``(scope, alias, title)``: lower-cased titles and aliases; of several notes the last by ``order`` wins."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    flat = nodes.where("title is not null").select("scope", "title", "order", F.explode(names).alias("n")).select("scope", F.lower("n").alias("alias"), "title", "order").where("alias is not null")
    return flat.groupBy("scope", "alias").agg(F.max_by("title", F.struct("order", "title")).alias("title"))


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``target``, the title that ``links.name`` means within its scope: an exact title, else an alias in any case, else null."""
    titles = nodes.where("title is not null").select("scope", F.col("title").alias("name"), F.col("title").alias("exact")).distinct()
    aliases = alias_table(nodes).select("scope", F.col("alias").alias("low"), F.col("title").alias("other"))
    out = links.withColumn("low", F.lower("name")).join(titles, ["scope", "name"], "left").join(aliases, ["scope", "low"], "left")
    return out.withColumn("target", F.coalesce("exact", "other")).drop("low", "exact", "other")


def edges(nodes: DataFrame) -> DataFrame:
    """Distinct resolved links ``(scope, src, dst)`` of ``nodes (scope, title, aliases, links, order)``; unresolved links are dropped."""
    links = nodes.where("title is not null").select("scope", F.col("title").alias("src"), F.explode("links").alias("raw")).select("scope", "src", link_target(F.col("raw")).alias("name")).where("name <> ''").distinct()
    return resolve_links(links, nodes).where("target is not null").select("scope", "src", F.col("target").alias("dst")).distinct()


def backlinks(links: DataFrame) -> DataFrame:
    """Per note the number of notes that link to it, and of those it links to."""
    into = links.groupBy("scope", F.col("dst").alias("title")).agg(F.count("*").alias("n_backlinks"))
    out = links.groupBy("scope", F.col("src").alias("title")).agg(F.count("*").alias("n_links"))
    return into.join(out, ["scope", "title"], "full_outer").select("scope", "title", F.coalesce("n_backlinks", F.lit(0)).alias("n_backlinks"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def undirected(links: DataFrame) -> DataFrame:
    both = links.union(links.select("scope", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def neighbours(links: DataFrame, seeds: DataFrame | None = None, hops: int = 1, most: int | None = 5) -> DataFrame:
    """``(scope, title, neighbour, n)``: notes one link away in either direction, with ``hops > 1`` also two, in order of
    title, the first ``most`` (None: all). ``seeds (scope, title)`` limits the notes asked for."""
    near = undirected(links)
    own = near.select("scope", F.col("src").alias("title"), F.col("dst").alias("neighbour"))
    if seeds is not None:
        own = own.join(seeds.select("scope", "title").distinct(), ["scope", "title"], "left_semi")
    if hops > 1:
        if most is not None:
            # of a note in between only its first titles can be among the first of all, so a hub passes on few
            first = F.row_number().over(Window.partitionBy("scope", "src").orderBy("dst"))
            near = near.withColumn("n", first).where(F.col("n") <= most + 1)
        second = own.join(near.select("scope", F.col("src").alias("neighbour"), F.col("dst").alias("next")), ["scope", "neighbour"])
        own = own.union(second.where("next <> title").select("scope", "title", F.col("next").alias("neighbour"))).distinct()
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("scope", "title").orderBy("neighbour")))
    return own if most is None else own.where(F.col("n") <= most)


def expand(seeds: DataFrame, links: DataFrame, hops: int = 1, most: int = 5) -> DataFrame:
    """Seeds and their neighbours, distinct ``(scope, title)``."""
    return seeds.select("scope", "title").union(neighbours(links, seeds, hops, most).select("scope", F.col("neighbour").alias("title"))).distinct()


def drop_notes(links: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those from or to the ``removed (scope, title)`` notes."""
    gone = removed.select("scope", "title")
    return links.join(gone.withColumnRenamed("title", "src"), ["scope", "src"], "left_anti").join(gone.withColumnRenamed("title", "dst"), ["scope", "dst"], "left_anti")


def update_notes(links: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``links`` of the graph after the ``changed (scope, title)`` notes were indexed again or came new; ``nodes`` is the state after.

    Links from these notes are resolved anew, and so are those of every note that names one of them by title or alias, as
    such a link may mean another note now; all other edges stay as they are. Equal to :func:`edges` of ``nodes`` where
    no other note changed.
    """
    gone = changed.select("scope", "title").distinct()
    named = nodes.join(gone, ["scope", "title"], "left_semi").select("scope", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = named.select("scope", F.lower("n").alias("low")).union(gone.select("scope", F.lower("title"))).where("low is not null").distinct()
    raw = nodes.where("title is not null").select("scope", "title", F.explode("links").alias("raw")).select("scope", "title", F.lower(link_target(F.col("raw"))).alias("low"))
    touched = raw.join(names, ["scope", "low"], "left_semi").select("scope", "title").union(gone)
    # what pointed at a changed note by an alias that it no longer has
    touched = touched.union(links.join(gone.withColumnRenamed("title", "dst"), ["scope", "dst"], "left_semi").select("scope", F.col("src").alias("title"))).distinct()
    kept = links.join(touched.withColumnRenamed("title", "src"), ["scope", "src"], "left_anti")
    own = nodes.where("title is not null").join(touched, ["scope", "title"], "left_semi").select("scope", F.col("title").alias("src"), F.explode("links").alias("raw"))
    own = own.select("scope", "src", link_target(F.col("raw")).alias("name")).where("name <> ''").distinct()
    return kept.unionByName(resolve_links(own, nodes).where("target is not null").select("scope", "src", F.col("target").alias("dst")).distinct())

"""Mapping free-entered values to a reference list, by a partition-based pigeonhole join in SQL functions only.

A string within k edits of a reference string contains one of the string's k + 1 segments unchanged, at a position
that the edits before and after it allow. Reference strings are cut into segments; values contribute the substrings at
those positions; an equality join on (length, segment number, text) yields the candidates and the built-in
``levenshtein`` verifies them. It runs once over the distinct words, where k is that of one word, so any number of words
may have slips, and once over whole values for words run together. Values without a match follow through an anti-join.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

#: Words that say nothing about which entry is meant.
FILLERS = [
    "a", "an", "the", "my", "our", "your", "this", "that", "on", "about", "of", "re", "note", "notes", "guide", "guides",
    "doc", "docs", "concept", "concepts",
]
#: Letters that look like Latin ones, with those.
LOOKALIKES = [("асеорхуіјѕԁһк", "aceopxyijsdhk"), ("αοενρτυκι", "aoevptuki"), ("øłđħıŧ0", "oldhito")]


def _letters() -> tuple[str, str]:
    """Accented and compatibility characters with the single plain letter or digit they stand for, by Unicode's decomposition."""
    source, target = [], []
    for code in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain != chr(code) and plain.isalnum() and ord(plain) < 128:
            source.append(chr(code))
            target.append(plain)
    for a, b in LOOKALIKES:
        source += a
        target += b
    return "".join(source), "".join(target)


def plain_words(value: Column) -> Column:
    """Words of a value without its dressing: link brackets, display text, heading, folders, ``.md``, case, accents,
    look-alike letters, separators and fillers (kept if nothing else is left)."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    v = F.regexp_replace(v, r"(?s)^\[\[(.*)\]\]$", "$1")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)[|#].*$", ""), r"(?s)^.*/", "")
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+$", ""), r"(?i)\.md$", "")
    v = F.regexp_replace(F.translate(F.lower(v), *_letters()), r"[\p{M}\p{Cf}]", "")
    v = F.replace(F.replace(v, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    words = F.regexp_extract_all(v, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    content = F.filter(words, lambda w: ~w.isin(FILLERS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def reference_forms(reference: DataFrame) -> DataFrame:
    """``(ref, words, id, short)``: every rotation of the words of each ``name`` of ``reference (id, name, short_forms)``, and the short forms."""
    words = reference.select("id", plain_words(F.col("name")).alias("w")).where("size(w) > 0")
    turn = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.concat(F.slice("w", i + 1, F.size("w")), F.slice("w", F.lit(1), i))))
    full = words.select("id", turn.alias("n", "words"))
    short = reference.select("id", F.explode("short_forms").alias("s")).select("id", plain_words(F.col("s")).alias("words")).where("size(words) > 0")
    forms = full.select(F.array_join("words", "").alias("ref"), "words", "id", F.lit(False).alias("short"))
    return forms.unionByName(short.select(F.array_join("words", "").alias("ref"), "words", "id", F.lit(True).alias("short"))).distinct()


def _pigeonhole(values: DataFrame, references: DataFrame, k: Column) -> DataFrame:
    """Pairs ``(v, r)`` of distinct strings of ``values (v)`` and ``references (r)`` within ``k`` edits, a function of the column ``len``.

    A string of length ``len`` is cut into k + 1 segments; a string within k edits of it has one of them unchanged, moved
    by no more than the edits before and after it.
    """
    begin, end = F.expr("i * len div (k + 1)"), F.expr("(i + 1) * len div (k + 1)")
    cut = references.withColumn("len", F.length("r")).withColumn("k", k).where("k >= 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    segments = cut.select("r", "k", "len", "i", F.substring("r", begin.cast("int") + 1, (end - begin).cast("int")).alias("segment"))
    probe = values.withColumn("n", F.length("v")).withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 2), F.col("n") + 2)))
    probe = probe.withColumn("k", k).where((F.col("k") >= 0) & (F.abs(F.col("n") - F.col("len")) <= F.col("k"))).join(segments.select("len").distinct(), "len", "left_semi")
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("b", begin.cast("int")).withColumn("size", end.cast("int") - F.col("b"))
    # an edit before the segment shifts it by one, and so does one behind it as seen from the end
    low = F.greatest(F.lit(0), F.col("b") - F.col("i"), F.expr("b + n - len - (k - i)"))
    high = F.least(F.expr("n - size"), F.expr("b + i"), F.expr("b + n - len + (k - i)"))
    probe = probe.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probe = probe.select("v", "len", "i", F.expr("substring(v, at + 1, size)").alias("segment"))
    return probe.join(segments, ["len", "i", "segment"]).select("v", "r", "k").distinct().where("levenshtein(v, r, k) >= 0").select("v", "r")


#: SQL of the rule for one word ``{a}`` against the word ``{b}`` of an entry: a word of one letter is equal; else one edit; from three letters on two neighbours swapped; from seven letters on two edits.
SLIP = "case levenshtein({a}, {b}, 2) when 0 then true when 1 then length({b}) >= 2 when 2 then length({b}) >= 7 or (length({b}) >= 3 and array_sort(split({a}, '')) = array_sort(split({b}, ''))) else false end"


def canonical_ids(values: DataFrame, reference: DataFrame, salts: int = 8) -> DataFrame:
    """``(value, id, distance)`` of the distinct ``values (value)`` that mean an entry of ``reference (id, name, short_forms)``.

    A value means an entry if its plain words, in some rotation of the entry's, are the entry's up to one slip per word
    (:data:`SLIP`), in all no more than two fifths of the entry's letters, or if it is a short form. Words run together or
    apart count as the entry within two edits in all. Of several entries the nearest counts, of equally near ones that with
    the fewest other first letters, as slips seldom touch these; a tie that is left means none. Null and blank values mean none. Neither side is collected or capped; the number of slips follows from
    the number of words. Every entry is found by its rarest word: distinct words of the values are matched with those
    first, and values then by equality on the word, its place and the number of words, spread over ``salts``.
    """
    keyed = values.select("value").where("value is not null").distinct().withColumn("words", plain_words(F.col("value"))).withColumn("key", F.array_join("words", ""))
    keyed = saved(keyed.where("key <> ''"), "p4_keys")
    keys = keyed.select("key", "words").distinct()
    forms = saved(reference_forms(reference), "p4_forms")
    exact = keys.select("key", "words").join(forms.select(F.col("ref").alias("key"), "id"), "key").select("key", "words", "id", F.lit(0).alias("distance"), F.lit(0).alias("odd"))
    full = forms.where("not short").select("ref", F.col("words").alias("ref_words"), "id")

    # word by word
    placed = full.select("ref", "ref_words", "id", F.posexplode("ref_words").alias("pos", "r"))
    common = placed.groupBy("r").agg(F.count_distinct("id").alias("entries"))
    anchors = placed.join(common, "r").groupBy("ref", "ref_words", "id").agg(F.min(F.struct("entries", (-F.length("r")).alias("short"), "pos", "r")).alias("a"))
    salt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select("ref", "ref_words", "id", F.size("ref_words").alias("n"), "a.pos", "a.r")
    spelled = keys.select(F.explode("words").alias("v")).distinct()
    near = _pigeonhole(spelled, anchors.select("r").distinct(), F.least(F.lit(2), F.col("len") - 1)).where(F.expr(SLIP.format(a="v", b="r")))
    at = keys.select("key", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "v")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    pairs = at.join(near.withColumn("salt", salt(salts)), ["v", "salt"]).drop("v").join(anchors.withColumn("salt", salt(salts)), ["n", "pos", "r", "salt"])
    slips = pairs.where(F.expr(f"forall(zip_with(words, ref_words, (a, b) -> {SLIP.format(a='a', b='b')}), ok -> ok)"))
    slips = slips.withColumn("distance", F.levenshtein("key", "ref")).where("distance > 0 and distance <= length(ref) * 2 div 5")
    slips = slips.withColumn("odd", F.size(F.filter(F.zip_with("words", "ref_words", lambda a, b: F.substring(a, 1, 1) != F.substring(b, 1, 1)), lambda x: x)))

    # run together or apart
    joined = _pigeonhole(keys.select(F.col("key").alias("v")).distinct(), full.select(F.col("ref").alias("r")).distinct(), F.least(F.lit(2), F.floor(F.col("len") * 2 / 5).cast("int")))
    apart = joined.join(full, F.col("r") == F.col("ref")).select(F.col("v").alias("key"), "ref", "ref_words", "id").join(keys, "key").where("size(words) <> size(ref_words)")
    apart = apart.withColumn("distance", F.levenshtein("key", "ref")).where("distance > 0")

    kept = ["key", "words", "id", "distance", "odd"]
    found = exact.select(kept).unionByName(slips.select(kept)).unionByName(apart.withColumn("odd", F.lit(0)).select(kept))
    best = found.groupBy("key", "words").agg(F.min(F.struct("distance", "odd")).alias("least"), F.collect_set(F.struct("distance", "odd", "id")).alias("hits"))
    best = best.select("key", "words", "least.distance", F.array_distinct(F.expr("transform(filter(hits, h -> h.distance = least.distance and h.odd = least.odd), h -> h.id)")).alias("ids"))
    best = best.where("size(ids) = 1").select("key", "words", F.col("ids")[0].alias("id"), "distance")
    return keyed.join(best, ["key", "words"]).select("value", "id", "distance")


def unmatched(values: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct ``value`` of ``values`` that ``matched`` lacks, with ``n_rows``; nulls are left out."""
    return values.where("value is not null").groupBy("value").agg(F.count("*").alias("n_rows")).join(matched.select("value"), "value", "left_anti")

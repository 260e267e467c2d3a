"""Text preparation operators against brute force, other implementations and exact round trips."""

import math
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import canonical, mixing, neardup, splitting, tokens

ODD = [None, "", " ", "\n\n\n", "plain text.", "don't  stop \t now", "日本語のテキスト。次の文！", "नमस्ते दुनिया", "🎉👩‍👩‍👧 <|endoftext|>", "a" * 3000, "x y " * 500, "\r\n\r\nA\r\n", "Zalgo̴̢", " " * 400 + "z"]


def brute_pairs(texts, t, n, least):
    sets = {}
    for i, x in enumerate(texts):
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if len(w) >= max(n, least):
            sets[i] = set(zip(*(w[k:] for k in range(n))))
    return {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    phrases = [" ".join(rng.choices(words, k=6)) for _ in range(8)]
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.5:
            w = rng.choice([x for x in texts if x] or ["a b c"]).split()
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice([rng.choice(phrases), " ".join(rng.choices(words, k=5))]) for _ in range(rng.randrange(1, 22))))
    return texts + [None, "", "one two three", "w " * 4000, texts[0], texts[0]]


@pytest.mark.parametrize("t,n,least", [(0.6, 3, 20), (0.8, 5, 5)])
def test_near_duplicates_against_all_pairs(spark, t, n, least):
    texts = corpus(11, 250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    links, members = neardup.near_duplicates(docs, t, n, least)
    got = {(r.a, r.b) for r in neardup.expanded_pairs(links, members).collect()}
    assert got == brute_pairs(texts, t, n, least)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    links, members = neardup.near_duplicates(empty)
    assert links.count() == 0 and members.count() == 0


def test_prefix_pass_finds_the_same(spark):
    texts = corpus(3, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    sets = neardup.shingle_blocks(docs, 3, 20).select("*", F.lit(None).cast("array<int>").alias("dropped"), F.transform(F.sequence(F.lit(0), F.size("docs") - 1), lambda i: i).alias("hard"))
    found = neardup.prefix_pairs(sets, 0.6, np.zeros(neardup.CELLS, np.int64))
    got = {(r.a, r.b) for r in neardup.verified(found, docs, 0.6, 3).collect()}
    assert got == brute_pairs(texts, 0.6, 3, 20)


@pytest.mark.parametrize("per_range", [40, 100_000])
def test_ranges_do_not_change_the_result(spark, per_range):
    texts = corpus(5, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    links, members = neardup.near_duplicates(docs, 0.6, 3, 20, per_range)
    assert {(r.a, r.b) for r in neardup.expanded_pairs(links, members).collect()} == brute_pairs(texts, 0.6, 3, 20)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (20, 60, 70, 120, 130, 300, 500)]
    size = np.array(list(map(len, sets)))
    found = neardup.Sketches(neardup.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size), size)
    for a, b in combinations(range(len(sets)), 2):
        assert found.apart(np.array([a]), np.array([b]))[0] <= len(np.setxor1d(sets[a], sets[b]))
    assert found.apart(np.array([1]), np.array([2]))[0] > 0


def test_large_class_of_copies_stays_linear(spark):
    same = "the same text of more than five words"
    docs = spark.range(300).select(F.col("id").alias("doc"), F.lit(same).alias("text"))
    links, members = neardup.near_duplicates(docs)
    pairs = neardup.expanded_pairs(links, members, each=5)
    assert links.count() == 0 and members.where("rep = 0").count() == 300 and pairs.count() == 10 + 295


@pytest.mark.parametrize("block", [7, 500])
def test_large_classes_of_other_texts_are_paired_in_full(spark, block):
    base = [f"w{i}" for i in range(40)]
    spelled = [" ".join(w.upper() if k >> (i % 5) & 1 else w for i, w in enumerate(base)) for k in range(28)]
    linked = [" ".join([*base, "more", *["!"] * k]) for k in range(25)]
    texts = spelled + linked + [spelled[0]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    links, members = neardup.near_duplicates(docs, 0.6, 3, 20)
    got = [(r.a, r.b) for r in neardup.expanded_pairs(links, members, block=block).collect()]
    assert len(got) == len(set(got)) == 56 * 55 // 2 and set(got) == brute_pairs(texts, 0.6, 3, 20)


def test_encoding_equals_another_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    pieces = tokens.vocabulary()
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(ODD)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got == {i: other.encode_ordinary(x) if x else [] for i, x in enumerate(ODD)}
    back = tokens.decoded(tokens.encoded(df)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    sizes = {r.doc_id: r.n_tokens for r in tokens.counted(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


def test_pieces(spark):
    rng = random.Random(2)
    long = "\n\n".join(f"## Part {k}\n" + " ".join(rng.choice(["Short one.", "A longer sentence here!", "日本語。", "word", "naïve"]) for _ in range(40)) for k in range(12))
    texts = [*ODD, long, long.replace("\n\n", " "), "字" * 2000, "🎉" * 900, "\n" * 600, "a  \n\n \n b " * 200, "a" + "\n" * 600 + "b", "w" + " " * 500 + "z", "ab\n\n" + "Next words. " * 60, "\t\tx\n\n\n" * 120, "hi\n\n# Head\n\n" + "long text goes on " * 50]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, piece int")
    profiles = [("s", 40, 8), ("m", 128, 0), ("l", 700, 100)]
    encoder = tokens.Encoder(tokens.model_bytes(tokens.vocabulary()))
    ids = encoder.encode(texts)
    seen = {}
    for r in splitting.split_texts(df, profiles).collect():
        seen.setdefault((r.profile, r.doc_id), []).append(r)
    assert set(seen) == {(name, i) for name, most, _ in profiles for i, x in enumerate(ids) if len(x) > most}
    for (name, i), pieces in seen.items():
        most, shared = next((m, s) for n, m, s in profiles if n == name)
        pieces.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in pieces] == list(range(len(pieces)))
        whole = b""
        for r in pieces:
            assert 0 < r.n_tokens <= most and (len(encoder.encode([r.piece])[0]) == r.n_tokens or r.piece.isspace() and len(encoder.encode([r.piece])[0]) <= most), (name, i, r)
            assert r.piece_no == 0 or r.start_token > 0
            assert shared - 3 <= r.overlap_tokens <= shared or r.piece_no == 0
            stop = next((x.start_token + x.overlap_tokens for x in pieces if x.piece_no == r.piece_no + 1), len(ids[i]))
            mine = ids[i][r.start_token : stop]
            assert len(mine) - r.n_tokens in (0, 1) and tokens.decode(mine, VOCABULARY) == r.piece
            whole += b"".join(VOCABULARY[k] for k in mine[r.overlap_tokens :])
        assert whole.decode() == texts[i]
    parts = [r for r in seen["s", len(ODD)]]
    assert sum(r.boundary in "hpls" for r in parts) > 0.9 * len(parts)


VOCABULARY = tokens.vocabulary()


def test_running_sums(spark):
    lengths = [[], [3], list(range(1, 400)), [1] * 128, [2] * 129]
    df = spark.createDataFrame([(x,) for x in lengths], "x array<int>")
    got = [r[0] for r in df.select(splitting.running_sums(F.col("x"))).collect()]
    assert got == [[sum(x[:k]) for k in range(len(x) + 1)] for x in lengths]


def test_split_settings(spark):
    with pytest.raises(ValueError):
        splitting.split_texts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), [("bad", 10, 10)])


TARGETS = [("m", "a", 0.5, 2), ("m", "b", 0.3, 3), ("m", "c", 0.2, 1), ("m", "gone", 0.0, 5)]


def test_mixing_reaches_its_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices([["a"], ["b"], ["c"], ["a", "b"], ["b", "c"], ["x"], []], [40, 6, 30, 3, 3, 5, 1])[0], rng.randrange(0, 80)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n_tokens int")
    mixed = mixing.mix(docs, TARGETS)
    shares = {r.source: r for r in mixing.mix_shares(mixed, TARGETS).collect()}
    assert all(abs(shares[s].actual_share - share) < 0.01 for _, s, share, _ in TARGETS)
    of = {r[0]: r[1] for r in rows}
    most = {s: k for _, s, _, k in TARGETS}
    used = {}
    for r in mixed.collect():
        assert r.source in of[r.doc_id] and r.n_tokens > 0
        used[r.doc_id] = used.get(r.doc_id, 0) + r.uses
    assert all(n <= min(most[s] for s in of[d] if s in most) for d, n in used.items())
    # the total is the largest possible: some set of sources is used up
    patterns = {}
    for d, s, n in rows:
        if p := frozenset(s) & set(most):
            patterns[p] = patterns.get(p, 0) + n
    best = mixing.largest_total(patterns, {s: x for _, s, x, _ in TARGETS}, most)
    total = sum(r.tokens for r in shares.values())
    assert abs(total - best) < 0.01 * best
    assert mixing.mix(docs, TARGETS).exceptAll(mixed).isEmpty() and not mixing.mix(docs, TARGETS, seed=1).exceptAll(mixed).isEmpty()


def test_flow_prefers_fewer_repeats():
    patterns = {frozenset("a"): 100, frozenset("ab"): 100, frozenset("b"): 10}
    taken = mixing.route(patterns, {"a": 100, "b": 110}, {"a": 3, "b": 3})
    assert taken[frozenset("a"), "a"] == 100 and taken[frozenset("ab"), "b"] == 100 and taken[frozenset("b"), "b"] == 10


def brute_total(patterns, shares, repeats):
    room = {p: t * min(repeats[s] for s in p) for p, t in patterns.items()}
    there = [s for s in shares if shares[s] > 0 and any(s in p for p in patterns)]
    groups = [g for n in range(1, len(there) + 1) for g in combinations(there, n)]
    return int(min(sum(r for p, r in room.items() if not p.isdisjoint(g)) / sum(shares[s] for s in g) for g in groups)) if groups else 0


def test_largest_total_against_all_sets_of_sources():
    rng = random.Random(3)
    for _ in range(60):
        names = "abcdef"[: rng.randrange(1, 7)]
        patterns = {frozenset(rng.sample(names, rng.randrange(1, len(names) + 1))): rng.randrange(1, 1000) for _ in range(rng.randrange(1, 9))}
        shares = {s: rng.choice([0.0, rng.random()]) for s in names}
        repeats = {s: rng.randrange(1, 4) for s in names}
        assert abs(mixing.largest_total(patterns, shares, repeats) - brute_total(patterns, shares, repeats)) <= 1


def test_thirty_sources_end():
    rng = random.Random(7)
    names = [f"s{i}" for i in range(30)]
    patterns = {frozenset(rng.sample(names, rng.randrange(1, 5))): rng.randrange(1, 10**9) for _ in range(300)}
    shares, repeats = {s: rng.random() for s in names}, {s: rng.randrange(1, 5) for s in names}
    total = mixing.largest_total(patterns, shares, repeats)
    taken = mixing.route(patterns, {s: int(total * x) for s, x in shares.items()}, repeats)
    assert total > 0 and all(abs(sum(v for (_, s), v in taken.items() if s == n) - total * shares[n]) <= 2 for n in names)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, sources array<string>, n_tokens int")
    mixed = mixing.mix(docs, TARGETS)
    assert mixed.count() == 0 and {r.tokens for r in mixing.mix_shares(mixed, TARGETS).collect()} == {0}


def test_source_names(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [" Daily-Note ", "WEB_CLIP", "qa answer", "", None]], "s string").select(mixing.source_name(F.col("s"))).collect()]
    assert got == ["daily_note", "web_clip", "qa_answer", None, None]


TERMS = [
    (1, "Fjord Taxonomy", ["FJRT"]), (2, "Piñata Planning", []), (3, "Walnut Composting Programme", None), (4, "Ember Framework", []), (5, "Timber Framework", []), (6, "Kelp Archiving", ["KLPA"]),
    (7, "Walnut Composting Programme Archive", []), (8, "AI Ops", []), (9, "R", []),
]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def brute_ids(words_of, values):
    """By the definition, without segments."""
    forms = [(w, i) for i, name, _ in TERMS for w in [words_of[name][k:] + words_of[name][:k] for k in range(len(words_of[name]))]]
    short = {"".join(words_of[s]): i for i, _, l in TERMS for s in l or []}
    out = {}
    for v in values:
        w = words_of.get(v) or []
        key = "".join(w)
        if not key:
            continue
        best = {}
        if key in short:
            best[short[key]] = (0, 0)
        for f, i in forms:
            ref = "".join(f)
            d = edits(key, ref)
            slip = lambda a, b: a == b or edits(a, b) == 1 and len(b) >= 2 or edits(a, b) == 2 and (len(b) >= 7 or len(b) >= 3 and sorted(a) == sorted(b))
            near = d == 0 or d <= len(ref) * 2 // 5 and (all(map(slip, w, f)) if len(f) == len(w) else d <= 2)
            if near:
                odd = sum(a[0] != b[0] for a, b in zip(w, f)) if d and len(f) == len(w) else 0
                best[i] = min((d, odd), best.get(i, (99, 0)))
        low = [i for i, d in best.items() if d == min(best.values())]
        if len(low) == 1:
            out[v] = low[0]
    return out


MANY_SLIPS = ["Wlanut Cmoposting Porgramme Archive", "Walnt Compostng Program Archve", "Walunt Compsoting Progarmme Acrhive"]


def test_canonical_against_all_comparisons(spark):
    rng = random.Random(9)
    values = ["[[fjord-taxonomy#x]]", "Notes on Fjord Taxonomy", "fjrt notes", "Taxonomy, Fjord", "PINATA PLANNING.md", "Glacier", "Fjord Taxonomy Basics", "Тimber Framewоrk", "Dir/walnut_composting_programme", "Tmber Framework", "Fjord Taxonomy", "", " ", "the", None, "x" * 5000, "FjordTaxonmy", "kepl archiivng", *MANY_SLIPS, "Embr Framework", "IA Ops", "A Ops", "AI Opps", "AIOps", "r", "rx", "walnutcomposting programme archive"]
    for _, name, _ in TERMS * 25:
        s = list(name)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(0, 2)] = rng.choice(["", "e", "x"])
        values.append("".join(s))
    df = spark.createDataFrame([(v, 1) for v in values + values[:3]], "value string, id int")
    terms = spark.createDataFrame(TERMS, "id int, name string, short_forms array<string>")
    names = [n for _, n, _ in TERMS] + [s for *_, l in TERMS for s in l or []]
    words = {r.value: list(r.w) for r in spark.createDataFrame([(v,) for v in {*values, *names} if v is not None], "value string").select("value", canonical.plain_words(F.col("value")).alias("w")).collect()}
    got = canonical.canonical_ids(df, terms)
    assert {r.value: r.id for r in got.collect()} == brute_ids(words, {v for v in values if v is not None})
    assert {"[[fjord-taxonomy#x]]", "fjrt notes", "Taxonomy, Fjord", "PINATA PLANNING.md", "Тimber Framewоrk"} <= {r.value for r in got.collect()}
    assert {r.value: r.id for r in got.where("value in ('Tmber Framework', 'Embr Framework')").collect()} == {"Tmber Framework": 5, "Embr Framework": 4}
    assert {r.value: r.id for r in got.where(F.col("value").isin(MANY_SLIPS)).collect()} == dict.fromkeys(MANY_SLIPS, 7)
    missing = {r.value: r.n_rows for r in canonical.unmatched(df, got).collect()}
    assert missing["Glacier"] == 1 and "Fjord Taxonomy Basics" in missing and not set(missing) & {r.value for r in got.collect()}
    assert canonical.canonical_ids(df.limit(0), terms).count() == 0 and canonical.canonical_ids(df, terms.limit(0)).count() == 0


def test_scheme_covers_every_pair_of_sizes():
    scheme = neardup.Scheme(0.6)
    for s in range(5, 400):
        r = math.floor(s / 0.6)
        assert scheme.band(np.array([r]))[0] - scheme.band(np.array([s]))[0] in (0, 1)


def test_marks_of_long_white_space_take_linear_time():
    pieces = tokens.vocabulary()
    marker = splitting._Marker(tokens.model_bytes(pieces), pieces)
    text = "\n" * 60_000 + " b"  # each place of the run was the start of a search through the rest of it
    marker.learn([text[:-2], " b"])
    began = time.process_time()
    marks, ends = marker.of(text, [text[:-2], " b"])
    assert time.process_time() - began < 2
    assert ends[-1] == len(text) and len(marks) == len(ends)


def test_pieces_at_the_end_of_the_marks(spark):
    rng = random.Random(3)
    marks = ["".join(rng.choices("cccwwwslphx", k=rng.randint(1, 90))) for _ in range(300)]
    pattern = splitting.piece_pattern(16, 4)
    plain = pattern.replace("}+\\z", "}\\z")  # with all shorter ends tried as well
    assert plain != pattern
    found = [F.regexp_extract_all("m", F.lit("(?s)" + p), F.lit(0)) for p in (pattern, plain)]
    assert spark.createDataFrame([(m,) for m in marks], "m string").where(found[0] != found[1]).count() == 0


def test_shingles_of_many_texts_at_once():
    rng = random.Random(8)
    texts = [None, "", "a b", "é 漢字 x_y"] + [" ".join(rng.choices("abcdefg", k=rng.randint(1, 40))) for _ in range(200)]
    shingler = neardup.Shingler(3, 5)
    places, sizes, shingles = shingler.of(texts)
    words = [shingler.words(t or "") for t in texts]
    assert places == [k for k, w in enumerate(words) if len(w) >= 5]
    assert sizes.tolist() == [len(set(zip(words[k], words[k][1:], words[k][2:]))) for k in places]  # none reaches into the next text
    alone = [shingler.of([texts[k]])[2] for k in places]
    assert np.array_equal(shingles, np.concatenate(alone)) and all((np.diff(a.astype(np.int64)) > 0).all() for a in alone)


def test_stable_order():
    rng = np.random.default_rng(1)
    for top in (5, 1 << 40, (1 << 63) - 1):
        keys = rng.integers(0, top, 5000)
        assert np.array_equal(neardup.stable_order(keys), np.argsort(keys, kind="stable"))

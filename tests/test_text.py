import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import text as t
from vellumflow.functions.python_udfs import sequence_ratio, yaml_fields

TEXTS = [
    "", "plain", "see [[A]] and [[B|b]] and [[ ]] [[C#h]]", "é#no #yes #42 #a/b-c end#x", "[k:: v] [k:: w] [a b:: c d]", "line ^blk-1  ", "# T\n## U\ntext ^id\n###no",
    "```\n# code\n```\n# after", "> !WARNING Watch\n[X] [x] [ ] [Real Thing] [link](http://x) status:: open [[[Y]]]", None, "a\r\nb", "[[" * 50, "#" * 200,
]


def run(spark, column, texts=TEXTS):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").select("i", column(F.col("c")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_links_tags_fields_against_python(spark):
    links = run(spark, t.wikilinks)
    tags = run(spark, t.tags)
    fields = run(spark, t.dataview_fields)
    for text, a, b, c in zip(TEXTS, links, tags, fields):
        if text is None:
            assert a is None and b is None and c is None
            continue
        assert a == [x.strip() for x in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", text) if x.strip()]
        assert b == sorted({"#" + x.lower() for x in re.findall(r"(?<!\w)#([a-zA-Z0-9_\-/]+)\b", text) if not x.isdigit()})
        assert c == {k.strip(): v.strip() for k, v in re.findall(r"\[([a-zA-Z0-9_\-\s]+)::\s*([^\]]+)\]", text)}


def test_links_of_very_long_text(spark):
    long = "[[A]]" + "x" * 150_000 + "[[B]]"
    assert run(spark, t.wikilinks, [long]) == [["A", "B"]] and run(spark, lambda c: t.wikilinks(c, 100_000), [long, "[[A]]"]) == [[], ["A"]]


def test_normalise(spark):
    got = run(spark, t.normalise_markdown, [TEXTS[8]])[0]
    assert got == "> [!WARNING] Watch\n[X] [x] [ ] [[Real Thing]] [link](http://x) [status:: open] [[Y]]"


def test_only_balanced_runs_of_brackets_are_cut(spark):
    assert run(spark, t.normalise_markdown, ["a [[[ b ]] c", "[[[[N]]]", "[[[N]] x", "[[[a\nb]]]"]) == ["a [[[ b ]] c", "[[N]]", "[[[N]] x", "[[[a\nb]]]"]


def test_frontmatter(spark):
    texts = ["---\ncreated: 2026-08-15\ntags:\n  - a\n  - b\n---\nBody", "no", "---\n: [bad\n---\nrest", "--- only"]
    assert run(spark, t.body, texts) == ["\nBody", "no", "\nrest", "--- only"]
    fields = run(spark, lambda c: yaml_fields(t.frontmatter_block(c)), texts)
    assert fields[0]["created"] == "2026-08-15" and fields[1:] == [{}, {}, {}]


def test_tasks(spark):
    texts = ["- [ ] Ship [[X]] ➕ 2026-08-01 📅 2026-08-03 [priority:: high] ^t1", "* [x] done #low", "+ [ ] plain [due:: 2026-01-02]", "- no task", None]
    a, b, c, d, e = run(spark, t.parse_task, texts)
    assert (a.completed, a.task_text, a.created_date, a.due_date, a.priority, a.block_id) == (False, "Ship [[X]]", "2026-08-01", "2026-08-03", "high", "t1")
    assert b.completed and b.priority == "low" and c.due_date == "2026-01-02" and d is None and e is None


def test_due_dates(spark):
    today = F.lit("2026-08-21").cast("date")
    texts = ["I am required to finish by Sunday", "call tomorrow", "today!", "on friday", "this Monday or by sunday", "nothing"]
    assert run(spark, lambda c: t.due_date(c, today), texts) == ["2026-08-23", "2026-08-22", "2026-08-21", "2026-08-28", "2026-08-24", None]
    assert run(spark, t.sounds_like_task, texts[:1] + ["hello"]) == [True, False]


def test_temporal_filter(spark):
    today = F.lit("2026-08-21").cast("date")
    got = run(spark, lambda c: t.temporal_filter(c, today), ["on 2026-07-14", "in 2026-08", "today?", "Yesterday", "last month", "this month", "last week"])
    assert [(r.date, r.month) for r in got] == [("2026-07-14", None), (None, "2026-08"), ("2026-08-21", None), ("2026-08-20", None), (None, "2026-07"), (None, "2026-08"), (None, None)]


def test_stems(spark):
    assert run(spark, t.term_stem, ["Distributed Systems", "Database Notes", "Categories", "Glass", "ss"]) == ["distributed system", "database", "category", "glass", "ss"]


def test_tokens(spark):
    got = run(spark, t.lexical_tokens, ["The [[Hybrid Search|x]] of c.d a", ""])
    assert got == [["hybrid", "search", "c.d", "hybrid search", "hybrid", "search"], []]


def test_uuid5(spark):
    names = ["a.md#0", "Ünï/x y.md#12", ""]
    assert run(spark, t.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_task_syntax_and_entry_line(spark):
    got = run(spark, lambda c: t.as_tasks(c, F.lit("2026-08-15 02:08"), F.lit(None).cast("string")), ["* [ ] buy milk 📅 2026-09-01\n\nwrite [Report]"])[0]
    assert got == "- [ ] buy milk ➕ 2026-08-15 📅 2026-09-01\n- [ ] write [[Report]] ➕ 2026-08-15 📅 2026-08-15"
    none = F.lit(None).cast("string")
    line = lambda c: t.entry_line(c, F.lit("2026-08-15 02:08"), F.lit("task"), F.lit("2026-08-20"), F.create_map(F.lit("k"), F.lit("v")), F.lit("^b1"), none, F.lit("2026-08-15"))
    assert run(spark, line, ["call Bob"])[0] == "- [ ] call Bob ➕ 2026-08-15 📅 2026-08-20 [k:: v] ^b1"


def test_entries_without_a_time_stay_in_their_daily_note(spark, tmp_path):
    from vellumflow.plans import notes

    kinds = "entry_no long, vault_id long, entry_date string, timestamp string, category string, content string, due_date string, dataview_fields map<string,string>, block_id string, callout_type string"
    rows = [(1, 1, "2026-08-15", None, "log", "call Bob", None, {"k": "v"}, "b1", None), (2, 1, "2026-08-15", "2026-08-15 02:08", None, "met Ann", None, None, None, None), (3, 1, "2026-08-15", None, None, "mind it", None, None, None, "note")]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/interstitial_entries.parquet")
    lines = {r.entry_no: r.line for r in notes.entry_lines(spark, str(tmp_path)).collect()}
    assert lines == {1: "- call Bob [k:: v] ^b1", 2: "- **[02:08]** met Ann", 3: "> [!NOTE]\n> - mind it"}
    day = notes.daily_notes(spark, str(tmp_path)).collect()
    assert [r.n_entries for r in day] == [3] and all(x in day[0].body for x in lines.values())


def test_routes(spark):
    none = F.lit(None).cast("string")
    assert run(spark, lambda c: t.route(c, none), ["/ask what", "/tasks", "show my pending tasks", "note", "", "/reindex"]) == ["query", "tasks", "tasks", "capture", "none", "reindex"]


def test_citation(spark):
    got = run(spark, lambda c: t.citation(c, F.lit("Setup"), F.lit("b1")), ["Note"])[0]
    assert got == "• [[Note]]\n  → ## Setup\n  → ^b1"


def cut_by_hand(text, most):
    """The rule of message_parts in plain Python: where the next message ends."""
    out, rest = [], text.strip()
    while len(rest) > most:
        ends = [rest.rfind(m, 0, most) for m in ("\n\n## ", "\n\n# ", "\n\n")]
        late = [e for e in (rest.rfind(m, 0, most) for m in ("\n", " ")) if e >= most // 2]
        end = next((e for e in ends if e > 0), None) or (late[0] if late else most)
        out.append(rest[:end].strip())
        rest = rest[end:].strip()
    return [x for x in (*out, rest) if x]


def test_message_parts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word", " ", " ", "\n", "\n\n", "\n\n# T ", "\n\n## U ", "x" * 9]) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    got = run(spark, lambda c: t.message_parts(c, 60), [*texts, "", None, " " * 100])
    for text, parts in zip(texts, got):
        assert parts == ([text] if 0 < len(text) <= 60 else cut_by_hand(text, 60) or [text]), text
        assert all(len(p) <= 60 for p in parts) or not text.strip()
    assert got[-3:] == [[""], [""], [" " * 100]]


def test_chat_html(spark):
    raw = "What [Green Tea] needs:\n\n***\n\n### 2. Water\n Heat: eighty degrees\n [Steeping Time|minutes]: in [Kitchen]\n\n**Seen in:**\n• [[2026-01-09]] → ## Log"
    shown = run(spark, t.chat_markdown, [raw])[0]
    assert "🔹 *2. Water*" in shown and "─" * 23 in shown and "[[Steeping Time|minutes]]" in shown
    html = run(spark, lambda c: t.chat_html(t.chat_markdown(c)), [raw])[0]
    assert "<b>2. Water</b>" in html and "<b>Seen in:</b>" in html and "[[Green Tea]]" in html
    texts = ["**b** `a<b` <x> & *c* _it_ ~~s~~ a_b_c 2*3*4", "```py\nif a < b: *x*\n``` then `*y*` [t](https://u.v/w)", "*bold `code` on*", "", None]
    assert run(spark, t.chat_html, texts) == [
        "<b>b</b> <code>a&lt;b</code> &lt;x&gt; &amp; <b>c</b> <i>it</i> <s>s</s> a_b_c 2*3*4",
        '<pre><code>if a &lt; b: *x*\n</code></pre> then <code>*y*</code> <a href="https://u.v/w">t</a>', "<b>bold <code>code</code> on</b>", "", None,
    ]


def test_small_rewrites(spark):
    assert run(spark, t.button_text, ["See [[Note|the *note*]] and [[Other]]", "x" * 40, None]) == ["See the note and Other", "x" * 33 + "...", None]
    assert run(spark, t.safe_file_name, [' a/b:c*"d" ', None]) == ["a_b_c__d_", None]
    assert run(spark, t.view_text, ["---\na: 1\n---\n# Title\nbody", "# T\n\nx", None]) == ["body", "x", None]
    assert run(spark, t.payload_of, ['{"structured_output": {"a": 1}}', '{"response": "```json\\n{}\\n```"}', "```\nplain\n```", "text", None]) == ['{"a":1}', "{}", "plain", "text", None]
    errors = run(spark, lambda c: t.error_of(c, F.lit("warn")), ['{"error": " bad "}', "out", "", None])
    assert errors == ["bad (stderr: warn)", "warn | stdout: out", "warn", "warn"]
    assert run(spark, lambda c: t.error_of(c, F.lit(None).cast("string")), ["only", None]) == ["only", "No error message provided on stdout or stderr"]
    note = run(spark, lambda c: t.atomic_note(c, F.lit("Body"), F.array(F.lit("#x")), F.lit("2026-01-02"), F.lit("2026-01-01")), ["T"])[0]
    assert note.startswith("---\ncreated: 2026-01-02\n") and '"[[2026-01-01]]"' in note and note.endswith("# T\n\nBody\n") and "  - x\n" in note
    assert run(spark, lambda c: t.as_tags(t.listed(c)), ["#A, b,, C ", None]) == [["#a", "#b", "#c"], None]


def test_sequence_ratio(spark):
    assert run(spark, lambda c: sequence_ratio(c, F.lit("local ai")), ["Local AI ", None]) == [pytest.approx(1.0), None]

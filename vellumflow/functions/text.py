"""Scalar text functions over note Markdown, as Column expressions that stay inside the JVM.

Java's regex dialect is adapted to the semantics wanted here: ``(?U)`` where word characters are Unicode, ``(?d)`` where
only ``\\n`` ends a line. Null in, null out, unless a function says otherwise; lists of nothing are empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
ISO = r"\d{4}-\d{2}-\d{2}"

# Words left out of the lexical index.
STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "can", "can't", "cannot", "could", "did", "do", "does", "doing", "don't", "down",
    "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "with", "would", "you",
    "your", "yours", "yourself", "yourselves",
]
# Phrases that mark a sentence as a task.
TASK_PHRASES = [
    "required to", "need to", "needs to", "have to", "has to", "must ", "remember to", "todo", "to-do", "should ", "due ", "finish ",
    "by sunday", "by monday", "by tuesday", "by wednesday", "by thursday", "by friday", "by saturday", "by tomorrow", "by today",
]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# Section headers of a daily note, by entry category.
INBOX, LOG, TASKS, DISCOVERIES = "## 📥 Inbox (Quick Capture)", "## ⏱️ Log (Interstitial)", "## 🎯 Priorities & Tasks", "## 🧠 Discoveries & Learning"
HEADERS = {
    INBOX: ["inbox", "quick capture", "quick_capture", "capture"],
    LOG: ["log", "interstitial", "work", "thought", "journal", "general"],
    TASKS: ["task", "tasks", "priority", "priorities", "todo"],
    DISCOVERIES: ["discovery", "discoveries", "learning", "learn"],
}
# Phrases of an assistant talking about itself instead of the content.
CHATTER = [
    "awaiting user", "no task was specified", "ready to assist", "session initiated", "no specific task", "awaiting task",
    "awaiting instructions", "completed response", "user request",
]
# Commands and phrases that ask for the task list.
TASK_COMMANDS = ["/tasks", "/task", "/todo", "/todos", "/pending", "/due", "/briefing", "/digest", "/schedule", "/today"]
TASK_PREFIXES = ["/tasks", "/todo", "/pending", "/due", "/briefing", "/digest"]
TASK_QUESTIONS = (
    r"\b(what('s| is| are)? (my|the|all)? ?(pending|active|due)? ?(tasks|todos|to-dos|action items))\b"
    r"|\b(show|list|get|view|give|check|display) (me )?(all )?(my )?(pending |due |active )?(tasks|todos|to-dos|action items)\b"
    r"|\b(pending|active|due) (tasks|todos|to-dos|action items)\b|\b(what('s| is| are) due (today|tomorrow|soon))\b"
    r"|\b(what do i have due)\b|\b(any (pending )?(tasks|todos|to-dos) (due )?(today|soon)?)\b"
)


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def wikilinks(c: Column, longest: int | None = None) -> Column:
    """Targets of ``[[target|shown]]`` links in order, with repeats. ``longest``: characters beyond which a text gives none (default: no such bound)."""
    links = F.filter(F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)), strip), lambda x: x != "")
    return links if longest is None else F.when(F.length(c) > longest, F.array().cast("array<string>")).otherwise(links)


def block_id(c: Column) -> Column:
    return found(strip(c), r"\^([a-zA-Z0-9_-]+)\s*$")


def dataview_fields(c: Column) -> Column:
    """``[key:: value]`` fields as a map; the last of equal keys wins."""
    pattern = r"\[([a-zA-Z0-9_\-\s]+)::\s*([^\]]+)\]"
    keys = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip)
    values = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), strip)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    n = F.size(keys)
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(n - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(last)


def tags(c: Column) -> Column:
    """``#tag``s, lower case, sorted and distinct; numbers are no tags."""
    got = F.regexp_extract_all(c, F.lit(r"(?U)(?<!\w)#([a-zA-Z0-9_\-/]+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(got, lambda t: ~t.rlike(r"^\d+$")), lambda t: F.concat(F.lit("#"), F.lower(t)))))


def listed(c: Column) -> Column:
    """Items of a comma-separated string, stripped, without empty ones (aliases in frontmatter)."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def as_tags(items: Column) -> Column:
    """Frontmatter tags in one form: ``#`` and lower case."""
    return F.transform(items, lambda t: F.concat(F.lit("#"), F.lower(F.regexp_replace(strip(t), r"^#+", ""))))


def headings(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?md)^#{1,6}[ \t]+(.+)$"), F.lit(1)), strip)


def block_ids(c: Column) -> Column:
    """``^id`` at line ends, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?md)\^([a-zA-Z0-9_-]+)\s*$"), F.lit(1)), lambda x: F.concat(F.lit("^"), x))


def frontmatter_block(c: Column) -> Column:
    """The raw YAML between the leading ``---`` and the next ``---``; null without such a block."""
    parts = F.split(c, "---", 3)
    return F.when(F.startswith(c, F.lit("---")) & (F.size(parts) == 3), parts[1])


def body(c: Column) -> Column:
    """The text without its frontmatter block."""
    return F.when(frontmatter_block(c).isNotNull(), F.split(c, "---", 3)[2]).otherwise(c)


def frontmatter_value(c: Column, key: str) -> Column:
    """A scalar of the frontmatter's top level, without quotes."""
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(frontmatter_block(c), rf"(?m)^{key}:[ \t]*(.*)$", 1)), r"^[\"']|[\"']$", ""), F.lit(""))


# What loose Markdown is rewritten to, in this order: callouts, aliased links in single brackets, bare fields,
# single-bracket links (no checkboxes, images, numbers, fields, block ids or link texts), runs of three and more brackets.
LOOSE = [
    (r"(?md)^>\s*!([A-Z]+)\b(.*)$", r"> [!$1]$2"),
    (r"(?<!\[)\[([^\[\]\n|]+)\|([^\[\]\n]+)\](?!\])", r"[[$1|$2]]"),
    (r"(?U)(?<![\[(])\b([a-zA-Z0-9_\-]+)::\s*([a-zA-Z0-9_\-/]+)(?![\])])", r"[$1:: $2]"),
    (r"(?U)(?<!\[)\[[^\S\n]*+(?!\]|[xX/\-]\s*\]|[!\^]|\d+[^\S\n]*\]|[^\[\]\n|]*::)([^\[\]\n|]+?)[^\S\n]*\](?!\s*[(\]])", r"[[$1]]"),
    (r"\[{3,}([^\[\]\n]+)\]{3,}", r"[[$1]]"),
]


def rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after each ``(pattern, replacement)`` in turn."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalise_markdown(c: Column) -> Column:
    """Loose Markdown in the form that notes use (:data:`LOOSE`)."""
    return rewritten(c, LOOSE)


def links_of_loose_text(c: Column) -> Column:
    """Links after :func:`normalise_markdown`."""
    return F.filter(F.transform(F.regexp_extract_all(normalise_markdown(c), F.lit(LINK), F.lit(1)), strip), lambda x: x != "")


def without_checkbox(c: Column) -> Column:
    c = F.regexp_replace(c, r"^[-*+]\s*(\[\s*[xX]?\s*\])?\s*", "")
    return strip(F.regexp_replace(c, rf"[➕📅]\s*{ISO}", ""))


def as_tasks(c: Column, stamp: Column, due: Column) -> Column:
    """Every non-blank line as ``- [ ] body ➕ created 📅 due``, dates of the line first, then those given."""
    created = F.when(F.contains(stamp, F.lit(" ")), F.split(stamp, " ")[0]).otherwise(F.substring(stamp, 1, 10))
    lines = F.filter(F.transform(F.split(strip(c), r"\r\n|[\n\r\u000B\f\u0085  ]"), strip), lambda x: x != "")

    def line(x: Column) -> Column:
        own_created, own_due = found(x, rf"➕\s*({ISO})"), found(x, rf"📅\s*({ISO})")
        return F.concat(F.lit("- [ ] "), normalise_markdown(without_checkbox(x)), F.lit(" ➕ "), F.coalesce(own_created, created), F.lit(" 📅 "), F.coalesce(own_due, due, created))

    return F.array_join(F.transform(lines, line), "\n")


def sounds_like_task(c: Column) -> Column:
    low = F.lower(c)
    hit = F.lit(False)
    for phrase in TASK_PHRASES:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def due_date(c: Column, today: Column) -> Column:
    """Due date named in a sentence: tomorrow, today, or ``by|on|this|due <weekday>`` (the next one, never today), Monday first."""
    low = F.lower(c)
    out = F.when(F.contains(low, F.lit("tomorrow")), F.date_add(today, 1)).when(F.contains(low, F.lit("today")), today)
    for n, name in enumerate(WEEKDAYS):
        ahead = F.pmod(F.lit(n) - F.weekday(today), F.lit(7))
        out = out.when(low.rlike(rf"\b(?:by|on|this|due)\s+{name}\b"), F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead)))
    return out.cast("string")


def temporal_filter(c: Column, today: Column) -> Column:
    """``struct(date, month)`` that a question is about: ISO date, ISO month, today, yesterday, last month, this month."""
    low = F.lower(c)
    iso_day, iso_month = found(low, r"\b(\d{4}-\d{2}-\d{2})\b"), found(low, r"\b(\d{4}-\d{2})\b")
    is_today, is_yesterday = F.contains(low, F.lit("today")), F.contains(low, F.lit("yesterday"))
    day = F.when(iso_day.isNotNull(), iso_day).when(iso_month.isNotNull(), None).when(is_today, today.cast("string")).when(is_yesterday, F.date_sub(today, 1).cast("string"))
    month = F.when(iso_day.isNotNull(), None).when(iso_month.isNotNull(), iso_month).when(is_today | is_yesterday, None)
    month = month.when(F.contains(low, F.lit("last month")), F.date_format(F.add_months(today, -1), "yyyy-MM")).when(F.contains(low, F.lit("this month")), F.date_format(today, "yyyy-MM"))
    return F.struct(day.cast("string").alias("date"), month.cast("string").alias("month"))


def lexical_tokens(c: Column) -> Column:
    """Tokens of the lexical index: words without stop words and single letters, then link targets as one token and as words."""
    low = F.lower(c)
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9_\-.#]+)"), F.lit(1)), lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1))
    targets = F.filter(F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)), lambda x: F.lower(strip(x))), lambda x: x != "")
    parts = F.flatten(F.transform(targets, lambda t: F.concat(F.array(t), F.regexp_extract_all(t, F.lit(r"(?U)(\w+)"), F.lit(1)))))
    return F.coalesce(F.concat(words, parts), F.array().cast("array<string>"))


def term_stem(c: Column) -> Column:
    """A term without filler words and with its plural ending cut."""
    t = strip(F.lower(c))
    t = strip(F.regexp_replace(t, r"\b(notes?|guide|docs?|concepts?)\b", ""))
    n = F.length(t)
    return (
        F.when(F.endswith(t, F.lit("ies")) & (n > 4), F.regexp_replace(t, "ies$", "y"))
        .when(F.endswith(t, F.lit("es")) & (n > 3), F.regexp_replace(t, "es$", ""))
        .when(F.endswith(t, F.lit("s")) & (n > 3) & ~F.endswith(t, F.lit("ss")), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def button_text(c: Column) -> Column:
    """Short plain text: links by what they show, without marks, at most 36 characters."""
    t = F.regexp_replace(c, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"[#*`_~]", ""), r"(?U)\s+", " "))
    return F.when(F.length(t) > 36, F.concat(F.substring(t, 1, 33), F.lit("..."))).otherwise(t)


def safe_file_name(c: Column) -> Column:
    return strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))


def section_header(category: Column) -> Column:
    """Section of the daily note that an entry category belongs to; unknown ones and null go to the log."""
    key = F.lower(strip(category))
    out = F.when(F.lit(False), F.lit(""))
    for header, names in HEADERS.items():
        out = out.when(key.isin(names), F.lit(header))
    return F.coalesce(out, F.lit(LOG))


def entry_line(content: Column, stamp: Column, category: Column, due: Column, fields: Column, block: Column, callout: Column, day: Column) -> Column:
    """A daily-note line of an entry: callout or task as it is, task with dates, else a log line (without the time mark if the time is null); then missing fields, block id and callout frame."""
    text = normalise_markdown(strip(content))
    shown = F.when(F.contains(stamp, F.lit(" ")), F.regexp_extract(stamp, r"([^ ]*)$", 1)).otherwise(stamp)
    bare = F.regexp_replace(text, r"(?U)^\s+", "")
    is_callout = F.startswith(bare, F.lit("> [!"))
    written = F.startswith(bare, F.lit("- [ ]")) | F.startswith(bare, F.lit("- [x]"))
    is_task = F.lower(strip(category)).isin("task", "tasks", "priority", "priorities", "todo")
    task = F.concat(F.lit("- [ ] "), without_checkbox(text), F.lit(" ➕ "), day, F.lit(" 📅 "), F.coalesce(due, day))
    time = F.coalesce(F.concat(F.lit("**["), shown, F.lit("]** ")), F.lit(""))
    line = F.when(is_callout | written, text).when(is_task, task).otherwise(F.concat(F.lit("- "), time, text))
    extra = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("["), e["key"], F.lit(":: "), e["value"], F.lit("]")))
    missing = F.array_join(F.filter(F.coalesce(extra, F.array().cast("array<string>")), lambda x: ~F.contains(line, x)), " ")
    line = F.when(missing != "", F.concat(line, F.lit(" "), missing)).otherwise(line)
    mark = F.concat(F.lit("^"), strip(F.regexp_replace(block, r"^\^+", "")))
    line = F.when(mark.isNotNull() & ~F.contains(line, mark), F.concat(line, F.lit(" "), mark)).otherwise(line)
    framed = F.concat(F.lit("> [!"), F.upper(strip(callout)), F.lit("]\n> "), line)
    return F.when(F.nullif(callout, F.lit("")).isNotNull() & ~is_callout, framed).otherwise(line)


# How a chat shows headings and callouts.
CHAT_HEADINGS = {1: "🏆", 2: "📌", 3: "🔹"}
CHAT_CALLOUTS = {"NOTE": "ℹ️", "WARNING": "⚠️", "TIP": "💡", "IMPORTANT": "❗", "CAUTION": "🛑"}
# Rules become a line, loose lines bullets.
CHAT_RULE = (r"(?md)^(?:---|\*\*\*|___)\s*$", "─" * 23)
CHAT_LOOSE = [(r"(?md)^\s+([A-Za-z0-9_\-\s]+:)\s*$", "• *$1*"), (r"(?md)^\s{1,2}(?=[A-Za-z0-9_\[])", "• ")]
# Markdown of a chat with its HTML.
CHAT_FENCE, CHAT_CODE = r"(?s)```([a-zA-Z0-9_\-+]*)\n(.*?)```", r"`([^`\n]+)`"
CHAT_TAGS = [
    (r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)", r'<a href="$2">$1</a>'),
    (r"\*\*([^*\n]+)\*\*", "<b>$1</b>"),
    (r"(?U)(?<![\w*])\*([^*\n]+)\*(?![\w*])", "<b>$1</b>"),
    (r"(?U)(?<!\w)_([^_\n\x{E000}\x{E001}]+)_(?!\w)", "<i>$1</i>"),
    (r"~~([^~\n]+)~~", "<s>$1</s>"),
]


def chat_markdown(c: Column) -> Column:
    """Markdown for a chat: rules, headings and callouts as styled lines, loose lines as bullets."""
    heads = [(rf"(?md)^#{{{n}}}\s+(.+)$", f"{icon} *$1*") for n, icon in CHAT_HEADINGS.items()]
    calls = [(rf"(?md)^>\s*\[!{name}\]\s*(.*)$", f"{icon} *{name.title()}: $1*") for name, icon in CHAT_CALLOUTS.items()]
    return rewritten(normalise_markdown(c), [CHAT_RULE, *heads, *calls, *CHAT_LOOSE])


def chat_html(c: Column) -> Column:
    """Chat Markdown as the small HTML that chats accept.

    Code gives way to one private-use character each while the rest is escaped and tagged, and is put back by its place;
    characters of a text that are these two themselves are left out. Null stays null.
    """
    escaped = lambda x: rewritten(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])
    c = F.regexp_replace(c, "[\ue000\ue001]", "")
    blocks = F.transform(F.regexp_extract_all(c, F.lit(CHAT_FENCE), F.lit(2)), lambda x: F.concat(F.lit("<pre><code>"), escaped(x), F.lit("</code></pre>")))
    c = F.regexp_replace(c, CHAT_FENCE, "\ue000")
    spans = F.transform(F.regexp_extract_all(c, F.lit(CHAT_CODE), F.lit(1)), lambda x: F.concat(F.lit("<code>"), escaped(x), F.lit("</code>")))
    c = rewritten(escaped(F.regexp_replace(c, CHAT_CODE, "\ue001")), CHAT_TAGS)
    for mark, kept in (("\ue001", spans), ("\ue000", blocks)):
        parts = F.split(c, mark)
        c = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(kept, i), F.lit("")))), "")  # noqa: B023
    return c


def message_parts(c: Column, most: int) -> Column:
    """A text as messages of at most ``most`` characters; a text that fits is one message as it is, null and empty texts give one empty one.

    One regex takes pieces from the left: up to the last second-level heading that fits, else first-level heading, else blank
    line, else the last line or space in the second half, else ``most`` characters. White space around a cut is left out.
    """
    half = most // 2
    start = r"(?sU)\G\s*"
    ways = [rf"\S.{{0,{most - 1}}}\z", *(rf"\S.{{0,{most - 1 - size}}}(?={mark})" for mark, size in (("\n\n## ", 5), ("\n\n# ", 4), ("\n\n", 2))), *(rf"\S.{{{half - 1},{most - 2}}}(?={mark})" for mark in ("\n", " ")), rf"\S.{{{most - 1}}}"]
    whole = strip(c)
    parts = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(f"{start}({'|'.join(ways)})"), F.lit(1)), strip), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), lit_array([""])).when(F.length(c) <= most, F.array(c)).otherwise(F.when(F.size(parts) > 0, parts).otherwise(F.array(c)))


def asks_for_tasks(c: Column) -> Column:
    t = strip(F.lower(c))
    hit = t.isin(TASK_COMMANDS)
    for prefix in TASK_PREFIXES:
        hit = hit | F.startswith(t, F.lit(prefix))
    return hit | t.rlike(TASK_QUESTIONS)


def route(text: Column, callback: Column) -> Column:
    """Where a chat message goes: the command of a button, the task list, a question, a reindex, or a note to keep."""
    t = F.lower(strip(text))
    button = F.when(F.startswith(callback, F.lit("done:")), F.lit("done")).when(F.startswith(callback, F.lit("view:")), F.lit("view"))
    button = button.when(F.startswith(callback, F.lit("create_atomic:")), F.lit("create_atomic")).when(F.startswith(callback, F.lit("ignore_atomic:")), F.lit("ignore_atomic")).otherwise(F.lit("unknown"))
    return (
        F.when(callback.isNotNull(), button)
        .when(t.isNull() | (t == ""), F.lit("none"))
        .when(asks_for_tasks(text), F.lit("tasks"))
        .when(t.rlike(r"^/(ask|query)\b"), F.lit("query"))
        .when(t.rlike(r"^/consolidate\b"), F.lit("consolidate"))
        .when(t.rlike(r"^/reindex\b"), F.lit("reindex"))
        .otherwise(F.lit("capture"))
    )


def is_chatter(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(" + "|".join(CHATTER) + r")\b")


def without_fence(c: Column) -> Column:
    """An answer without the code fence around it."""
    return strip(F.regexp_replace(strip(c), r"(?s)^```[a-zA-Z]*\s*\n(.*?)\n?```$", "$1"))


def payload_of(c: Column) -> Column:
    """The answer inside a JSON envelope (``structured_output``, ``response``), else the text itself, without a code fence."""
    wrapped = F.coalesce(F.get_json_object(c, "$.structured_output"), without_fence(F.get_json_object(c, "$.response")))
    return F.coalesce(wrapped, without_fence(c))


def error_of(out: Column, err: Column) -> Column:
    """What went wrong, from a runner's two outputs: the ``error`` of a JSON envelope first, then what was printed; bounded as a message."""
    out, err = F.coalesce(strip(out), F.lit("")), F.coalesce(strip(err), F.lit(""))
    named = F.nullif(strip(F.get_json_object(out, "$.error")), F.lit(""))
    beside = F.when(err != "", F.concat(F.lit(" (stderr: "), F.substring(err, 1, 500), F.lit(")"))).otherwise(F.lit(""))
    said = F.when((err != "") & (out != ""), F.concat(F.substring(err, 1, 1000), F.lit(" | stdout: "), F.substring(out, 1, 1000)))
    said = said.when(err != "", F.substring(err, 1, 1000)).when(out != "", F.substring(out, 1, 1000)).otherwise(F.lit("No error message provided on stdout or stderr"))
    return F.coalesce(F.concat(named, beside), strip(said))


def view_text(c: Column) -> Column:
    """A note's text for reading: without frontmatter and without its first-level heading."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)^---\n.*?\n---\n*", ""), r"^# [^\n]*\n*", ""))


def same_source(got: Column, wanted: Column) -> Column:
    """Does a retrieved path or title answer for an expected one? Equal, or one contains the other, without brackets, ``.md`` and case; of the expected path the last part counts."""
    plain = lambda x: F.lower(F.replace(x, F.lit(".md"), F.lit("")))
    a = strip(plain(F.regexp_replace(got, r"\[\[|\]\]", "")))
    b = strip(F.substring_index(plain(wanted), "/", -1))
    return F.contains(a, b) | F.contains(b, a)


def citation(title: Column, heading: Column, block: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("• [["), title, F.lit("]]")),
        F.when(~heading.eqNullSafe(title), F.concat(F.lit("  → ## "), heading)),
        F.concat(F.lit("  → ^"), block),
    )


def atomic_note(title: Column, content: Column, tags_: Column, created: Column, source: Column) -> Column:
    """Text of an atomic note: frontmatter, heading, body."""
    marks = F.array_join(F.transform(F.when(F.size(tags_) > 0, tags_).otherwise(lit_array(["atomic-note"])), lambda t: F.concat(F.lit("  - "), F.regexp_replace(t, "^#", ""))), "\n")
    return F.concat(F.lit("---\ncreated: "), created, F.lit("\ntype: atomic-note\ntags:\n"), marks, F.lit('\nsource_daily_note: "[['), source, F.lit(']]"\n---\n\n# '), title, F.lit("\n\n"), content, F.lit("\n"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5), in the DNS namespace by default."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def parse_task(line: Column) -> Column:
    """A checkbox line as a struct (null for other lines): completed, text, created, due, priority, block id."""
    text = strip(line)
    pattern = r"^[-*+]\s*\[([ xX])\]\s*(.*)$"
    b = strip(F.regexp_extract(text, "(?s)" + pattern, 2))
    priority = F.coalesce(
        strip(found(b, r"(?i)\[priority::\s*([^\]]+)\]")),
        F.when(b.rlike(r"(?i)#high\b") | F.contains(b, F.lit("[#A]")), F.lit("high"))
        .when(b.rlike(r"(?i)#medium\b") | F.contains(b, F.lit("[#B]")), F.lit("medium"))
        .when(b.rlike(r"(?i)#low\b") | F.contains(b, F.lit("[#C]")), F.lit("low")),
    )
    clean = F.regexp_replace(b, rf"[➕📅]\s*{ISO}", "")
    clean = F.regexp_replace(clean, r"\[(?:due|category|priority|platform|status)::\s*[^\]]+\]", "")
    clean = strip(F.regexp_replace(F.regexp_replace(clean, r"\^[a-zA-Z0-9_-]+\s*$", ""), r"(?U)\s+", " "))
    return F.when(
        text.rlike(pattern),
        F.struct(
            (F.lower(F.regexp_extract(text, pattern, 1)) == "x").alias("completed"),
            clean.alias("task_text"),
            found(b, rf"➕\s*({ISO})").alias("created_date"),
            F.coalesce(found(b, rf"📅\s*({ISO})"), found(b, rf"\[due::\s*({ISO})\]")).alias("due_date"),
            priority.alias("priority"),
            found(b, r"\^([a-zA-Z0-9_-]+)\s*$").alias("block_id"),
        ),
    )


def task_id(path: Column, line_number: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", path, line_number.cast("string"), F.substring(text, 1, 40))), 1, 8)


def due_bucket(due: Column, daily: Column, today: Column) -> Column:
    """overdue, today, next2 or upcoming; undated tasks of today's note count for today. Dates compare as text."""
    day = today.cast("string")
    return (
        F.when(due.isNotNull() & (due < day), F.lit("overdue"))
        .when(due == day, F.lit("today"))
        .when(due.isin(F.date_add(today, 1).cast("string"), F.date_add(today, 2).cast("string")), F.lit("next2"))
        .when(due.isNull() & (daily == day), F.lit("today"))
        .otherwise(F.lit("upcoming"))
    )

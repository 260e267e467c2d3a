"""SQL twins of the note queries, for DuckDB on the same tables."""

from __future__ import annotations

from ..functions.text import CHAT_CALLOUTS, CHAT_HEADINGS, CHATTER, HEADERS, LOG, STOPWORDS, TASK_COMMANDS, TASK_PHRASES, TASK_PREFIXES, TASK_QUESTIONS, TASKS, WEEKDAYS

TODAY = "date '2026-05-01'"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def strip_all(x: str) -> str:
    """White space of any kind off both ends."""
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TOKENS = f"""
list_concat(
  list_filter(regexp_extract_all(lower(text), '[a-z0-9_\\-.#]+'), lambda x: len(x) > 1 and x not in ({quoted(STOPWORDS)})),
  flatten(list_transform(list_filter(list_transform(regexp_extract_all(text, '{_LINK}', 1), lambda x: lower({strip("x")})), lambda x: x <> ''),
    lambda x: list_concat([x], regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')))))"""
_INDEX = f"""
index_ as (select id, case when len(tokens) = 0 then ['empty'] else tokens end as tokens from (select doc_id as id, coalesce({_TOKENS}, []) as tokens from {{docs}})),
stats as (select count(*) as n, avg(len(tokens)) as avgdl from index_),
"""
_QUESTIONS = f"""
asked as (select term_id as qid, unnest(tokens) as term from (select term_id, {_TOKENS} as tokens from (select term_id, term as text from topic_terms where term_id % 20 = 0))),
terms as (select qid, term, count(*) as qtf from asked group by all),
"""


def bm25(k: int, docs: str = "documents") -> str:
    return f"""
{_INDEX.replace("{docs}", docs)} {_QUESTIONS}
words as (select id, len(tokens) as dl, unnest(tokens) as term from index_),
hits as (select id, dl, term, count(*) as tf from words where term in (select term from terms) group by all),
df as (select term, count(*) as df from hits group by term),
weights as (select qid, term, qtf * ln((n + 1) / df) as w, avgdl from terms join df using (term), stats),
base as (select qid, sum(w) as base from weights group by qid),
matched as (select qid, id, sum(w * tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)) as m from hits join weights using (term) group by all),
scored as (select qid, id, round(base + coalesce(m, 0), 9) as score from base cross join (select id from index_) left join matched using (qid, id)),
sparse as (select qid, id, greatest(score, 0.01) as score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from scored) where rank <= {k})"""


_DENSE = """
vectors as (select vec_id as id, embedding::double[] as v, label from embeddings),
pairs as (
  select q.id as qid, d.id, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) as score
  from vectors q join vectors d on q.id <> d.id {same} where q.id % 20 = 0 {more}),
ranked as (select *, row_number() over (partition by qid order by score desc, id) as rank from pairs {where}),
dense as (select * from ranked where rank <= {k})"""


def dense(k: int, same: str = "", more: str = "", where: str = "") -> str:
    return _DENSE.format(k=k, same=same, more=more, where=where)


def _hashed(docs: str, key: str, text: str) -> str:
    """Token counts hashed to 64 signed dimensions; ``docs`` has the columns ``key`` and ``text``."""
    tokens = _TOKENS.replace("lower(text)", f"lower({text})").replace("(text,", f"({text},")
    return f"""(select id, list_transform(range(0, 64), lambda i: len(list_filter(h, lambda x: x // 2 % 64 = i and x % 2 = 0)) - len(list_filter(h, lambda x: x // 2 % 64 = i and x % 2 = 1))) as v
  from (select {key} as id, list_transform(coalesce({tokens}, []), lambda w: ('0x' || substr(md5(w), 1, 6))::int) as h from {docs}))"""


def _unit(v: str) -> str:
    """The vectors of ``v (id, v)`` with unit length in single precision, as they are stored."""
    return f"(select id, list_transform(v, lambda x: case when n > 0 then x / n else 0 end)::float[]::double[] as v from (select id, v, sqrt(list_dot_product(v::double[], v::double[])) as n from {v}))"


_COSINE = "round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9)"
_VECTORS = f"""
doc_vectors as (select * from {_unit(_hashed("documents", "doc_id", "text"))}),
asked_vectors as (select * from {_unit(_hashed("(select term_id, term from topic_terms where term_id % 20 = 0)", "term_id", "term"))}),
cosines as (select q.id as qid, d.id, {_COSINE} as score from asked_vectors q cross join doc_vectors d where list_dot_product(q.v, q.v) > 0 and list_dot_product(d.v, d.v) > 0),
dense as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from cosines) where rank <= 30)"""


def fused(weight: float = 1.0) -> str:
    return f"""
with {_VECTORS}, {bm25(30)},
both_ as (
  select qid, id, d.score as ds, s.score as ss, d.rank as dr, s.rank as sr,
    round(coalesce(1.0 / (60 + d.rank), 0) + coalesce({weight} / (60 + s.rank), 0), 12) as rrf_score
  from dense d full join sparse s using (qid, id)),
fused as (select qid, id, rrf_score, coalesce(ds, 0) as dense_score, coalesce(ss, 0) as sparse_score, dr as dense_rank, sr as sparse_rank,
  row_number() over (partition by qid order by rrf_score desc, dr nulls last, sr nulls last, id) as rank from both_)"""


_BOOSTED = (
    fused()
    + """,
boosted as (
  select qid, id, round(rrf_score * case when strftime(created_at, '%Y-%m-%d') like '%2025-03%' or file_path like '%2025-03%' then 1.4 else 1 end, 12) as boosted, rank as r0
  from fused join documents on doc_id = id),
final as (select qid, id, boosted, row_number() over (partition by qid order by boosted desc, r0) as rank from boosted)"""
)
_EDGES = f"""
nodes as (select * from note_nodes where deleted_at is null and title is not null),
names as (select vault_id, lower(n) as alias, title, node_no from (select vault_id, title, node_no, unnest(list_concat([title], coalesce(aliases, []))) as n from nodes) where n is not null),
aliases as (select vault_id, alias, arg_max(title, (node_no, title)) as title from names group by all),
links as (
  select distinct vault_id, src, {strip("regexp_replace(raw, '[|#].*$', '', 's')")} as name
  from (select vault_id, title as src, regexp_replace({strip("l")}, '\\[\\[|\\]\\]', '', 'g') as raw from (select vault_id, title, unnest(outgoing_links) as l from nodes))),
edges as (
  select distinct l.vault_id as scope, src, coalesce(t.title, a.title) as dst from links l
  left join (select distinct vault_id, title from nodes) t on t.vault_id = l.vault_id and t.title = l.name
  left join aliases a on a.vault_id = l.vault_id and a.alias = lower(l.name)
  where l.name <> '' and coalesce(t.title, a.title) is not null),
near as (select scope, src, dst from edges where src <> dst union select scope, dst, src from edges where src <> dst)"""
_TASKS = f"""
lines as (select entry_no, vault_id, 'Daily Notes/' || entry_date || '.md' as path, entry_date, unnest(range(0, len(l)))::int as line_number, unnest(l) as raw_line
  from (select entry_no, vault_id, entry_date, string_split(content, chr(10)) as l from interstitial_entries)),
bodies as (select *, {strip("regexp_extract(" + strip("raw_line") + ", '(?s)^[-*+]\\s*\\[([ xX])\\]\\s*(.*)$', 2)")} as b from lines where regexp_matches({strip("raw_line")}, '^[-*+]\\s*\\[([ xX])\\]\\s*(.*)$')),
tasks as (
  select entry_no, vault_id, path, line_number, raw_line, entry_date as daily_date, lower(regexp_extract({strip("raw_line")}, '^[-*+]\\s*\\[([ xX])\\]', 1)) = 'x' as completed,
    {strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[➕📅]\\s*\\d{4}-\\d{2}-\\d{2}', '', 'g'), '\\[(?:due|category|priority|platform|status)::\\s*[^\\]]+\\]', '', 'g'), '\\^[a-zA-Z0-9_-]+\\s*$', ''), '\\s+', ' ', 'g')")} as task_text,
    nullif(regexp_extract(b, '➕\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') as created_date,
    coalesce(nullif(regexp_extract(b, '📅\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), nullif(regexp_extract(b, '\\[due::\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})\\]', 1), '')) as due_date,
    nullif(regexp_extract(b, '\\^([a-zA-Z0-9_-]+)\\s*$', 1), '') as block_id
  from bodies),
identified as (select *, substr(md5(path || ':' || line_number || ':' || substr(task_text, 1, 40)), 1, 8) as task_id from tasks),
open_ as (select *, case when due_date < '2026-05-01' then 'overdue' when due_date = '2026-05-01' then 'today' when due_date in ('2026-05-02', '2026-05-03') then 'next2'
  when due_date is null and daily_date = '2026-05-01' then 'today' else 'upcoming' end as bucket from identified where not completed)"""
_SNAPSHOTS = """
now_ as (select file_path as path, md5(coalesce(text, '') || case when doc_id % 7 = 0 then ' edited' else '' end) as hash, 'current' as model from documents where doc_id % 13 <> 0),
old as (select file_path as path, md5(coalesce(text, '')) as hash, case when doc_id % 17 = 0 then 'legacy' else 'current' end as model from documents where doc_id % 11 <> 0),
states as (select coalesce(n.path, o.path) as path, case when n.path is null then 'deleted' when o.path is null then 'new' when n.hash <> o.hash then 'changed'
  when n.model <> o.model then 'outdated' else 'fresh' end as state from now_ n full join old o on n.path = o.path)"""
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_TITLES = f"""
titles as (select distinct vault_id as scope, title from note_nodes where title is not null),
words as (select scope, title, {_WORDS.format("title")} as ws from titles),
flat as (select scope, title, ws, word from (select *, unnest(ws) as word from words) where len(word) > 2)"""
_STEM0 = f"{strip('regexp_replace(' + strip('lower(title)') + ', ' + chr(39) + chr(92) + 'b(notes?|guide|docs?|concepts?)' + chr(92) + 'b' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}"

_PLAIN = r"[^\[\]\x02\x03\x04\n|]"


def _steps(x: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _chars(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {a}, {b})"
    return x


def normalised(x: str) -> str:
    """Loose Markdown in the form that notes use. Runs of two and more brackets are written as chr(2) and chr(3) meanwhile, as there is no look-around here."""
    x = _steps(x, (r"(?m)^>\s*!([A-Z]+)\b(.*)$", r"> [!\1]\2"))
    x = _chars(x, ("'[['", "chr(2) || chr(2)"), ("chr(2) || '['", "chr(2) || chr(2)"), ("']]'", "chr(3) || chr(3)"), ("chr(3) || ']'", "chr(3) || chr(3)"))
    x = f"regexp_replace({x}, '\\[([^\\[\\]\\x02\\x03\\n|]+)\\|([^\\[\\]\\x02\\x03\\n]+)\\]', chr(2) || chr(2) || '\\1|\\2' || chr(3) || chr(3), 'g')"
    field = (r"(^|[^\[(\x02\p{L}\p{N}_])([a-zA-Z0-9_][a-zA-Z0-9_\-]*)::\s*([a-zA-Z0-9_\-/]+)($|[^\])\x03a-zA-Z0-9_\-/])", r"\1[\2:: \3]\4")
    x = _steps(x, field, field)
    for _ in range(2):
        x = rf"regexp_replace({x}, '\](\s*[(\]\x03])', chr(4) || '\1', 'g')"
    for kept in (r"\[(\s*[xX/\-]?\s*[\]\x04])", r"\[([^\S\n]*[!^])", r"\[([^\S\n]*\d+[^\S\n]*\])", r"\[([^\[\]\x02\x03\n|]*::[^\[\]\n]*\])"):
        x = rf"regexp_replace({x}, '{kept}', chr(5) || '\1', 'g')"
    x = rf"regexp_replace({x}, '\[[^\S\n]*({_PLAIN}*[^\[\]\x02\x03\x04\n|\s])[^\S\n]*\]', chr(2) || chr(2) || '\1' || chr(3) || chr(3), 'g')"
    x = _chars(x, ("chr(2)", "'['"), ("chr(3)", "']'"), ("chr(4)", "']'"), ("chr(5)", "'['"))
    return _steps(x, (r"\[{3,}([^\[\]\n]+)\]{3,}", r"[[\1]]"))


_ENDS = r"\r\n|[\n\r\x0b\f\x{85}\x{2028}\x{2029}]"
_HEADER = "case " + " ".join(f"when lower({strip('category')}) in ({quoted(names)}) then '{header}'" for header, names in HEADERS.items()) + f" else '{LOG}' end"
_IS_TASK = f"lower({strip('category')}) in ({quoted(HEADERS[TASKS])})"


def _unboxed(x: str) -> str:
    return strip(_steps(f"regexp_replace({x}, '^[-*+]\\s*(\\[\\s*[xX]?\\s*\\])?\\s*', '')", (r"[➕📅]\s*\d{4}-\d{2}-\d{2}", "")))


_LINES = f"""
with shown as (select *, {normalised(strip("content"))} as body from interstitial_entries),
first_ as (select *, coalesce(starts_with(ltrim(body, {WS}), '> [!'), false) as callout, starts_with(ltrim(body, {WS}), '- [ ]') or starts_with(ltrim(body, {WS}), '- [x]') as written from shown),
lined as (select *, case when callout or written then body
  when {_IS_TASK} then '- [ ] ' || {_unboxed("body")} || ' ➕ ' || entry_date || ' 📅 ' || coalesce(due_date, entry_date)
  else '- ' || coalesce('**[' || (case when contains(timestamp, ' ') then regexp_extract(timestamp, '([^ ]*)$', 1) else timestamp end) || ']** ', '') || body end as l0 from first_),
extra as (select *, array_to_string(list_filter(list_transform(map_entries(coalesce(dataview_fields, map())), lambda e: '[' || e.key || ':: ' || e.value || ']'), lambda f: not contains(l0, f)), ' ') as more from lined),
marked as (select *, case when more <> '' then l0 || ' ' || more else l0 end as l1, '^' || {strip("regexp_replace(block_id, '^\\^+', '')")} as mark from extra),
ended as (select *, case when mark is not null and not contains(l1, mark) then l1 || ' ' || mark else l1 end as l2 from marked),
lines_ as (select entry_no, vault_id, entry_date, {_HEADER} as header, case when nullif(callout_type, '') is not null and not callout then '> [!' || upper({strip("callout_type")}) || ']' || chr(10) || '> ' || l2 else l2 end as line from ended)"""
_DUE = "case when contains(lower(raw), 'tomorrow') then '2026-05-02' when contains(lower(raw), 'today') then '2026-05-01' " + " ".join(rf"when regexp_matches(lower(raw), '\b(?:by|on|this|due)\s+{day}\b') then '{due}'" for day, due in zip(WEEKDAYS, ["2026-05-04", "2026-05-05", "2026-05-06", "2026-05-07", "2026-05-08", "2026-05-02", "2026-05-03"])) + " end"
_FILED = f"""
with e as (select *, {strip("content")} as raw from interstitial_entries),
judged as (select *, coalesce({" or ".join(f"contains(lower(raw), '{p}')" for p in TASK_PHRASES)}, false) as spoken, coalesce({_IS_TASK}, false) as named, coalesce({_DUE}, due_date) as due, coalesce(timestamp, '2026-05-01') as stamp,
  case when regexp_matches(lower(content), '\\b({"|".join(CHATTER)})\\b') or content is null or content = '' then raw else content end as said from e),
texts as (select *, spoken or named as task, case when spoken then raw else said end as c from judged),
items as (select *, list_filter(list_transform(regexp_split_to_array({strip("c")}, '{_ENDS}'), lambda x: {strip("x")}), lambda x: x <> '') as ls, case when contains(stamp, ' ') then split_part(stamp, ' ', 1) else substr(stamp, 1, 10) end as created from texts),
done as (select *, case when task then array_to_string(list_transform(ls, lambda x: '- [ ] ' || {normalised(_unboxed("x"))} || ' ➕ ' || coalesce(nullif(regexp_extract(x, '➕\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), created) || ' 📅 '
  || coalesce(nullif(regexp_extract(x, '📅\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), due, created)), chr(10)) else c end as made from items),
final as (select *, {normalised("made")} as text_ from done),
linked as (select *, list_concat(coalesce(extracted_wikilinks, []), coalesce(list_filter(list_transform(regexp_extract_all({normalised("text_")}, '{_LINK}', 1), lambda x: {strip("x")}), lambda x: x <> ''), [])) as ll from final)
select entry_no, case when task then 'task' else category end as category, text_ as content, case when task then coalesce(nullif(regexp_extract(text_, '📅\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), due) else due_date end as due_date,
  len(list_distinct(list_filter(list_transform(ll, lambda x: {strip("regexp_replace(regexp_replace(x, '[\\[\\]]', '', 'g'), '\\|.*$', '', 's')")}), lambda x: x <> '')))::int as n_links,
  coalesce(block_id, nullif(regexp_extract({strip("text_")}, '\\^([a-zA-Z0-9_-]+)\\s*$', 1), '')) as block_id from linked"""
_MESSAGES = f"""
with recursive cut as (
  select doc_id, 0 as part, case when text is null or length(text) <= 4000 then coalesce(text, '') end as whole, case when length(text) > 4000 then {strip_all("text")} end as rest, null::varchar as piece from documents
  union all
  select doc_id, part + 1, null, {strip_all("substr(rest, upto + 1)")}, {strip_all("substr(rest, 1, upto)")} from (
    select *, case when length(rest) <= 4000 then length(rest)
      when a > 0 then a when b > 0 then b when c > 0 then c when d >= 2000 then d when e >= 2000 then e else 4000 end as upto from (
      select *, length(regexp_extract(left(rest, 4000), '(?s)^(.+)\n\n## ', 1)) as a, length(regexp_extract(left(rest, 4000), '(?s)^(.+)\n\n# ', 1)) as b, length(regexp_extract(left(rest, 4000), '(?s)^(.+)\n\n', 1)) as c,
        length(regexp_extract(left(rest, 4000), '(?s)^(.+)\n', 1)) as d, length(regexp_extract(left(rest, 4000), '(?s)^(.+) ', 1)) as e from cut where rest <> ''))),
pieces as (select doc_id, part, coalesce(whole, piece) as message from cut where whole is not null or piece <> '')
select doc_id, (row_number() over (partition by doc_id order by part) - 1)::int as part, length(message)::int as n_chars from pieces"""


def _noted(key: str, source: str, lines: str) -> str:
    """Lines of texts with what the chunker knows of each: fence, inside a fence, heading, section. ``source`` has the key, title and text."""
    return f"""
split as (select {key}, title, {lines} as l from {source}),
lined as (select {key}, title, unnest(range(0, len(l))) as pos, unnest(l) as line from split),
fenced as (select *, {strip_all("line")} as bare, starts_with({strip_all("line")}, '```') as fence from lined),
inner_ as (select *, (coalesce(sum(fence::int) over (partition by {key} order by pos rows between unbounded preceding and 1 preceding), 0) % 2 = 1) as inside from fenced),
headed as (select *, not fence and not inside and regexp_matches(bare, '^#{{1,6}}\\s+.*$') as head from inner_),
noted as (select *, sum(head::int) over (partition by {key} order by pos) as section from headed)"""


_SECTIONS = f"""
with {_noted("chunk_no", "(select chunk_no, title, content as text from markdown_chunks)", "string_split(text, chr(10))")}
select chunk_no, section::int as section, coalesce(max(case when head then {strip("regexp_extract(bare, '^#{1,6}\\s+(.*)$', 1)")} end), any_value(title)) as heading,
  coalesce(max(case when head then length(regexp_extract(bare, '^(#{{1,6}})\\s', 1)) end), 1)::int as level, count(*)::int as n_lines
from noted group by chunk_no, section having sum((bare <> '')::int) > 0"""
_CHUNKS = f"""
with recursive bodies as (
  select doc_id, file_path, doc_id::varchar as title, created_at, case when text like '---%' and strpos(substr(text, 4), '---') > 0 then substr(text, 3 + strpos(substr(text, 4), '---') + 3) else text end as text,
    case when text like '---%' and strpos(substr(text, 4), '---') > 0 then substr(text, 4, strpos(substr(text, 4), '---') - 1) end as front from documents where text is not null),
{_noted("doc_id", "bodies", f"regexp_split_to_array(text, '{_ENDS}')")},
sized as (select *, sum(length(line) + 1) over (partition by doc_id order by pos) as upto from noted),
spans as (select doc_id, section, min(pos) as begins, max(pos) as ends, min(upto - length(line) - 1) as before from sized group by all),
pieces as (
  select doc_id, section, ends, begins as a, before, coalesce((select min(pos) from sized s where s.doc_id = x.doc_id and s.section = x.section and s.bare = '' and not fence and not inside and not head and s.upto - x.before >= 1500), ends) as b from spans x
  union all
  select doc_id, section, ends, a, before, coalesce((select min(pos) from sized s where s.doc_id = y.doc_id and s.section = y.section and s.pos >= y.a and s.bare = '' and not fence and not inside and not head and s.upto - y.before >= 1500), ends)
  from (select p.doc_id, p.section, p.ends, p.b + 1 as a, (select upto from sized s where s.doc_id = p.doc_id and s.pos = p.b) as before from pieces p where p.b < p.ends) y),
texts as (select p.doc_id, p.section, p.a, {strip_all("string_agg(s.line, chr(10) order by s.pos)")} as content from pieces p join sized s on s.doc_id = p.doc_id and s.pos between p.a and p.b group by all),
heads as (select doc_id, section, {strip("regexp_extract(bare, '^#{1,6}\\s+(.*)$', 1)")} as heading from noted where head),
kept as (select t.*, (row_number() over (partition by t.doc_id order by a) - 1)::int as chunk_index from texts t where content <> ''),
named as (select k.*, b.file_path, b.title, coalesce(h.heading, b.title) as heading, nullif(lower(regexp_extract(front, '(?m)^memory_type:[ \\t]*(\\S+)', 1)), '') as memory, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(b.file_path || '#' || chunk_index)) as h
  from kept k join bodies b using (doc_id) left join heads h on h.doc_id = k.doc_id and h.section = k.section)
select concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3), substr(h, 21, 12)) as id,
  file_path as path, chunk_index, heading, length(content)::int as n_chars,
  len(list_filter(list_transform(regexp_extract_all(content, '{_LINK}', 1), lambda x: {strip("x")}), lambda x: x <> ''))::int as n_links,
  coalesce(memory, case when contains(content, '- [ ]') or contains(content, '- [x]') then 'task' else 'user_authored' end) as memory_type
from named"""
_LOOKUP = f"""
with n as (select *, case when starts_with(rel_path, 'Notes/') then 0 when starts_with(rel_path, 'Daily Notes/') then 1 else 2 end as dir_rank from note_nodes where title is not null),
names as (select node_no, vault_id, list_concat([lower(title), substr(title, 3, 7), title || ' v2'], coalesce(aliases, [])) as l from n where node_no % 20 = 0),
asked as (select node_no * 100 + unnest(range(0, len(l))) as qid, vault_id, unnest(l) as raw from names),
tried as (select distinct qid, vault_id, unnest([{strip("raw")}, {strip("regexp_replace(raw, '[" + chr(92) * 2 + "/:*?" + chr(34) + "<>|]', '_', 'g')")}]) as name from asked),
hits as (select qid, rel_path as path, title, dir_rank, case when title = name then 1 when lower(title) = lower(name) then 2 when starts_with(lower(title), lower(name)) or starts_with(lower(name), lower(title)) then 3 when contains(lower(title), lower(name)) then 4 end as match
  from tried join n using (vault_id) where name <> '')
select qid, path, match from (select *, row_number() over (partition by qid order by match, dir_rank, title, path) as r from hits where match is not null) where r = 1"""
_HYBRID = (
    _BOOSTED
    + f""",
{_EDGES.strip()},
docs_ as (select doc_id as id, vault_id, coalesce((list_filter(list_transform(regexp_extract_all(text, '{_LINK}', 1), lambda x: {strip("x")}), lambda x: x <> ''))[1], regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.md$', '')) as title from documents),
titles_ as (select id, concat_ws('/', vault_id::varchar, title) as title from docs_),
five as (select concat_ws('/', scope::varchar, src) as title, concat_ws('/', scope::varchar, dst) as neighbour from (select *, row_number() over (partition by scope, src order by dst) as n from near) where n <= 5),
tops as (select distinct qid, title from final join titles_ using (id) where rank <= 5),
around as (select distinct qid, neighbour as title from tops join five using (title)),
added as (select distinct qid, id from around join titles_ using (title) anti join final using (qid, id)),
every_ as (select qid, id, false as added, rank as r from final union all select qid, id, true, null from added),
placed as (select *, row_number() over (partition by qid order by added, r nulls last, id) as place from every_),
pool as (select * from placed where place <= 10),
words_ as (select doc_id as id, coalesce({_TOKENS}, []) as t from documents where doc_id in (select id from pool)),
asks as (select term_id as qid, list_distinct(t) as q from (select term_id, {_TOKENS} as t from (select term_id, term as text from topic_terms where term_id % 20 = 0))),
scored_ as (select qid, id, place, round(case when len(q) > 0 then len(list_intersect(q, t)) / len(q)::double else 0 end, 9) as rerank_score from pool join words_ using (id) join asks using (qid))
select qid, id, rerank_score, rank from (select *, row_number() over (partition by qid order by rerank_score desc, place) as rank from scored_) where rank <= 5"""
)
_MATCHED = f"""
with {_VECTORS},
dense10 as (select * from dense where rank <= 10),
asks as (select term_id as qid, list_distinct(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}_]+')) as w from topic_terms where term_id % 20 = 0),
has as (select qid, doc_id as id from documents, asks where list_has_all(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), w)),
second as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from cosines join has using (qid, id)) where rank <= 10),
both_ as (select qid, id, d.rank as dr, s.rank as sr, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.5 / (60 + s.rank), 0), 12) as rrf_score from dense10 d full join second s using (qid, id))
select * from (select qid, id, rrf_score, row_number() over (partition by qid order by rrf_score desc, dr nulls last, sr nulls last, id) as rank from both_) where rank <= 5"""
_SOURCES = f"""
with {bm25(10)},
asks as (select term_id as qid, lower(term) as t from topic_terms where term_id % 20 = 0),
expected as (select qid, file_path as source from documents, asks where contains(lower(text), t)),
results as (select qid, rank, file_path as path, '[[' || regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.md$', '') || ']]' as title from sparse join documents on doc_id = id),
paired as (select r.qid, rank, trim(lower(replace(replace(replace(path, '[[', ''), ']]', ''), '.md', ''))) as p, trim(lower(replace(replace(replace(title, '[[', ''), ']]', ''), '.md', ''))) as t, trim(lower(replace(regexp_extract(source, '([^/]*)$', 1), '.md', ''))) as s from results r join expected e on e.qid = r.qid),
firsts as (select qid, min(case when contains(p, s) or contains(s, p) then rank end) as f, bool_or(rank <= 5 and (contains(t, s) or contains(s, t))) as cited from paired group by qid),
per as (select qid, f, cited from (select distinct qid from expected) left join firsts using (qid))
select count(*) as n_queries, round(avg(case when f <= 5 then 1.0 else 0 end), 6) as recall_5, round(avg(case when f <= 10 then 1.0 else 0 end), 6) as recall_10, round(avg(coalesce(1.0 / f, 0)), 6) as mrr, round(avg(case when cited then 1.0 else 0 end), 6) as citation_accuracy from per"""
_TAGGED = "(select * from interstitial_entries where list_contains(extracted_tags, '#log') or list_contains(extracted_tags, '#field-notes'))"

def _chat(x: str) -> str:
    """Chat Markdown of a text."""
    x = _steps(normalised(x), (r"(?m)^(?:---|\*\*\*|___)\s*$", "─" * 23))
    x = _steps(x, *((rf"(?m)^#{{{n}}}\s+(.+)$", rf"{icon} *\1*") for n, icon in CHAT_HEADINGS.items()))
    x = _steps(x, *((rf"(?m)^>\s*\[!{name}\]\s*(.*)$", rf"{icon} *{name.title()}: \1*") for name, icon in CHAT_CALLOUTS.items()))
    return _steps(x, (r"(?m)^\s+([A-Za-z0-9_\-\s]+:)\s*$", r"• *\1*"), (r"(?m)^\s{1,2}([A-Za-z0-9_\[])", r"• \1"))


def _escaped(x: str) -> str:
    return _chars(x, ("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"))


def _restored(x: str, mark: int, kept: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr({mark})), lambda p, i: p || coalesce({kept}[i], '')), '')"


_STAR, _LINE_ = (r"(^|[^\p{L}\p{N}_*])\*([^*\n]+)\*($|[^\p{L}\p{N}_*])", r"\1<b>\2</b>\3"), (r"(^|[^\p{L}\p{N}_])_([^_\n\x{E000}\x{E001}]+)_($|[^\p{L}\p{N}_])", r"\1<i>\2</i>\3")
_RENDERED = f"""
with chat as (select chunk_no, {_chat("content")} as c from markdown_chunks),
blocks as (select *, regexp_extract_all(c, '(?s)```([a-zA-Z0-9_\\-+]*)\\n(.*?)```', 2) as b, regexp_replace(c, '(?s)```([a-zA-Z0-9_\\-+]*)\\n(.*?)```', chr(57344), 'g') as d from chat),
spans as (select *, regexp_extract_all(d, '`([^`\\n]+)`', 1) as s, {_escaped("regexp_replace(d, '`([^`" + chr(92) + "n]+)`', chr(57345), 'g')")} as e from blocks),
tagged as (select *, {_steps("e", (r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)", r'<a href="\2">\1</a>'), (r"\*\*([^*\n]+)\*\*", r"<b>\1</b>"), _STAR, _STAR, _LINE_, _LINE_, (r"~~([^~\n]+)~~", r"<s>\1</s>"))} as t,
  list_transform(b, lambda x: '<pre><code>' || {_escaped("x")} || '</code></pre>') as bb, list_transform(s, lambda x: '<code>' || {_escaped("x")} || '</code>') as ss from spans)
select chunk_no, md5({_restored(_restored("t", 57345, "ss"), 57344, "bb")}) as digest from tagged"""
_RSTRIP = "regexp_replace({0}, '[ \\t\\n\\x0b\\f\\r]+$', '')"
_INSERTED = f"""
with d as (select doc_id, text, '- filed ' || doc_id as line, {_RSTRIP.format("text")} as bare, case when doc_id % 2 = 0 then '{LOG}' else coalesce(nullif(regexp_extract(text, '(?m)^(## .*\\S)$', 1), ''), '{TASKS}') end as header from documents where text is not null),
f as (select *, chr(10) || bare || chr(10) as whole, strpos(chr(10) || bare || chr(10), chr(10) || header || chr(10)) as start from d),
g as (select *, substr(whole, start + length(header) + 1) as tail from f),
h as (select *, least(case when strpos(substr(tail, 1), chr(10) || '# ') > 0 then strpos(tail, chr(10) || '# ') else length(tail) + 1 end, case when strpos(tail, chr(10) || '## ') > 0 then strpos(tail, chr(10) || '## ') else length(tail) + 1 end) as at_ from g),
i as (select *, left(tail, at_ - 1) as section, substr(tail, at_) as rest from h)
select doc_id, md5(case when start > 0 then substr(whole, 2, start + length(header) - 1) || {_RSTRIP.format("section")} || chr(10) || line || case when trim(rest, {WS}) = '' then chr(10) else chr(10) || rest end
  else bare || chr(10) || chr(10) || header || chr(10) || line || chr(10) end) as digest from i"""
_NODES = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as (select *, case when text like '---%' and strpos(substr(text, 4), '---') > 0 then substr(text, 4, strpos(substr(text, 4), '---') - 1) end as front, case when text like '---%' and strpos(substr(text, 4), '---') > 0 then substr(text, strpos(substr(text, 4), '---') + 6) else text end as body from d),
g as (select *, coalesce(list_transform(regexp_extract_all(regexp_extract(replace(front, chr(13), ''), '(?m)^tags:[ ]*\\n((?:[ ]*- .*\\n?)+)', 1), '- *(\\S.*)', 1), lambda t: '#' || lower(regexp_replace(t, '^#+', ''))), []) as ft,
  list_transform(list_filter(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])#([a-zA-Z0-9_\\-/]*[a-zA-Z0-9_])', 1), lambda x: not regexp_matches(x, '^\\d+$')), lambda x: '#' || lower(x)) as bt from f)
select doc_id, array_to_string(list_sort(list_distinct(list_concat(ft, bt))), ',') as tags, len(regexp_extract_all(body, '(?m)^#{{1,6}}[ \\t]+(.+)$', 1))::int as n_headings,
  len(regexp_extract_all(body, '(?m)\\^([a-zA-Z0-9_-]+)\\s*$', 1))::int as n_blocks, len(list_filter(list_transform(regexp_extract_all(body, '{_LINK}', 1), lambda x: {strip("x")}), lambda x: x <> ''))::int as n_links, 0 as n_aliases from g"""
SQL = {
    "wikilinks": f"select chunk_no, unnest(range(0, len(l)))::int as pos, unnest(l) as link from (select chunk_no, list_filter(list_transform(regexp_extract_all(content, '{_LINK}', 1), lambda x: {strip('x')}), lambda x: x <> '') as l from markdown_chunks)",
    "tags": r"select chunk_no, unnest(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])#([a-zA-Z0-9_\-/]*[a-zA-Z0-9_])', 1), lambda x: not regexp_matches(x, '^\d+$')), lambda x: '#' || lower(x))))) as tag from markdown_chunks",
    "entry_fields": "select entry_no, unnest(map_keys(dataview_fields)) as field, unnest(map_values(dataview_fields)) as value from interstitial_entries",
    "block_ids": r"select chunk_no, '^' || unnest(regexp_extract_all(content, '(?m)\^([a-zA-Z0-9_-]+)\s*$', 1)) as block from markdown_chunks",
    "headings": f"select chunk_no, unnest(range(0, len(l)))::int as pos, unnest(l) as heading from (select chunk_no, list_transform(regexp_extract_all(content, '(?m)^#{{1,6}}[ \\t]+(.+)$', 1), lambda x: {strip('x')}) as l from markdown_chunks)",
    "frontmatter": "select doc_id, (strpos(substr(text, 4), '---') - 1) as block_chars, (length(text) - 3 - strpos(substr(text, 4), '---') - 2) as body_chars from documents where text like '---%' and strpos(substr(text, 4), '---') > 0",
    "term_stems": f"with s as (select title, {_STEM0} as t from note_nodes where title is not null) select case when t like '%ies' and len(t) > 4 then substr(t, 1, len(t) - 3) || 'y' when t like '%es' and len(t) > 3 then substr(t, 1, len(t) - 2) when t like '%s' and t not like '%ss' and len(t) > 3 then substr(t, 1, len(t) - 1) else t end as stem, count(distinct title) as n_titles from s group by 1",
    "uuid5_ids": "with h as (select chunk_no, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('#', file_path, chunk_index))) as h from markdown_chunks) select chunk_no, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3), substr(h, 21, 12)) as uuid from h",
    "temporal_intent": r"""
with q as (select delivery_id, lower(text) as t, nullif(regexp_extract(text, '\b(\d{4}-\d{2}-\d{2})\b', 1), '') as d, nullif(regexp_extract(text, '\b(\d{4}-\d{2})\b', 1), '') as m from telegram_updates),
x as (select delivery_id, case when d is not null then d when m is not null then null when contains(t, 'today') then '2026-05-01' when contains(t, 'yesterday') then '2026-04-30' end as date,
  case when d is not null then null when m is not null then m when contains(t, 'today') or contains(t, 'yesterday') then null when contains(t, 'last month') then '2026-04' when contains(t, 'this month') then '2026-05' end as month from q)
select * from x where date is not null or month is not null""",
    "task_sentences": "with q as (select delivery_id, lower(text) as t from telegram_updates where text is not null) select delivery_id, case when contains(t, 'tomorrow') then '2026-05-02' when contains(t, 'today') then '2026-05-01' "
    + " ".join(rf"when regexp_matches(t, '\b(?:by|on|this|due)\s+{day}\b') then '{due}'" for day, due in zip(WEEKDAYS, ["2026-05-04", "2026-05-05", "2026-05-06", "2026-05-07", "2026-05-08", "2026-05-02", "2026-05-03"]))
    + " end as due_date from q where "
    + " or ".join(f"contains(t, '{p}')" for p in TASK_PHRASES),
    "section_headers": "select case "
    + " ".join(f"when lower({strip('category')}) in ({quoted(names)}) then '{header}'" for header, names in HEADERS.items())
    + f" else '{LOG}' end as header, count(*) as n_entries from interstitial_entries group by 1",
    "citations": "select chunk_no, concat_ws(chr(10), '• [[' || title || ']]', case when heading is distinct from title then '  → ## ' || heading end, '  → ^' || block_ids[1]) as citation from markdown_chunks",
    "bm25_topk": f"with {bm25(30)} select qid, id, score, rank from sparse",
    "bm25_filtered": f"with {bm25(10, '(select * from documents where source is distinct from ' + chr(39) + 'web_clip' + chr(39) + ')')} select qid, id, score, rank from sparse",
    "bm25_kept": f"with {bm25(10, '(select * from documents where source is distinct from ' + chr(39) + 'web_clip' + chr(39) + ')')} select qid, id, score, rank from sparse",
    "bm25_term_stats": f"with {_INDEX.replace("{docs}", "documents")} words as (select id, unnest(list_distinct(tokens)) as term from index_) select term, count(*) as df from words group by term",
    "dense_topk": f"with {dense(30)} select qid, id, score, rank from dense",
    "dense_filtered": f"with {dense(10, same='and q.label = d.label')} select qid, id, score, rank from dense",
    "dense_threshold": f"with {dense(1000, where='where score >= 0.3')} select qid, id, score, rank from dense",
    "rrf_fuse": fused() + " select qid, id, rrf_score, dense_score, sparse_score, rank from fused",
    "rrf_weighted": fused(1.5) + " select qid, id, rrf_score, dense_score, sparse_score, rank from fused where rank <= 10",
    "temporal_boost": _BOOSTED + " select * from final",
    "eval_recall_mrr": f"with {dense(30)}, first_ as (select q.vec_id as qid, (select min(d.rank) from dense d join embeddings e on e.vec_id = d.id where d.qid = q.vec_id and e.label = q.label) as f from embeddings q where q.vec_id % 20 = 0 and exists (select 1 from embeddings o where o.label = q.label and o.vec_id <> q.vec_id)) select count(*) as n_queries, round(avg(case when f <= 5 then 1.0 else 0 end), 6) as recall_5, round(avg(case when f <= 10 then 1.0 else 0 end), 6) as recall_10, round(avg(coalesce(1.0 / f, 0)), 6) as mrr from first_",
    "qa_sources": f"with {bm25(5)} select qid, string_agg(file_path, chr(10) order by rank) as sources from (select qid, file_path, min(rank) as rank from sparse join documents on doc_id = id group by all) group by qid",
    "graph_edges": f"with {_EDGES} select scope, src, dst from edges",
    "graph_backlinks": f"with {_EDGES}, i as (select scope, dst as title, count(*) as n from edges group by all), o as (select scope, src as title, count(*) as n from edges group by all) select scope, title, coalesce(i.n, 0) as n_backlinks, coalesce(o.n, 0) as n_links from i full join o using (scope, title)",
    "graph_neighbors_1hop": f"with {_EDGES} select scope, src as title, dst as neighbour, n from (select *, row_number() over (partition by scope, src order by dst) as n from near) where n <= 5",
    "graph_neighbors_2hop": f"with {_EDGES}, seeds as (select distinct vault_id as scope, title from note_nodes where node_no % 20 = 0), one as (select scope, src, dst from near semi join seeds on seeds.scope = near.scope and seeds.title = near.src), two as (select * from one union select o.scope, o.src, n.dst from one o join near n on n.scope = o.scope and n.src = o.dst where n.dst <> o.src) select scope, src as title, dst as neighbour, n from (select *, row_number() over (partition by scope, src order by dst) as n from two) where n <= 5",
    "graph_expand": f"with {_EDGES}, seeds as (select distinct vault_id as scope, title from note_nodes where node_no % 20 = 0 and title is not null), first_ as (select *, row_number() over (partition by scope, src order by dst) as n from near) select scope, title from seeds union select f.scope, f.dst from first_ f semi join seeds on seeds.scope = f.scope and seeds.title = f.src where n <= 5",
    "tasks_parse": f"with {_TASKS} select entry_no, line_number, completed, task_text, created_date, due_date, task_id, daily_date from identified",
    "tasks_buckets": f"with {_TASKS} select bucket, count(*) as n_tasks from open_ group by bucket",
    "tasks_report": f"with {_TASKS} select vault_id, bucket, count(*) as n_tasks, sum((n <= 15)::int)::bigint as n_buttons from (select *, row_number() over (partition by vault_id order by list_position(['overdue', 'today', 'next2', 'upcoming'], bucket), due_date nulls last, path, line_number) as n from open_) group by all",
    "tasks_briefing": f"with {_TASKS} select entry_no, line_number, case when bucket <> 'next2' then bucket when due_date = '2026-05-02' then 'tomorrow' else 'day_after' end as section from open_ where bucket <> 'upcoming'",
    "registry_diff": f"with {_SNAPSHOTS} select * from states",
    "registry_stats": f"with {_SNAPSHOTS} select sum((state <> 'deleted')::int)::bigint as scanned, sum((state in ('new', 'changed', 'outdated'))::int)::bigint as indexed, sum((state = 'fresh')::int)::bigint as skipped, sum((state = 'deleted')::int)::bigint as deleted from states",
    "registry_after": "select file_path as path, md5(coalesce(text, '') || case when doc_id % 7 = 0 then ' edited' else '' end) as hash, 'current' as model from documents where doc_id % 13 <> 0",
    "upsert_chunks": "select id, chunk_no from (select id, chunk_no, row_number() over (partition by id order by indexed_at desc, chunk_no desc) as n from markdown_chunks) where n = 1",
    "resolve_exact": f"""
with {_EDGES}, asked as (select distinct vault_id as scope, regexp_replace({strip("l")}, '\\[\\[|\\]\\]', '', 'g') as term from (select vault_id, unnest(extracted_wikilinks) as l from interstitial_entries) where l is not null),
titles as (select distinct vault_id as scope, title from note_nodes where title is not null),
hits as (select a.scope, a.term, t.title, case when a.term = t.title then 2.0 else 1.0 end as s from asked a join titles t on t.scope = a.scope and lower(t.title) = lower(a.term)
  union all select a.scope, a.term, n.title, 0.95 from asked a join aliases n on n.vault_id = a.scope and n.alias = lower(a.term))
select scope, term, title, least(1.0, s)::double as score from (select *, row_number() over (partition by scope, term order by s desc, title) as n from hits where term <> '') where n = 1""",
    "dup_blocks": f"with {_TITLES} select scope, word, count(*) as n from flat group by all",
    "dup_subset_pairs": f"with {_TITLES}, useful as (select scope, word from flat group by all having count(*) between 2 and 50) select distinct a.scope, a.title as note_a, b.title as note_b from flat a join useful u on u.scope = a.scope and u.word = a.word join flat b on b.scope = a.scope and b.word = a.word and a.title < b.title where lower(a.title) <> lower(b.title) and len(a.ws) >= 2 and (list_has_all(b.ws, a.ws) or list_has_all(a.ws, b.ws))",
    "recent_notes": "select node_no, title from note_nodes order by indexed_at desc, node_no limit 30",
    "dql_open_tasks": f"with {_TASKS} select entry_no, line_number, path from identified where not completed",
    "dql_recent_daily": "select vault_id, file_name, n from (select *, row_number() over (partition by vault_id order by file_name desc) as n from (select distinct vault_id, file_name from note_nodes where rel_path like 'Daily Notes/%')) where n <= 7",
    "dql_tagged": "select vault_id, tag, count(*) as n_notes from (select vault_id, node_no, unnest(list_distinct(tags)) as tag from note_nodes) group by all",
    "dataview_fields": f"""
with f as (select doc_id, unnest(range(0, len(k))) as i, unnest(k) as k, unnest(v) as v from (
  select doc_id, regexp_extract_all(text, '\\[([a-zA-Z0-9_\\-\\s]+)::\\s*([^\\]]+)\\]', 1) as k, regexp_extract_all(text, '\\[([a-zA-Z0-9_\\-\\s]+)::\\s*([^\\]]+)\\]', 2) as v from documents))
select doc_id, {strip("k")} as field, arg_max({strip("v")}, i) as value from f group by 1, 2""",
    "tasks_all": f"""
with lines as (select doc_id, unnest(range(0, len(l)))::int as line_number, {strip("unnest(l)")} as line from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n') as l from documents where text is not null)),
t as (select doc_id, line_number, lower(regexp_extract(line, '^[-*+]\\s*\\[([ xX])\\]', 1)) = 'x' as completed, {strip("regexp_extract(line, '(?s)^[-*+]" + chr(92) + "s*" + chr(92) + "[[ xX]" + chr(92) + "]" + chr(92) + "s*(.*)$', 1)")} as b
  from lines where regexp_matches(line, '^[-*+]\\s*\\[([ xX])\\]\\s*(.*)$'))
select doc_id, line_number, completed, coalesce(nullif(regexp_extract(b, '📅\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), nullif(regexp_extract(b, '\\[due::\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})\\]', 1), '')) as due_date,
  coalesce(nullif({strip("regexp_extract(b, '(?i)" + chr(92) + "[priority::" + chr(92) + "s*([^" + chr(92) + "]]+)" + chr(92) + "]', 1)")}, ''), case when regexp_matches(b, '(?i)#high\\b') or contains(b, '[#A]') then 'high'
    when regexp_matches(b, '(?i)#medium\\b') or contains(b, '[#B]') then 'medium' when regexp_matches(b, '(?i)#low\\b') or contains(b, '[#C]') then 'low' end) as priority,
  nullif(regexp_extract(b, '\\^([a-zA-Z0-9_-]+)\\s*$', 1), '') as block_id from t""",
    "routes": f"""
with q as (select callback_data as c, lower({strip("coalesce(text, caption)")}) as t from telegram_updates)
select case when c is not null then case when c like 'done:%' then 'done' when c like 'view:%' then 'view' when c like 'create_atomic:%' then 'create_atomic' when c like 'ignore_atomic:%' then 'ignore_atomic' else 'unknown' end
  when t is null or t = '' then 'none'
  when t in ({quoted(TASK_COMMANDS)}) or {" or ".join(f"starts_with(t, '{x}')" for x in TASK_PREFIXES)} or regexp_matches(t, '{TASK_QUESTIONS.replace("'", "''")}') then 'tasks'
  when regexp_matches(t, '^/(ask|query)\\b') then 'query' when regexp_matches(t, '^/consolidate\\b') then 'consolidate' when regexp_matches(t, '^/reindex\\b') then 'reindex' else 'capture' end as route, count(*) as n_updates
from q group by 1""",
    "mark_task_pick": f"""
with {_TASKS}, asked as (select delivery_id as rid, vault_id, substr(callback_data, 6, 40) as id from telegram_updates where callback_data like 'done:%' union all select entry_no, vault_id, task_id from identified where not completed),
hits as (select rid, path, line_number from asked a join identified t on t.vault_id = a.vault_id and not t.completed and (t.task_id = a.id or t.block_id = a.id))
select rid, path, line_number from (select *, row_number() over (partition by rid order by path desc, line_number) as n from hits) where n = 1""",
    "loose_links": f"with l as (select doc_id, unnest(list_filter(list_transform(regexp_extract_all({normalised('text')}, '{_LINK}', 1), lambda x: {strip('x')}), lambda x: x <> '')) as link from documents) select doc_id, count(*) as n_links, count(distinct link) as n_targets from l group by doc_id",
    "entry_lines": _LINES + " select entry_no, header, line from lines_",
    "daily_notes": _LINES + ", parts as (select vault_id, entry_date, header || chr(10) || string_agg(line, chr(10) order by entry_no) as section, count(*) as n from lines_ where line is not null group by vault_id, entry_date, header) select vault_id, entry_date, string_agg(section, chr(10) || chr(10) order by section) as body, sum(n)::bigint as n_entries from parts group by vault_id, entry_date",
    "filed_entries": _FILED,
    "message_split": _MESSAGES,
    "chat_rendering": _RENDERED,
    "sections_native": _SECTIONS,
    "chunk_exact": _CHUNKS,
    "note_lookup": _LOOKUP,
    "hybrid_topk": _HYBRID,
    "matched_hybrid": _MATCHED,
    "eval_sources": _SOURCES,
    "captured_items": f"""
with u as (select delivery_id, text, caption, audio_file_name as f, case when voice_file_id is not null then 'voice' when audio_file_name is not null then 'document' when regexp_matches(text, '^https?://\\S+$') then 'url' else 'text' end as modality from telegram_updates where update_kind = 'message')
select delivery_id, modality, case modality when 'voice' then concat_ws(' - ', nullif({strip("caption")}, ''), {strip("text")}) when 'document' then coalesce(nullif(text, ''), nullif(caption, ''), 'Document capture')
  when 'url' then '🔗 [' || coalesce(nullif(caption, ''), 'Web resource') || '](' || {strip("text")} || ')' else {strip("text")} end as item from u""",
    "frontmatter_tags": """
with f as (select doc_id, substr(text, 4, strpos(substr(text, 4), '---') - 1) as b from documents where text like '---%' and strpos(substr(text, 4), '---') > 0)
select doc_id, '#' || lower(regexp_replace(unnest(regexp_extract_all(regexp_extract(replace(b, chr(13), ''), '(?m)^tags:[ ]*\\n((?:[ ]*- .*\\n?)+)', 1), '- *(\\S.*)', 1)), '^#+', '')) as tag from f""",
    "frontmatter_yaml": """
with f as (select doc_id, replace(substr(text, 4, strpos(substr(text, 4), '---') - 1), chr(13), '') as b from documents where text like '---%' and strpos(substr(text, 4), '---') > 0)
select doc_id, 'created' as field, regexp_extract(b, '(?m)^created: *(\\S.*)$', 1) as value from f where regexp_matches(b, '(?m)^created: *\\S')
union all select doc_id, 'tags', array_to_string(regexp_extract_all(regexp_extract(b, '(?m)^tags:[ ]*\\n((?:[ ]*- .*\\n?)+)', 1), '- *(\\S.*)', 1), ', ') from f where regexp_matches(b, '(?m)^tags:[ ]*\\n[ ]*- ')""",
    "tag_names": f"""
select node_no, {strip("regexp_replace(title, '[" + chr(92) * 2 + "/:*?" + chr(34) + "<>|]', '_', 'g')")} as file,
  case when length(b) > 36 then substr(b, 1, 33) || '...' else b end as button from (select *, {strip("regexp_replace(regexp_replace(regexp_replace('[[' || rel_path || '|' || title || ']] note', '" + r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]" + "', '" + chr(92) + "1', 'g'), '[#*`_~]', '', 'g'), '[" + chr(92) + "s" + chr(92) + "p{Z}]+', ' ', 'g')")} as b from note_nodes)""",
    "note_bodies": rf"select doc_id, md5({strip_all('regexp_replace(regexp_replace(text, ' + chr(39) + r'^---\n(?:.|\n)*?\n---\n*' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + r'^# [^\n]*\n*' + chr(39) + ', ' + chr(39) * 2 + ')')}) as digest from documents",
    "atomic_notes": f"""
select entry_no, {strip("regexp_replace(atomic_note_title, '[" + chr(92) * 2 + "/:*?" + chr(34) + "<>|]', '_', 'g')")} as file,
  md5('---' || chr(10) || 'created: ' || entry_date || chr(10) || 'type: atomic-note' || chr(10) || 'tags:' || chr(10) || array_to_string(list_transform(case when len(extracted_tags) > 0 then extracted_tags else ['atomic-note'] end, lambda t: '  - ' || regexp_replace(t, '^#', '')), chr(10)) || chr(10)
    || 'source_daily_note: "[[' || entry_date || ']]"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || atomic_note_title || chr(10) || chr(10) || coalesce(atomic_note_content, '') || chr(10)) as digest
from interstitial_entries where atomic_note_title is not null""",
    "model_answers": f"select doc_id, md5({strip_all('coalesce(text, ' + chr(39) * 2 + ')')}) as digest, coalesce(regexp_matches(lower(coalesce(text, '')), '\\b({'|'.join(CHATTER)})\\b'), false) as chatter from documents where text is null or text not like '%`%'",
    "dql_recent_notes": "select vault_id, n, node_no, created, array_to_string(tags, ',') as tags from (select *, row_number() over (partition by vault_id order by indexed_at desc, node_no) as n from note_nodes where rel_path like 'Notes/%') where n <= 12",
    "dql_tagged_tasks": f"with {_TASKS} select entry_no, daily_date, line_number, task_text from identified semi join {_TAGGED} g using (entry_no) where not completed",
    "dql_backlinks": f"with {_EDGES} select scope, dst as title, src as linked_from from edges",
    "dql_entries_by_time": f"select vault_id, entry_date, entry_no, timestamp, category, content, row_number() over (partition by vault_id, entry_date order by timestamp nulls last, entry_no) as place from {_TAGGED}",
    "dql_backlog": f"with {_TASKS} select o.entry_no, o.vault_id, line_number, o.due_date, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') as changed from open_ o join interstitial_entries e using (entry_no) where bucket = 'upcoming'",
    "recent_excerpts": "select file_path as path, doc_id::varchar as title, substr(text, 1, 600) as excerpt from documents order by created_at desc, file_path limit 30",
    "graph_update": f"with {_EDGES} select scope, src, dst from edges",
    "mark_task_by_text": f"""
with {_TASKS}, asked as (select entry_no as rid, vault_id, case when entry_no % 5 <> 0 then upper(regexp_extract(task_text, '(\\S+ \\S+)$', 1)) end as p from identified where not completed),
hits as (select rid, t.path, t.line_number from asked a join identified t on t.vault_id = a.vault_id and not t.completed and (coalesce(a.p, '') = '' or contains(lower(t.raw_line), lower(a.p))))
select rid, path, line_number from (select *, row_number() over (partition by rid order by path desc, line_number) as n from hits) where n = 1""",
    "notes_with_entry": _INSERTED,
    "node_fields": _NODES,
}

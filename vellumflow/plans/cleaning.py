"""Queries of the general data-cleaning problems (p1, p3, p5) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import surplus_deliveries
from ..operators.orphans import link_name, orphan_references
from ..operators.timestamps import ABBREVIATIONS, MONTHS, normalise_timestamps
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_deliveries(table(spark, sf, "telegram_updates"))


def p1_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One delivery of each message."""
    updates = table(spark, sf, "telegram_updates")
    return updates.join(surplus_deliveries(updates), "delivery_id", "left_anti").select("delivery_id", "vault_id", "update_id", "chat_id", "message_id", "update_kind")


def time_values(spark: SparkSession, sf: str) -> DataFrame:
    """All values of the four string columns as ``(source_table, record_key, field, value, vault_id, entry_date)``."""
    none = F.lit(None).cast("string")
    entries = table(spark, sf, "interstitial_entries").select(
        F.lit("interstitial_entries").alias("source_table"), F.col("entry_no").alias("record_key"), F.lit("timestamp").alias("field"), F.col("timestamp").alias("value"), "vault_id", "entry_date"
    )
    chunks = table(spark, sf, "markdown_chunks").select(
        F.lit("markdown_chunks").alias("source_table"), F.col("chunk_no").alias("record_key"), "vault_id",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("created", "modified")])).alias("e"),
    ).select("source_table", "record_key", "e.field", "e.value", "vault_id", none.alias("entry_date"))
    updates = table(spark, sf, "telegram_updates").select(
        F.lit("telegram_updates").alias("source_table"), F.col("delivery_id").alias("record_key"), F.lit("date").alias("field"), F.col("date").alias("value"), "vault_id", none.alias("entry_date")
    )
    return entries.unionByName(chunks).unionByName(updates)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    zones = table(spark, sf, "vaults").select("vault_id", "tz")
    values = time_values(spark, sf).where(r"value is not null and not rlike(value, '(?U)^\\s*$')").join(zones, "vault_id", "left")
    return normalise_timestamps(values, "value", "tz", "entry_date").select("source_table", "record_key", "field", "utc_text")


def p3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each column came out as an instant or as which refusal."""
    kind = F.when(F.col("utc_text").rlike("^[0-9]"), F.lit("instant")).otherwise(F.col("utc_text"))
    return p3_found(spark, sf).groupBy("source_table", "field", kind.alias("result")).agg(F.count("*").alias("n_values"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct references per row as ``(ref_table, ref_key, link_value, scope, name, at)``, without links to topics or to nothing."""

    def side(name: str, key: str, links: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.lit(name).alias("ref_table"), F.col(key).alias("ref_key"), F.explode(F.array_distinct(links)).alias("link_value"),
            F.col("vault_id").alias("scope"), F.col("indexed_at").alias("at"),
        )

    refs = side("markdown_chunks", "chunk_no", "wikilinks").unionByName(side("note_nodes", "node_no", "outgoing_links"))
    refs = refs.withColumn("name", link_name(F.col("link_value"))).where("name <> ''")
    topics = table(spark, sf, "topic_terms")
    names = topics.select(F.explode(F.concat(F.array("term"), F.coalesce("short_forms", F.array().cast("array<string>")))).alias("t")).select(F.lower("t").alias("name")).where("name is not null").distinct()
    return refs.join(names, "name", "left_anti")


def note_names(spark: SparkSession, sf: str) -> DataFrame:
    """Validity intervals of every title and alias as ``(scope, name, since, until)``."""
    notes = table(spark, sf, "note_nodes")
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return notes.select(F.col("vault_id").alias("scope"), F.explode(names).alias("n"), F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")).select("scope", F.lower("n").alias("name"), "since", "until").where("name is not null")


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    found = orphan_references(references(spark, sf), note_names(spark, sf))
    return found.select("ref_table", "ref_key", "link_value", F.date_format("at", "yyyy-MM").alias("period"), "why")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf).drop("why")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return orphans(spark, sf).groupBy("ref_table", "period", "why").agg(F.count("*").alias("n_orphans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p3_found, p3_quality, p5_found, p5_report)}

_SAME = """
with recursive ids as (
  select delivery_id, 'u' || vault_id || ':' || update_id as k from telegram_updates where update_id is not null and vault_id is not null
  union all
  select delivery_id, 'm' || chat_id || ':' || message_id from telegram_updates where update_kind = 'message' and message_id is not null and chat_id is not null
), first as (select k, min(delivery_id) as f from ids group by k),
links as (select distinct i.delivery_id as a, f.f as b from ids i join first f using (k) where i.delivery_id <> f.f),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
surplus as (select a as delivery_id from reach group by a having min(b) < a)
"""
_NAME = """lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^\\[\\[(.*)\\]\\]$', '\\1', 's'), '[|#].*$', '', 's'), '^.*/', '', 's')), '\\.md$', '', 'i')))"""
_ORPHANS = f"""
with refs as (
  select 'markdown_chunks' as ref_table, chunk_no as ref_key, unnest(list_distinct(wikilinks)) as link_value, vault_id, indexed_at from markdown_chunks
  union all
  select 'note_nodes', node_no, unnest(list_distinct(outgoing_links)), vault_id, indexed_at from note_nodes
), named as (select *, {_NAME.format("link_value")} as name from refs),
topics as (select lower(term) as name from topic_terms union select lower(unnest(short_forms)) from topic_terms),
names as (
  select vault_id, lower(title) as name, indexed_at, deleted_at from note_nodes
  union all select vault_id, lower(unnest(aliases)), indexed_at, deleted_at from note_nodes),
open_refs as (select * from named where name <> '' and name not in (select name from topics where name is not null)),
orphans as (
  select ref_table, ref_key, link_value, strftime(indexed_at, '%Y-%m') as period,
    case when exists (select 1 from names n where n.vault_id = r.vault_id and n.name = r.name and n.indexed_at <= r.indexed_at) then 'deleted'
         when exists (select 1 from names n where n.vault_id = r.vault_id and n.name = r.name) then 'late' else 'missing' end as why
  from open_refs r where not exists (
    select 1 from names n where n.vault_id = r.vault_id and n.name = r.name and n.indexed_at <= r.indexed_at and (n.deleted_at is null or n.deleted_at > r.indexed_at)))
"""
_DAY = 86_400_000_000
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
#: The forms of a date, as ``(pattern, group names)``, and what follows: a time with or without a zone, a zone alone, nothing.
_DATES = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})", "y m d"), (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "y m d"), (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})", "y m d"), (r"^(\d{4})(\d{2})(\d{2})T", "y m d"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "d m y"), (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "a b y"),
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[-\s.]+({MONTHS})[-\s.,]+(\d{{4}})", "d n y"), (rf"^{_WEEKDAY}({MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", "n d y"),
]
_TIMES = r"(?:(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\x01)?|(\d{1,2})\s*([ap])\x01)"  # am and pm with a mark behind, as there is no look-ahead here
_ZONES = r"(?:\s*(?:UTC|GMT)?([+−-])(\d{1,2})(?::?(\d{2}))?(?:\s*\[[A-Za-z_/+\-0-9]+\])?|\s*\[([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)\]|\s*([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)|\s*([A-Za-z]{1,5}))?"
_COMPACT = r"(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?"
_TRIMMED = r"regexp_replace(value, '^[\s\p{Z}\x22''`“”‘’]+|[\s\p{Z}\x22''`“”‘’]+$', '', 'g')"


def _form() -> str:
    return "case " + " ".join(f"when regexp_matches(bare, '{p}', 'i') then {i}" for i, (p, _) in enumerate(_DATES)) + " end"


def _part(name: str) -> str:
    """The group of a role in whichever form a value has."""
    return "case form " + " ".join(f"when {i} then regexp_extract(bare, '{p}', {names.split().index(name) + 1}, 'i')" for i, (p, names) in enumerate(_DATES) if name in names.split()) + " end"


def _abbreviation() -> str:
    rules = [f"when upper(ab) = '{name}'{f" and starts_with(tz, '{start}')" if start else ''} then {minutes}" for start, known in ABBREVIATIONS for name, minutes in known.items()]
    return "case " + " ".join(rules) + " end"


_AT = "epoch_us(timezone(zone, timezone('UTC', make_timestamp({0}))))"
_NORMALISED = rf"""
with all_values as (
  select 'interstitial_entries' as source_table, entry_no as record_key, 'timestamp' as field, timestamp as value, vault_id, entry_date from interstitial_entries
  union all select 'markdown_chunks', chunk_no, 'created', created, vault_id, null from markdown_chunks
  union all select 'markdown_chunks', chunk_no, 'modified', modified, vault_id, null from markdown_chunks
  union all select 'telegram_updates', delivery_id, 'date', date, vault_id, null from telegram_updates),
bared as (select v.*, tz, {_TRIMMED} as bare from all_values v left join vaults using (vault_id) where value is not null and not regexp_matches(value, '^[\s\p{{Z}}]*$')),
formed as (select *, {_form()} as form from bared),
dated as (select *, {_part("y")} as y, {_part("m")} as m0, {_part("d")} as d0, {_part("a")} as a0, {_part("b")} as b0, lower(substr({_part("n")}, 1, 3)) as n0,
  case form {" ".join(f"when {i} then substr(bare, length(regexp_extract(bare, '{p}', 0, 'i')) + {0 if i == 3 else 1})" for i, (p, _) in enumerate(_DATES))} else bare end as rest0 from formed),
halved as (select *, regexp_replace(rest0, '(\d\s*[ap])\.?m\.?($|[^A-Za-z])', '\1' || chr(1) || '\2', 'i') as rest from dated),
timed as (select *, case when form = 3 then regexp_extract(rest, '^T{_COMPACT}{_ZONES}$', ['h', 'i', 's', 'f', 'os', 'oh', 'om', 'zb', 'zn', 'ab'], 'i') end as c,
  regexp_extract(rest, '^(?:T|,?\s+(?:at\s+)?)?{_TIMES}{_ZONES}$', ['h', 'i', 's', 'f', 'ap', 'h2', 'ap2', 'os', 'oh', 'om', 'zb', 'zn', 'ab'], 'i') as t,
  case when form is not null then regexp_extract(rest, '^{_ZONES}$', ['os', 'oh', 'om', 'zb', 'zn', 'ab'], 'i') end as z,
  case when form is null and regexp_matches(bare, '^[+-]?\d+(?:\.\d+)?$') and not regexp_matches(rest, '^{_TIMES}{_ZONES}$', 'i') then bare end as number from halved),
chosen as (select *,
  case when number is not null then 'number' when form = 3 and regexp_matches(rest, '^T{_COMPACT}{_ZONES}$', 'i') then 'compact'
    when regexp_matches(rest, case when form is null then '^' else '^(?:T|,?\s+(?:at\s+)?)' end || '{_TIMES}{_ZONES}$', 'i') then 'time'
    when form is not null and regexp_matches(rest, '^{_ZONES}$', 'i') then 'date' end as kind from timed),
parts as (select source_table, record_key, field, tz, number, kind, form,
  case kind when 'compact' then c.h when 'time' then coalesce(nullif(t.h, ''), t.h2) end as h, case kind when 'compact' then c.i when 'time' then t.i end as i, case kind when 'compact' then c.s when 'time' then t.s end as s,
  case kind when 'compact' then c.f when 'time' then t.f end as f, case when kind = 'time' then lower(coalesce(nullif(t.ap, ''), t.ap2)) end as ap,
  nullif(case kind when 'compact' then c.os when 'time' then t.os when 'date' then z.os end, '') as os, case kind when 'compact' then c.oh when 'time' then t.oh when 'date' then z.oh end as oh,
  case kind when 'compact' then c.om when 'time' then t.om when 'date' then z.om end as om,
  coalesce(nullif(case kind when 'compact' then c.zb when 'time' then t.zb when 'date' then z.zb end, ''), nullif(case kind when 'compact' then c.zn when 'time' then t.zn when 'date' then z.zn end, '')) as zn,
  nullif(case kind when 'compact' then c.ab when 'time' then t.ab when 'date' then z.ab end, '') as ab,
  case when form is not null then y when regexp_matches(entry_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') then substr(entry_date, 1, 4) end as y,
  case when form is null then substr(entry_date, 6, 2) when a0 is not null then case when starts_with(coalesce(tz, ''), 'America/') then a0 else b0 end
    when n0 is not null then (strpos('janfebmaraprmayjunjulaugsepoctnovdec', n0) // 3 + 1)::varchar else m0 end as mo,
  case when form is null then substr(entry_date, 9, 2) when a0 is not null then case when starts_with(coalesce(tz, ''), 'America/') then b0 else a0 end else d0 end as d from chosen),
numbers as (select *, try_cast(nullif(y, '') as bigint) as yy, try_cast(nullif(mo, '') as bigint) as mm, try_cast(nullif(d, '') as bigint) as dd, coalesce(try_cast(nullif(h, '') as bigint), 0) as h0, coalesce(try_cast(nullif(i, '') as bigint), 0) as ii,
  coalesce(try_cast(nullif(s, '') as bigint), 0) as ss, coalesce(try_cast(rpad(substr(nullif(f, ''), 1, 6), 6, '0') as bigint), 0) as ff, nullif(ap, '') as p from parts),
walls as (select *, case when kind in ('compact', 'time', 'date') and yy between 1 and 9999 and mm between 1 and 12 and dd >= 1 and ss <= 59 and ii <= 59 and (case when p is not null then h0 between 1 and 12 else h0 <= 23 end)
    and dd <= (case when mm in (4, 6, 9, 11) then 30 when mm = 2 then case when (yy % 4 = 0 and yy % 100 <> 0) or yy % 400 = 0 then 29 else 28 end else 31 end)
  then epoch_us(make_timestamp(yy, mm, 1, 0, 0, 0.0)) + (dd - 1) * {_DAY} + (((case when p = 'a' then h0 % 12 when p = 'p' then h0 % 12 + 12 else h0 end) * 60 + ii) * 60 + ss) * 1000000 + ff end as wall from numbers),
zoned as (select *, os is not null or ab is not null as explicit,
  case when os is not null then case when oh::int <= 18 and coalesce(nullif(om, ''), '0')::int <= 59 then (oh::int * 60 + coalesce(nullif(om, ''), '0')::int) * case when os = '+' then 1 else -1 end end else {_abbreviation()} end as off,
  case when os is null and ab is null and wall is not null and coalesce(zn, tz) in (select name from pg_timezone_names()) then coalesce(zn, tz) end as zone_ from walls),
tried as (select *, coalesce(zone_, 'UTC') as zone from zoned),
offsets as (select *, wall - ({_AT.format(f"wall - {_DAY}")} - (wall - {_DAY})) as u1, wall - ({_AT.format(f"wall + {_DAY}")} - (wall + {_DAY})) as u2 from tried),
checked as (select *, {_AT.format("u1")} = wall as g1, {_AT.format("u2")} = wall as g2 from offsets),
counted as (select *, try_cast(regexp_extract(number, '^[+-]?(\d+)', 1) as bigint) as n, try_cast(rpad(substr(nullif(regexp_extract(number, '\.(\d+)$', 1), ''), 1, 6), 6, '0') as bigint) as nf from checked),
instants as (select *, case when number is not null then (case when n < 100000000000 then n * 1000000 + coalesce(nf, 0) when n < 100000000000000 then n * 1000 + coalesce(nf, 0) // 1000 when n < 100000000000000000 then n + coalesce(nf, 0) // 1000000 end) * case when starts_with(number, '-') then -1 else 1 end
  when explicit then wall - off::bigint * 60000000 when zone_ is not null then case when g1 then u1 else u2 end end as us from counted),
results as (select source_table, record_key, field, case
  when number is null and zone_ is not null and g1 and g2 and u1 <> u2 then 'ambiguous' when number is null and zone_ is not null and not g1 and not g2 then 'nonexistent'
  when us between -62135596800000000 and 253402300799999999 then strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') else 'unreadable' end as utc_text from instants)
"""
SQL = {
    "p3_found": _NORMALISED + "select * from results",
    "p3_quality": _NORMALISED + "select source_table, field, case when regexp_matches(utc_text, '^[0-9]') then 'instant' else utc_text end as result, count(*) as n_values from results group by all",
    "p1_found": _SAME + "select delivery_id from surplus",
    "p1_kept": _SAME + "select delivery_id, vault_id, update_id, chat_id, message_id, update_kind from telegram_updates where delivery_id not in (select delivery_id from surplus)",
    "p5_found": _ORPHANS + "select ref_table, ref_key, link_value, period from orphans",
    "p5_report": _ORPHANS + "select ref_table, period, why, count(*) as n_orphans from orphans group by all",
}

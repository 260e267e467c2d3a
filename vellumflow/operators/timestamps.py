"""Mixed timestamp formats and time zones to one UTC instant.

Every format stands in ONE regex alternation with named groups. A single ``regexp_replace`` writes all groups out
behind a separator (a group that took no part is empty, so the groups of one role, such as ``y1``..``y6``, are simply
written side by side) and ``split`` hands them over: the components are extracted once, inside the JVM, without Python.
Calendar ranges are then checked and the instant is assembled through integer day arithmetic. Wall clocks are read by
trying the zone's offsets of a day before and a day after: no offset that reproduces the wall clock means the clock
skipped it, two mean it was shown twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\u0001"
DAY = 86_400_000_000

# Month names as written in dates.
MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?"
    "|Nov(?:ember)?|Dec(?:ember)?"
)
# Zone abbreviations, as minutes east of Greenwich, by the start of the zone's name ("" is any zone).
ABBREVIATIONS = [
    ("", {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}),
    ("Europe/", {"WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180}),
    ("Europe/London", {"BST": 60}),
    ("Europe/Dublin", {"IST": 60}),
    ("America/", {
        "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
        "AKST": -540, "AKDT": -480, "AST": -240, "ADT": -180,
    }),
    ("Asia/Tokyo", {"JST": 540}),
    ("Asia/Seoul", {"KST": 540}),
    ("Asia/Shanghai", {"CST": 480}),
    ("Asia/Kolkata", {"IST": 330}),
    ("Asia/Kathmandu", {"NPT": 345}),
    ("Australia/", {"AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480}),
    ("Pacific/Auckland", {"NZST": 720, "NZDT": 780}),
]

DATE = (
    r"(?:"
    r"(?<y1>\d{4})(?<q1>[-/.])(?<m1>\d{1,2})\k<q1>(?<d1>\d{1,2})"
    r"|(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})(?=T\d)"
    r"|(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4})"
    r"|(?<a4>\d{1,2})/(?<b4>\d{1,2})/(?<y4>\d{4})"
    rf"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?(?<d5>\d{{1,2}})(?:st|nd|rd|th)?[-\s.]+(?<n5>{MONTHS})[-\s.,]+(?<y5>\d{{4}})"
    rf"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?(?<n6>{MONTHS})\.?\s+(?<d6>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y6>\d{{4}})"
    r")"
)
TIME = (
    r"(?:"
    r"(?<h1>\d{1,2})[:.](?<i1>\d{2})(?:[:.](?<s1>\d{2})(?:[.,](?<f1>\d+))?)?(?:\s*(?<p1>[ap])\.?m\.?(?![A-Za-z]))?"
    r"|(?<h2>\d{1,2})\s*(?<p2>[ap])\.?m\.?(?![A-Za-z])"
    r"|(?<=\d{8}T)(?<h3>\d{2})(?<i3>\d{2})(?:(?<s3>\d{2})(?:[.,](?<f3>\d+))?)?"
    r")"
)
ZONE = (
    r"(?:\s*(?:(?:UTC|GMT)(?=[+−-]))?(?<os>[+−-])(?<oh>\d{1,2})(?::?(?<om>\d{2}))?(?:\s*\[[A-Za-z_/+\-0-9]+\])?"
    r"|\s*\[(?<zb>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)\]"
    r"|\s*(?<zn>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)"
    r"|\s*(?<ab>[A-Za-z]{1,5})"
    r")?"
)
PATTERN = (
    r"(?i)^(?:"
    rf"{DATE}(?:(?:T|,?\s+(?:at\s+)?)(?=\d){TIME})?{ZONE}"
    rf"|{TIME.replace('1>', '4>').replace('2>', '5>').replace('3>', '6>')}{ZONE.replace('os>', 'ot>').replace('oh>', 'oi>').replace('om>', 'on>').replace('zb>', 'zc>').replace('zn>', 'zo>').replace('ab>', 'ac>')}"
    r"|(?<ns>[+-]?)(?<nu>\d+)(?:\.(?<nf>\d+))?"
    r")$"
)
#: What the replacement writes: one slot a role, made of the groups that can fill it.
ROLES = {
    "y": ["y1", "y2", "y3", "y4", "y5", "y6"], "mo": ["m1", "m2", "m3"], "mn": ["n5", "n6"], "d": ["d1", "d2", "d3", "d5", "d6"],
    "sa": ["a4"], "sb": ["b4"], "h": ["h1", "h2", "h3", "h4", "h5", "h6"], "mi": ["i1", "i3", "i4", "i6"], "s": ["s1", "s3", "s4", "s6"],
    "f": ["f1", "f3", "f4", "f6"], "ap": ["p1", "p2", "p4", "p5"], "os": ["os", "ot"], "oh": ["oh", "oi"], "om": ["om", "on"],
    "zn": ["zb", "zn", "zc", "zo"], "ab": ["ab", "ac"], "ns": ["ns"], "nu": ["nu"], "nf": ["nf"],
}
REPLACEMENT = SEP + SEP.join("".join("${" + g + "}" for g in groups) for groups in ROLES.values())


def known_zones(spark: SparkSession) -> list[str]:
    """Names of time zones that this JVM reads."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def days_of(y: str, m: str, d: str) -> str:
    """SQL of the day number (1970-01-01 is 0) of a proleptic Gregorian date, in integers only."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    doy = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    return f"(365 * {yy} + {yy} div 4 - {yy} div 100 + {yy} div 400 + {doy} - 719468)"


def utc_text(m: str = "m_") -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of the column ``m``, microseconds since 1970, whatever the session's time zone is."""
    day = F.expr(f"({m} - pmod({m}, {DAY})) div {DAY}")
    two = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0")
    r = f"pmod({m}, {DAY})"
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), two(f"{r} div 3600000000"), F.lit(":"),
        two(f"{r} div 60000000 % 60"), F.lit(":"), two(f"{r} div 1000000 % 60"), F.lit("."), F.lpad(F.expr(f"{r} % 1000000").cast("string"), 6, "0"), F.lit("Z"),
    )


def normalise_timestamps(df: DataFrame, value: str, zone: str, day: str | None = None, out: str = "utc_text") -> DataFrame:
    """Add ``out``: the UTC instant of the free-form column ``value``, as text with microseconds.

    ``zone``: column with the IANA zone that wall-clock values without a zone of their own are in. ``day``: column with
    the ``YYYY-MM-DD`` date that a time alone belongs to (None: a time alone is unreadable).

    Results: the instant, or ``ambiguous`` (the wall clock showed it twice), ``nonexistent`` (the wall clock skipped
    it), ``unreadable`` (no valid date or time, an unknown zone or abbreviation, a wall clock without a usable zone, a
    year outside 1..9999). Null and blank values give null. A number counts from 1970: below 1e11 in seconds, below
    1e14 in milliseconds, below 1e17 in microseconds, anything above is unreadable.
    Every column of ``df`` is kept under its name; the working columns live in one struct and can't clash.
    """
    spark = df.sparkSession
    zones = known_zones(spark)
    v = F.col(value)
    bare = F.regexp_replace(v, r"(?U)^[\s\"'`“”‘’]+|[\s\"'`“”‘’]+$", "")
    usable = ~F.contains(bare, F.lit(SEP))
    taken = F.split(F.when(usable, F.regexp_replace(bare, PATTERN, REPLACEMENT)), SEP)
    work = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"),
        v.alias("v_"),
        F.col(zone).alias("vault_tz_"),
        (F.col(day) if day else F.lit(None).cast("string")).alias("day_"),
        taken.alias("p_"),
    )
    matched = F.size("p_") == len(ROLES) + 1
    part = {k: F.when(matched, F.nullif(F.col("p_")[i + 1], F.lit(""))) for i, k in enumerate(ROLES)}
    work = work.select("row_", "v_", "vault_tz_", "day_", matched.alias("ok_"), *[c.alias(k + "_") for k, c in part.items()])
    num = lambda c: F.expr(f"try_cast({c} as bigint)")
    month_first = F.coalesce(F.startswith(F.col("vault_tz_"), F.lit("America/")), F.lit(False))
    day_ok = F.col("day_").rlike(r"^\d{4}-\d{2}-\d{2}$")
    own_date = F.col("y_").isNotNull()
    use_day = ~own_date & day_ok
    month_of = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring("mn_", 1, 3))) + 2).cast("bigint")
    work = work.select(
        "*",
        F.when(own_date, num("y_")).when(use_day, num("substring(day_, 1, 4)")).alias("yy_"),
        F.when(F.col("mn_").isNotNull(), F.floor(month_of / 3))
        .when(F.col("sa_").isNotNull(), F.when(month_first, num("sa_")).otherwise(num("sb_")))
        .when(own_date, num("mo_"))
        .when(use_day, num("substring(day_, 6, 2)"))
        .alias("mm_"),
        F.when(F.col("sa_").isNotNull(), F.when(month_first, num("sb_")).otherwise(num("sa_"))).when(own_date, num("d_")).when(use_day, num("substring(day_, 9, 2)")).alias("dd_"),
        F.coalesce(num("h_"), F.lit(0)).alias("h0_"),
        F.coalesce(num("mi_"), F.lit(0)).alias("ii_"),
        F.coalesce(num("s_"), F.lit(0)).alias("ss_"),
        F.coalesce(F.rpad(F.substring("f_", 1, 6), 6, "0").cast("bigint"), F.lit(0)).alias("ff_"),
    )
    pm = F.lower("ap_")
    leap = F.expr("(yy_ % 4 = 0 and yy_ % 100 <> 0) or yy_ % 400 = 0")
    last = F.when(F.col("mm_").isin(4, 6, 9, 11), 30).when(F.col("mm_") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (
        F.col("yy_").between(1, 9999) & F.col("mm_").between(1, 12) & (F.col("dd_") >= 1) & (F.col("dd_") <= last)
        & F.when(pm.isNotNull(), F.col("h0_").between(1, 12)).otherwise(F.col("h0_") <= 23) & (F.col("ii_") <= 59) & (F.col("ss_") <= 59)
        & (own_date | F.col("h_").isNotNull())
    )
    hour = F.when(pm == "a", F.col("h0_") % 12).when(pm == "p", F.col("h0_") % 12 + 12).otherwise(F.col("h0_"))
    clock = ((hour * 60 + F.col("ii_")) * 60 + F.col("ss_")) * 1_000_000 + F.col("ff_")
    work = work.withColumn("wall_", F.when(valid, F.expr(days_of("yy_", "mm_", "dd_")) * DAY + clock))
    abbr = None
    for start, known in ABBREVIATIONS:
        for name, minutes in known.items():
            hit = F.upper("ab_") == name
            if start:
                hit = hit & F.startswith(F.col("vault_tz_"), F.lit(start))
            abbr = F.when(hit, minutes) if abbr is None else abbr.when(hit, minutes)
    oh, om = num("oh_"), F.coalesce(num("om_"), F.lit(0))
    offset = F.when(F.col("os_").isNotNull(), F.when((oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(F.col("os_") == "+", 1).otherwise(-1))).otherwise(abbr)
    explicit = F.col("os_").isNotNull() | F.col("ab_").isNotNull()
    tz = F.coalesce("zn_", "vault_tz_")
    work = work.select(
        "*",
        offset.alias("off_"),
        explicit.alias("explicit_"),
        F.when(~explicit & F.col("wall_").isNotNull() & tz.isin(zones), tz).alias("tz_"),
    )
    at = lambda micros: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), F.col("tz_")))
    day_before, day_after = F.col("wall_") - DAY, F.col("wall_") + DAY
    work = work.select("*", (F.col("wall_") - (at(day_before) - day_before)).alias("u1_"), (F.col("wall_") - (at(day_after) - day_after)).alias("u2_"))
    work = work.select("*", (at(F.col("u1_")) == F.col("wall_")).alias("g1_"), (at(F.col("u2_")) == F.col("wall_")).alias("g2_"))
    local = (
        F.when(F.col("g1_") & F.col("g2_") & (F.col("u1_") != F.col("u2_")), F.lit("ambiguous"))
        .when(~F.col("g1_") & ~F.col("g2_"), F.lit("nonexistent"))
    )
    n = num("nu_")
    scale = F.when(n < 10**11, 1_000_000).when(n < 10**14, 1_000).when(n < 10**17, 1)
    fraction = F.coalesce(F.rpad(F.substring("nf_", 1, 6), 6, "0").cast("bigint"), F.lit(0))
    number = (n * scale + F.floor(fraction * scale / 1_000_000).cast("bigint")) * F.when(F.col("ns_") == "-", -1).otherwise(1)
    work = work.withColumn(
        "m_",
        F.when(F.col("nu_").isNotNull(), number)
        .when(F.col("explicit_"), F.col("wall_") - F.col("off_") * 60_000_000)
        .when(F.col("tz_").isNotNull(), F.when(F.col("g1_"), F.col("u1_")).otherwise(F.col("u2_"))),
    )
    in_range = F.col("m_").between(-62135596800000000, 253402300799999999)
    verdict = (
        F.when(F.col("v_").isNull() | F.col("v_").rlike(r"(?U)^\s*$"), F.lit(None).cast("string"))
        .when(F.col("tz_").isNotNull() & F.col("nu_").isNull() & local.isNotNull(), local)
        .when(in_range, utc_text("m_"))
        .otherwise(F.lit("unreadable"))
    )
    return work.select("row_.*", verdict.alias(out))

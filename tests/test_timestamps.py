"""The one-regex normaliser against datetime and zoneinfo, format by format."""

import itertools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from vellumflow.operators.timestamps import normalise_timestamps

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "UTC"]
WALLS = [datetime(2024, 3, 31, 2, 30), datetime(2024, 10, 27, 2, 30), datetime(2024, 3, 10, 2, 5), datetime(2024, 11, 3, 1, 59, 59), datetime(2024, 2, 29, 12, 0), datetime(1999, 12, 31, 23, 59), datetime(2024, 4, 7, 2, 30)]


def brute(wall, zone):
    """Instants whose wall clock in the zone is this one."""
    tz = ZoneInfo(zone)
    hits = {(wall.replace(tzinfo=tz, fold=f)).astimezone(timezone.utc) for f in (0, 1)}
    hits = {h for h in hits if h.astimezone(tz).replace(tzinfo=None) == wall}
    if len(hits) != 1:
        return "ambiguous" if hits else "nonexistent"
    return hits.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, tz string, day string, utc_old string")
    got = normalise_timestamps(df.drop("utc_old"), "v", "tz", "day").collect()
    return [r["utc_text"] for r in sorted(got, key=lambda r: r["i"])]


def test_formats_against_zoneinfo(spark):
    rows, expected = [], []
    for wall, zone in itertools.product(WALLS, ZONES):
        slash = "%m/%d/%Y" if zone.startswith("America") else "%d/%m/%Y"
        for form in ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y/%m/%d %H:%M:%S", "%d.%m.%Y, %H:%M:%S", slash + " %I:%M:%S %p", "%d-%b-%Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%b %d, %Y %I:%M:%S %p", "%Y%m%dT%H%M%S", "  '%Y-%m-%d %H:%M:%S' "]:
            rows.append((wall.strftime(form), zone, None, ""))
            expected.append(brute(wall, zone))
        rows.append((wall.strftime("%H:%M:%S"), zone, wall.strftime("%Y-%m-%d"), ""))
        expected.append(brute(wall, zone))
        rows.append((wall.strftime("%Y-%m-%d %H:%M:%S ") + zone if "/" in zone else wall.strftime("%Y-%m-%d %H:%M:%S"), "UTC", None, ""))
        expected.append(brute(wall, zone if "/" in zone else "UTC"))
        for minutes, shown in ((0, "Z"), (-300, "-05:00"), (345, "+0545"), (60, " +01"), (330, "+05:30[Asia/Kolkata]")):
            rows.append((wall.strftime("%Y-%m-%dT%H:%M:%S.%f000") + shown, zone, None, ""))
            expected.append((wall - timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    assert run(spark, rows) == expected


def test_numbers_abbreviations_and_refusals(spark):
    cases = [
        ("1698544857", "UTC", "2023-10-29T02:00:57.000000Z"), ("1698544857123", "UTC", "2023-10-29T02:00:57.123000Z"), ("1698544857123456", "UTC", "2023-10-29T02:00:57.123456Z"),
        ("1698544857.5", "UTC", "2023-10-29T02:00:57.500000Z"), ('"1698544857"', "UTC", "2023-10-29T02:00:57.000000Z"), ("-1", "UTC", "1969-12-31T23:59:59.000000Z"),
        ("2024-07-01 12:00 CEST", "Europe/Berlin", "2024-07-01T10:00:00.000000Z"), ("2024-07-01 12:00 CET", "Europe/Berlin", "2024-07-01T11:00:00.000000Z"),
        ("2024-01-01 12:00:00 CST", "America/Chicago", "2024-01-01T18:00:00.000000Z"), ("2024-01-01 12:00:00 CST", "Europe/Berlin", "unreadable"),
        ("Tue, 05 Mar 2024 01:21:21 -0800", "UTC", "2024-03-05T09:21:21.000000Z"), ("2024-01-02", "Asia/Tokyo", "2024-01-01T15:00:00.000000Z"),
        ("2024-01-02T03:04:05.1234567Z", "UTC", "2024-01-02T03:04:05.123456Z"), ("2024-06-10 03:57:00 America/Chicago", "UTC", "2024-06-10T08:57:00.000000Z"),
        ("2025-02-30T10:00:00", "UTC", "unreadable"), ("25:61", "UTC", "unreadable"), ("13:00 PM", "UTC", "unreadable"), ("now", "UTC", "unreadable"), ("2024-01-01 12:00 Mars/Base", "UTC", "unreadable"),
        ("2024-01-01", None, "unreadable"), ("2024-01-01", "No/Zone", "unreadable"), ("2024-01-01T00:00Z", None, "2024-01-01T00:00:00.000000Z"), ("10:00", "UTC", "unreadable"),
        ("9" * 5000, "UTC", "unreadable"), ("2024-01-02" + " " * 250 + "03:04", "UTC", "2024-01-02T03:04:00.000000Z"), ("2024-01-02T03:04:05." + "1" * 200 + "Z", "UTC", "2024-01-02T03:04:05.111111Z"), ("x" * 300, "UTC", "unreadable"), (None, "UTC", None), (" \t ", "UTC", None), ("0000-00-00 00:00", "UTC", "unreadable"), ("99999999999999999999", "UTC", "unreadable"),
    ]
    assert run(spark, [(v, z, None, "") for v, z, _ in cases]) == [e for *_, e in cases]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "UTC", "x", 1)], "v string, tz string, wall_ string, m_ int")
    out = normalise_timestamps(df, "v", "tz")
    assert out.first()["wall_"] == "x" and out.first()["utc_text"] == "2024-01-01T00:00:00.000000Z"
    assert normalise_timestamps(df.limit(0), "v", "tz").count() == 0


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert run(spark, [("2024-07-01 12:00", "Europe/Berlin", None, "")]) == ["2024-07-01T10:00:00.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

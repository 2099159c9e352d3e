"""Mixed timestamps against a plain reading, one stamp after the other."""

import re
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import duckdb
import pytest

from voxelmill.llm import timestamps

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
SCHEMA = "stamp_id long, source string, zone string, raw string"
EPOCH = datetime(1970, 1, 1)


def plain(rows):
    """(utc_us, rule, ambiguous) of each (source, zone, raw)."""

    def parse(zone, raw):
        t = (raw or "").strip(" \t\n\x0b\x0c\r")
        if re.fullmatch("[0-9]{10}|[0-9]{13}", t):
            return int(t) * (10**6 if len(t) == 10 else 1000)
        m = re.fullmatch(r"(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)\.(\d\d)\.(20\d\d)|(\d\d) ([A-Z][a-z]{2}) (20\d\d)|(\d\d)/(\d\d)/(20\d\d))(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(?:(Z)|([+-])(\d\d):?(\d\d)))?)?", t, re.ASCII)
        if not m:
            return None
        g = m.groups()
        hour, minute, second = (int(x or 0) for x in g[15:18])
        if minute > 59 or second > 59 or (hour > 23 if not g[18] else not 1 <= hour <= 12):
            return None
        if g[18]:
            hour = hour % 12 + (12 if g[18] == "P" else 0)
        offset = 0 if g[19] else None
        if g[20]:
            if int(g[21]) > 14 or int(g[22]) > 59:
                return None
            offset = (int(g[21]) * 60 + int(g[22])) * (-1 if g[20] == "-" else 1)
        if offset is None:
            try:
                ZoneInfo(zone)
            except Exception:
                return None
        if g[9] and g[10] not in MONTHS:
            return None
        month = MONTHS.index(g[10]) + 1 if g[9] else None
        options = [(g[0], g[1], g[2])] if g[0] else [(g[3], g[4], g[5])] if g[3] else [(g[8], g[7], g[6])] if g[6] else [(g[11], month, g[9])] if g[9] else [(g[14], g[13], g[12]), (g[14], g[12], g[13])]
        days = []
        for y, mo, d in options:
            try:
                days.append(date(int(y), int(mo), int(d)))
            except ValueError:
                days.append(None)
        return None if not any(days) else (days, (hour * 60 + minute) * 60 + second, offset)

    read = [parse(zone, raw) for _, zone, raw in rows]
    votes = Counter()
    for (source, _, _), r in zip(rows, read, strict=True):
        if isinstance(r, tuple) and len(r[0]) == 2 and None in r[0]:
            votes[source, r[0][0] is not None] += 1
    out = []
    for (source, zone, _), r in zip(rows, read, strict=True):
        if r is None:
            out.append((None, "bad", False))
            continue
        if isinstance(r, int):
            out.append((r, "epoch", False))
            continue
        days, clock, offset = r
        rule, day = "plain", next(d for d in days if d)
        if len(days) == 2 and None not in days and days[0] != days[1]:
            first, second = votes[source, True], votes[source, False]
            rule, day = ("default", days[0]) if first == second else ("votes", days[0] if first > second else days[1])
        wall = datetime(day.year, day.month, day.day) + timedelta(seconds=clock)
        odd = False
        if offset is None:
            z = ZoneInfo(zone)
            early, late = (wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
            odd, shift = early != late, late
        else:
            shift = timedelta(minutes=offset)
        out.append((int((wall - shift - EPOCH).total_seconds()) * 10**6, rule, odd or rule != "plain"))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
    got = timestamps.normalise(df).select("row.stamp_id", "utc_us", "rule", "ambiguous").collect()
    return [tuple(r)[1:] for r in sorted(got)]


def test_forms_against_a_plain_reading(spark):
    dates = ["2024-02-29", "2023-02-29", "20240503", "20241301", "03.05.2024", "31.04.2024", "07 Mar 2024", "07 mar 2024", "31 Feb 2024", "03/04/2024", "13/04/2024", "04/13/2024", "13/13/2024", "05/05/2024", "1999-01-01", "2024-1-01", "31/04/2024", "04/31/2024"]
    times = ["", "T00:00", " 23:59:59", " 24:00", " 12:60", " 12:00:60", " 12:30 AM", " 12:30PM", " 00:30 AM", " 13:00 PM", "T10:00Z", "T10:00 Z", "T10:00+05:30", " 10:00:07 -0830", "T10:00+15:00", "T10:00+14:59", "T10:00+01:60", " 01:15 PM +0100", "  10:00", "T10:00:00.5", " 10"]
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata"]
    rows = [(f"s{(k + j) % 3}", zones[(k * 7 + j) % 4], d + t) for k, d in enumerate(dates) for j, t in enumerate(times)]
    rows += [("s0", "UTC", x) for x in ["1710000000", "171000000", "1710000000123", "17100000001234", "٠١٢٣٤٥٦٧٨٩", "", "  ", "n/a", None, " \t2024-05-05 10:00\r\n", "\xa02024-05-05", "2024-05-05\x85", "2024-05-05|10:00"]]
    assert run(spark, rows) == plain(rows)


def test_wall_times_at_clock_changes(spark):
    rows = []
    for zone, days in (("America/New_York", ("2024-03-10", "2024-11-03")), ("Europe/Berlin", ("2024-03-31", "2024-10-27")), ("Asia/Kolkata", ("2024-03-10",)), ("Pacific/Apia", ("2011-12-30", "2011-12-29", "2011-12-31"))):
        rows += [("s", zone, f"{day} {h:02d}:{m:02d}") for day in days for h in range(24) for m in (0, 30, 59)]
    got = run(spark, rows)
    assert got == plain(rows)
    by = {r: g for r, g in zip(rows, got, strict=True)}
    # a skipped and a repeated time take the offset after the change
    assert by["s", "America/New_York", "2024-03-10 02:30"] == (int(datetime(2024, 3, 10, 6, 30, tzinfo=timezone.utc).timestamp()) * 10**6, "plain", True)
    assert by["s", "America/New_York", "2024-11-03 01:30"] == (int(datetime(2024, 11, 3, 6, 30, tzinfo=timezone.utc).timestamp()) * 10**6, "plain", True)


def test_votes(spark):
    slashed = "03/04/2024 10:00"
    rows = [("day", "UTC", x) for x in ["13/04/2024", "14/04/2024", "04/13/2024", slashed, "05/05/2024"]]
    rows += [("month", "UTC", x) for x in ["04/13/2024", "13/04/2024 24:00", slashed]]  # an impossible time does not vote
    rows += [("tie", "UTC", x) for x in ["04/13/2024", "13/04/2024", slashed]]
    rows += [("none", "UTC", slashed), (None, "UTC", "04/13/2024"), (None, "UTC", slashed), ("", "UTC", slashed)]
    got = run(spark, rows)
    assert got == plain(rows)
    rules = {(s, r): g[1] for (s, _, r), g in zip(rows, got, strict=True)}
    assert rules["day", slashed] == rules["month", slashed] == rules[None, slashed] == "votes" and rules["tie", slashed] == rules["none", slashed] == rules["", slashed] == "default"
    assert rules["day", "05/05/2024"] == "plain"


def test_odd_zones_and_rows(spark):
    rows = [("s", zone, raw) for zone in (None, "", "Mars/Base", " UTC ") for raw in ("2024-05-05 10:00", "2024-05-05 10:00Z", "1710000000", "13/04/2024", "03/04/2024")]
    got = run(spark, rows)
    assert [g[1] for g in got[:15]] == ["bad", "plain", "epoch", "bad", "bad"] * 3 and [g[1] for g in got[15:]] == ["plain", "plain", "epoch", "plain", "votes"]
    # repeated rows and ids each give a row; a text of any length is one stamp
    df = spark.createDataFrame([(1, "s", "UTC", "03/04/2024")] * 50 + [(None, "s", "UTC", "2024-05-05" + " " * 3_000_000), (None, "s", "UTC", "1" * 2_000_000)], SCHEMA)
    assert sorted(r["rule"] for r in timestamps.normalise(df).collect()) == ["bad"] + ["default"] * 50 + ["plain"]


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "s", "UTC", "03/04/2024", 7, 8, 9, 10)], SCHEMA + ", day int, rule int, salt int, voters int")
    r = timestamps.normalise(df).first()
    assert r["row"].asDict() == df.first().asDict() and r["rule"] == "default"
    assert timestamps.normalise(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_its_sql(spark, sf):
    got = timestamps.query(spark, f"/root/testdata/{sf}").toArrow()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW stamps AS SELECT * FROM '/root/testdata/{sf}/stamps.parquet'")
        want = c.sql(timestamps.SQL).to_arrow_table()
        key = lambda t: sorted(map(repr, t.select(["stamp_id", "utc_us", "rule", "ambiguous"]).to_pylist()))
        assert key(got) == key(want)

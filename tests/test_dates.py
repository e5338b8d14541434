"""Golden readings of era dates, numerals, and the cascade of notations."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkledger.functions.dates import era_date, kanji_int
from inkledger.functions.notations import local_to_utc, parse_day, parse_instant

ERA_CASES = [
    ("明三三、八、二", None, "1900-08-02", None),
    ("九、一二、二一", "大", "1920-12-21", None),
    ("昭和一〇、九、一", None, "1935-09-01", None),
    ("大正元、八、一", None, "1912-08-01", None),
    ("明四三、一二、二六", None, "1910-12-26", None),
    ("明治43年12月26日", None, "1910-12-26", None),
    ("明四五、七、三〇", None, "1912-07-30", None),
    ("大元、七、三〇", None, "1912-07-30", None),
    ("大一五、一二、二五", None, "1926-12-25", None),
    ("昭元、一二、二五", None, "1926-12-25", None),
    ("九、一二、二一", None, None, "no era marker"),
    ("九、一二、二一", "X", None, "unknown context era X"),
    ("明四六、一、一", None, None, "outside the 明 era"),
    ("大一六、三、一", None, None, "outside the 大 era"),
    ("明三三、一三、一", None, None, "month 13"),
    ("明三三、二、三〇", None, None, "day 30 invalid for 1900-02"),
    ("明三三、八", None, None, "expected year/month/day, got 2"),
    ("明三步、八、二", None, None, "unreadable numeral"),
    ("明５、八、二", None, None, "unreadable numeral"),
    ("明百、八、二", None, None, "unreadable numeral"),
    ("", None, None, "no era marker"),
    (None, None, None, "no era marker"),
    ("明" + "九" * 5000, None, None, "expected year/month/day, got 1"),
]


def test_era_dates(spark):
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(ERA_CASES)], "i int, t string, e string")
    got = {r.i: r.d for r in rows.select("i", era_date(F.col("t"), F.col("e")).alias("d")).collect()}
    for i, (text, _, day, reason) in enumerate(ERA_CASES):
        assert (got[i].value is None) != (got[i].reason is None), text
        if day:
            assert str(got[i].value) == day, text
        else:
            assert reason in got[i].reason, (text, got[i])


def test_numerals(spark):
    cases = {"三三": 33, "一二": 12, "二一": 21, "八": 8, "三〇": 30, "二十三": 23, "十": 10, "元": 1, "45": 45, "": None, "步": None, "三x": None, "十x": None, "百": None, "二十三十": None}
    rows = spark.createDataFrame(list(cases), "string").select("value", kanji_int("value").alias("n")).collect()
    assert {r.value: r.n for r in rows} == cases


@pytest.mark.parametrize(
    ("text", "era", "day"),
    [
        ("明治卅三年十月廿八日", None, "1900-10-28"),
        ("大四、七、二八任", None, "1915-07-28"),
        ("明四二、五、八 (任)", None, "1909-05-08"),
        ("明治40年6月17日生", None, "1907-06-17"),
        ("昭４年６月２６日", "大", "1929-06-26"),
        (" 明三五、一二、一七\xa0", None, "1902-12-17"),
        ("M44.7.1", None, "1911-07-01"),
        ("三、一〇、二四", "昭", "1928-10-24"),
        ("三、一〇、二四", None, None),
        ("28.5.1925", None, "1925-05-28"),
        ("24 Dec 1918", None, "1918-12-24"),
        ("December 28, 1910", None, "1910-12-28"),
        ("19001028", None, "1900-10-28"),
        ("1923-12-16 15:00:00+00", None, "1923-12-17"),
        ("1926-12-01T00:00:00+0900", None, "1926-12-01"),
        ("1900-10-28 00:00:00", None, "1900-10-28"),
        ("1900-10-28 05:00:00", None, None),
        ("大四、四、三一", None, None),
        ("大八、四、三?", None, None),
        ("昭七、帋、八", None, None),
        ("大一四、五、二帋", None, None),
        ("大八、七", None, None),
        ("1913?", None, None),
        ("同", "大", None),
        ("", "大", None),
    ],
)
def test_any_day(text, era, day):
    assert parse_day(text, era) == day


@pytest.mark.parametrize(
    ("text", "zone", "instant"),
    [
        ("2024-08-17T23:47:20Z", None, "2024-08-17T23:47:20Z"),
        ("2025-04-04 13:55:26 CEST", None, "2025-04-04T11:55:26Z"),
        ("Sun, 19 May 2024 11:25:29 +0900", None, "2024-05-19T02:25:29Z"),
        ("Mon, 19 May 2024 11:25:29 +0900", None, None),
        ("1734489347", None, "2024-12-18T02:35:47Z"),
        ("1745473980446", None, "2025-04-24T05:53:00Z"),
        ("令和6年3月21日 6時56分", "Asia/Tokyo", "2024-03-20T21:56:00Z"),
        ("Mar 9, 2025 4:28 AM", "America/New_York", "2025-03-09T08:28:00Z"),
        ("20250405T135526", "Europe/Berlin", "2025-04-05T11:55:26Z"),
        ("2025-10-26 01:46:55", "Europe/London", None),
        ("2025-03-30T02:54:03", "Europe/Berlin", None),
        ("2024-10-19T04:03:36.991349+00:00", None, "2024-10-19T04:03:36Z"),
        ("2025-09-06 25:61", "Asia/Tokyo", None),
        ("2025-13-27", "Asia/Tokyo", None),
        ("0000-00-00 00:00:00", "Asia/Tokyo", None),
        ("2025-03", "Asia/Tokyo", None),
        ("2024/11/05 14:03", None, None),
        ("2024/11/05 14:03", "No/Where", None),
        ("yesterday", "Asia/Tokyo", None),
    ],
)
def test_any_instant(text, zone, instant):
    assert parse_instant(text, zone) == instant


@given(st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2030, 1, 1)), st.sampled_from(["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Tokyo"]))
def test_local_times_round_trip_or_refuse(local, name):
    import zoneinfo

    local = local.replace(microsecond=0)
    utc = local_to_utc(local, name)
    zone = zoneinfo.ZoneInfo(name)
    seen = {u for h in range(-16, 17) for u in [local.replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)] if u.astimezone(zone).replace(tzinfo=None) == local}
    assert utc == (seen.pop() if len(seen) == 1 else None)

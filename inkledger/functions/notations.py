"""Days and instants in many notations: an ordered cascade of anchored patterns.

The first pattern that matches a whole text decides, and what it captures is parsed strictly,
so an impossible month, day, hour or weekday gives null.  Written as one column expression the
cascade outgrows the size of a generated method and would run interpreted; it is therefore an
Arrow function over the distinct values of each batch.

Policies, all explicit:

* a text with an unreadable mark, or any character no pattern foresees, gives null;
* an era's own mark goes before the context era; a day must lie within its era, whose first
  and last days belong to both neighbours;
* local times use the zone named in the text, else the default zone given by the caller; a
  local time that occurs twice (clocks set back) or never (clocks set forward) gives null, as
  does a local time without any zone;
* in a field of days, midnight without a zone is the day as written, any other clock reading
  without a zone gives null;
* null and blank give null; texts of any length are matched whole.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import unicodedata
import zoneinfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkledger.functions.dates import ERAS
from inkledger.functions.text import INVISIBLE

#: Zone abbreviations with one meaning in this data, in minutes from UTC.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "JST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Words that may stand around a complete date without a space.
AROUND_WORDS = ("任官", "叙任", "発令", "任", "叙", "補", "生まれ", "生れ", "生", "付", "附", "現在")

_ERA_OF = {key: (era[3], dt.date.fromisoformat(era[4]), dt.date.fromisoformat(era[5])) for era in ERAS for key in era[:3]}
_DIGITS = str.maketrans("〇零一二三四五六七八九", "00123456789") | {ord("廿"): "2十", ord("卅"): "3十", ord("卌"): "4十"}

_NUM = r"(元|\d{1,4}|\d?十\d?)"
_ERA = "(" + "|".join(n for era in ERAS for n in (era[1], era[0])) + "|[MTSHR])"
_LEAD = r"(?:(?:" + "|".join(AROUND_WORDS) + r") ?|\([^()\d]{1,12}\) ?|[^\W\d_]{1,12}[ :]+)?"
_TAIL = r"(?: ?(?:" + "|".join(AROUND_WORDS) + r")| ?\([^()\d]{1,12}\)| [^\W\d_]{1,12})?[。.]?"
_YMD = _NUM + r"(?:[、,.・/ -] ?|年 ?)" + _NUM + r"(?:[、,.・/ -] ?|月 ?)" + _NUM + "日?"
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
_ORD = r"(\d{1,2})(?:st|nd|rd|th)?"
_ZONE = r"(?: ?(Z|[+-]\d\d(?::?\d\d)?|[A-Z]{3,4}))?"
_CLOCK = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?"


def _pattern(text: str, flags: int = 0) -> re.Pattern:
    return re.compile(text, flags)


ERA_DAY = _pattern(_LEAD + _ERA + " ?" + _YMD + _TAIL)
BARE_DAY = _pattern(_LEAD + _YMD + _TAIL)
YEAR_FIRST = _pattern(_LEAD + r"(\d{4}) ?[-/.年] ?(\d{1,2}) ?[-/.月] ?(\d{1,2})日?" + _TAIL)
COMPACT = _pattern(_LEAD + r"(\d{4})(\d\d)(\d\d)" + _TAIL)
YEAR_LAST = _pattern(_LEAD + r"(\d{1,2})\.(\d{1,2})\.(\d{4})" + _TAIL)
DAY_MONTH = _pattern(_LEAD + _ORD + " " + _MONTH + r",? (\d{4})" + _TAIL, re.I)
MONTH_DAY = _pattern(_LEAD + _MONTH + " " + _ORD + r",? (\d{4})" + _TAIL, re.I)
ISO_CLOCK = _pattern(r"(\d{4})[-/](\d\d?)[-/](\d\d?)[T ]" + _CLOCK + _ZONE)
COMPACT_CLOCK = _pattern(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:[.,]\d+)?" + _ZONE)
MAIL_CLOCK = _pattern(r"(?:([A-Z][a-z]{2}), )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) " + _CLOCK + _ZONE)
US_CLOCK = _pattern(r"([A-Z][a-z]{2,8})\.? (\d{1,2}), (\d{4}) " + _CLOCK + r" ?([AaPp][Mm])" + _ZONE)
ERA_CLOCK = _pattern(_ERA + _NUM + "年 ?" + _NUM + "月 ?" + _NUM + r"日 ?(\d{1,2})時(\d{1,2})分(?:(\d{1,2})秒)?" + _ZONE)
EPOCH = _pattern(r"\d{9,10}|\d{12,13}|\d{15,16}")


def tidy(text: str) -> str:
    """Compatibility forms resolved, invisible characters dropped, spaces single and trimmed."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    spaced = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text))
    return INVISIBLE.sub(lambda m: " " if m[0] == " " else "", spaced).strip()


def number(text: str) -> int:
    if text == "元":
        return 1
    if "十" in text:
        tens, _, ones = text.partition("十")
        return int(tens or 1) * 10 + int(ones or 0)
    return int(text)


def _day(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def _era_day(era: str, year: str, month: str, day: str) -> dt.date | None:
    if era not in _ERA_OF:
        return None
    before, first, last = _ERA_OF[era]
    found = number(year) >= 1 and _day(before + number(year), number(month), number(day)) or None
    return found if found and first <= found <= last else None


def _month(name: str) -> int:
    return MONTHS.index(name.lower()[:3]) + 1 if name.lower()[:3] in MONTHS else 0


def _zone(text: str) -> dt.timezone | None:
    if text in ZONE_MINUTES:
        minutes = ZONE_MINUTES[text]
    elif text[0] in "+-":
        digits = text[1:].replace(":", "")
        hours, rest = int(digits[:2]), int(digits[2:] or 0)
        if hours > 14 or rest > 59:
            return None
        minutes = (hours * 60 + rest) * (-1 if text[0] == "-" else 1)
    else:
        return None
    return dt.timezone(dt.timedelta(minutes=minutes))


def _local(day: dt.date | None, hour: int, minute: int, second: int) -> dt.datetime | None:
    if day is None or hour > 23 or minute > 59 or second > 59:
        return None
    return dt.datetime.combine(day, dt.time(hour, minute, second))


@functools.cache
def zone_info(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def local_to_utc(local: dt.datetime, name: str | None) -> dt.datetime | None:
    """The one instant of a local time in a named zone; None if there is none or two."""
    zone = zone_info(name) if name else None
    if zone is None:
        return None
    found = set()
    for fold in (0, 1):
        utc = local.replace(tzinfo=zone, fold=fold).astimezone(dt.timezone.utc)
        if utc.astimezone(zone).replace(tzinfo=None) == local:
            found.add(utc)
    return found.pop() if len(found) == 1 else None


def _utc(local: dt.datetime | None, zone: str | None, default: str | None) -> dt.datetime | None:
    if local is None:
        return None
    try:
        if zone:
            offset = _zone(zone)
            return offset and local.replace(tzinfo=offset).astimezone(dt.timezone.utc)
        return local_to_utc(local, default)
    except OverflowError:
        return None


def parse_day(text: str, context_era: str | None) -> str | None:
    """The day in Japan (UTC+9) as ``YYYY-MM-DD``, or None."""
    c = tidy(text)
    d = c.translate(_DIGITS)
    day: dt.date | None = None
    if m := ERA_DAY.fullmatch(d):
        day = _era_day(*m.groups())
    elif m := YEAR_FIRST.fullmatch(d):
        day = _day(*map(int, m.groups()))
    elif m := ISO_CLOCK.fullmatch(c):
        g = m.groups()
        local = _local(_day(*map(int, g[:3])), int(g[3]), int(g[4]), int(g[5] or 0))
        if local and g[6]:
            utc = _utc(local, g[6], None)
            day = utc and (utc + dt.timedelta(hours=9)).date()
        elif local and local.time() == dt.time():
            day = local.date()
    elif m := COMPACT.fullmatch(c):
        day = _day(*map(int, m.groups()))
    elif m := YEAR_LAST.fullmatch(c):
        day = _day(*map(int, m.groups()[::-1]))
    elif m := DAY_MONTH.fullmatch(c):
        day = _day(int(m[3]), _month(m[2]), int(m[1]))
    elif m := MONTH_DAY.fullmatch(c):
        day = _day(int(m[3]), _month(m[1]), int(m[2]))
    elif m := BARE_DAY.fullmatch(d):
        day = _era_day(tidy(context_era or ""), *m.groups())
    return day.isoformat() if day else None


def parse_instant(text: str, default_zone: str | None) -> str | None:
    """The instant as ``YYYY-MM-DDTHH:MM:SSZ`` with fractions dropped, or None."""
    c = tidy(text)
    utc = None
    if m := ISO_CLOCK.fullmatch(c):
        g = m.groups()
        utc = _utc(_local(_day(*map(int, g[:3])), int(g[3]), int(g[4]), int(g[5] or 0)), g[6], default_zone)
    elif m := COMPACT_CLOCK.fullmatch(c):
        g = m.groups()
        utc = _utc(_local(_day(*map(int, g[:3])), int(g[3]), int(g[4]), int(g[5])), g[6], default_zone)
    elif m := MAIL_CLOCK.fullmatch(c):
        g = m.groups()
        day = _day(int(g[3]), _month(g[2]), int(g[1]))
        if day and g[0] and (g[0].lower() not in WEEKDAYS or WEEKDAYS.index(g[0].lower()) != day.weekday()):
            day = None
        utc = _utc(_local(day, int(g[4]), int(g[5]), int(g[6] or 0)), g[7], default_zone)
    elif m := US_CLOCK.fullmatch(c):
        g = m.groups()
        if 1 <= int(g[3]) <= 12:
            hour = int(g[3]) % 12 + 12 * (g[6].lower() == "pm")
            utc = _utc(_local(_day(int(g[2]), _month(g[0]), int(g[1])), hour, int(g[4]), int(g[5] or 0)), g[7], default_zone)
    elif m := ERA_CLOCK.fullmatch(c.translate(_DIGITS)):
        g = m.groups()
        utc = _utc(_local(_era_day(*g[:4]), int(g[4]), int(g[5]), int(g[6] or 0)), g[7], default_zone)
    elif EPOCH.fullmatch(c):
        seconds = int(c) // (1 if len(c) <= 10 else 1000 if len(c) <= 13 else 1_000_000)
        utc = dt.datetime.fromtimestamp(seconds, dt.timezone.utc)
    return utc.strftime("%Y-%m-%dT%H:%M:%SZ") if utc else None


#: Values remembered by each worker: dates repeat from batch to batch.
_REMEMBERED = 200_000


@functools.lru_cache(_REMEMBERED)
def _day_of(text: str, context_era: str | None) -> str | None:
    return parse_day(text, context_era)


@functools.lru_cache(_REMEMBERED)
def _instant_of(text: str, default_zone: str | None) -> str | None:
    return parse_instant(text, default_zone)


def _pairwise(function, first: pd.Series, second: pd.Series) -> pd.Series:
    """``function`` of each pair whose first value is not null."""
    return pd.Series([function(a, b if isinstance(b, str) else None) if isinstance(a, str) else None for a, b in zip(first, second)], dtype=object)


@F.pandas_udf(StringType())
def _days(texts: pd.Series, eras: pd.Series) -> pd.Series:
    return _pairwise(_day_of, texts, eras)


@F.pandas_udf(StringType())
def _instants(texts: pd.Series, zones: pd.Series) -> pd.Series:
    return _pairwise(_instant_of, texts, zones)


def any_day(text: Column, context_era: Column | None = None) -> Column:
    return _days(text, F.lit(None).cast("string") if context_era is None else context_era)


def any_instant(text: Column, default_zone: Column) -> Column:
    return _instants(text, default_zone)

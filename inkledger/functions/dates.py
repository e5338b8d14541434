"""Calendar-era dates as JVM-side column expressions.

``era_date`` is the strict normaliser of a roster's own notation: it gives a day xor a
reason, and never guesses.  (The cascade over many foreign notations is in ``notations``.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eras as (mark, full name, letter, year before the first, first day, last day).
ERAS = (
    ("明", "明治", "M", 1867, "1868-01-25", "1912-07-30"),
    ("大", "大正", "T", 1911, "1912-07-30", "1926-12-25"),
    ("昭", "昭和", "S", 1925, "1926-12-25", "1989-01-07"),
    ("平", "平成", "H", 1988, "1989-01-07", "2019-05-01"),
    ("令", "令和", "R", 2018, "2019-04-30", "9999-12-31"),
)
#: The eras a roster's own notation may use.
ROSTER_ERAS = ERAS[:3]


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date if the three make one, else null."""
    fits = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(fits, F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def _era_field(mark: Column, field: int, eras=ROSTER_ERAS) -> Column:
    """One field of the era whose mark, name or letter is given."""
    out = F.lit(None)
    for era in reversed(eras):
        out = F.when(mark.isin(era[0], era[1], era[2]), F.lit(era[field])).otherwise(out)
    return out


def _within(day: Column, mark: Column, eras=ROSTER_ERAS) -> Column:
    ok = F.lit(False)
    for era in eras:
        ok = F.when(mark.isin(era[0], era[1], era[2]), day.between(F.lit(era[4]).cast("date"), F.lit(era[5]).cast("date"))).otherwise(ok)
    return ok


def _tens(c: Column) -> Column:
    """Value of a numeral with one 十 between at most one digit on either side."""
    tens, ones = F.regexp_extract(c, "^([0-9]?)十", 1), F.regexp_extract(c, "十([0-9]?)$", 1)
    return F.when(tens == "", 1).otherwise(tens.try_cast("bigint")) * 10 + F.when(ones == "", 0).otherwise(ones.try_cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A plain expression is copied to every place that uses it, and this one would outgrow a
    generated method; a lambda variable is bound instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def kanji_int(column: Column | str) -> Column:
    """Strict numeral of the roster notation: 元, ASCII digits, juxtaposed ideographic digits or
    one 十 with at most one digit on either side; anything else gives null."""
    c = F.col(column) if isinstance(column, str) else column
    pure = "^(元|[0-9]{1,9}|[〇一二三四五六七八九]{1,9}|[一二三四五六七八九]?十[一二三四五六七八九]?)$"

    def value(t: Column) -> Column:
        digits = F.translate(t, "〇一二三四五六七八九", "0123456789")
        return F.when(t.rlike(pure), F.when(t == "元", F.lit(1).cast("bigint")).when(t.contains("十"), _tens(digits)).otherwise(digits.try_cast("bigint")))

    return let(F.trim(c), value)


def era_date(column: Column | str, context_era: Column | None = None) -> Column:
    """``struct<value date, reason string>`` of an era date: exactly one of the two is set.

    Null and blank count as a text without an era mark.
    """
    c = F.col(column) if isinstance(column, str) else column
    context = context_era if context_era is not None else F.lit(None).cast("string")
    names = "|".join(e[1] for e in ROSTER_ERAS)
    marks = "".join(e[0] for e in ROSTER_ERAS)
    known = context.isin(*[e[0] for e in ROSTER_ERAS])

    def split(s: Column) -> Column:
        name, mark = s.rlike(f"^({names})"), s.rlike(f"^[{marks}]")
        era = F.when(name | mark, F.substring(s, 1, 1)).when(known, context)
        rest = F.when(name, F.substr(s, F.lit(3))).when(mark, F.substr(s, F.lit(2))).otherwise(s)
        parts = F.filter(F.split(rest, "[、,，. ・年月日]"), lambda x: F.trim(x) != "")
        numbers = F.transform(parts, kanji_int)
        return F.struct(era.alias("era"), (context.isNotNull() & ~known & ~name & ~mark).alias("odd"), F.size(parts).alias("n"), numbers.alias("v"))

    def date(x: Column) -> Column:
        y, m, d = (F.get(x.v, F.lit(i)) for i in range(3))
        year = F.when(y.between(0, 9000), _era_field(x.era, 3, ROSTER_ERAS) + y).cast("int")
        fits = (x.n == 3) & (F.size(F.array_compact(x.v)) == 3)
        return F.struct(x.era.alias("era"), x.odd.alias("odd"), x.n.alias("n"), fits.alias("fits"), year.alias("y"), m.alias("m"), d.alias("d"), F.when(fits, _day(year, m.cast("int"), d.cast("int"))).alias("value"))

    def judged(x: Column) -> Column:
        reason = (
            F.when(x.odd, F.concat(F.lit("unknown context era "), context))
            .when(x.era.isNull(), "no era marker and no context era")
            .when(x.n != 3, F.concat(F.lit("expected year/month/day, got "), x.n.cast("string"), F.lit(" part(s)")))
            .when(~x.fits, "unreadable numeral")
            .when(~x.m.between(1, 12), F.concat(F.lit("month "), x.m.cast("string"), F.lit(" out of range")))
            .when(x.value.isNull(), F.concat(F.lit("day "), x.d.cast("string"), F.lit(" invalid for "), F.coalesce(x.y.cast("string"), F.lit("year")), F.lit("-"), F.lpad(x.m.cast("string"), 2, "0")))
            .when(~_within(x.value, x.era, ROSTER_ERAS), F.concat(x.value.cast("string"), F.lit(" falls outside the "), x.era, F.lit(" era")))
        )
        return let(reason, lambda r: F.struct(F.when(r.isNull(), x.value).alias("value"), r.alias("reason")))

    return let(let(let(F.trim(F.coalesce(c, F.lit(""))), split), date), judged)

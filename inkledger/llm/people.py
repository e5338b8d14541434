"""What readings and printed pages say of a person, made comparable.

Names are taken to their consistent form, titles and pet endings are removed, unreadable marks
become wildcards.  Readings in kana are folded over width, small letters, voicing marks and
historical spelling.  Dates, years, branches and births come out as plain columns.  Everything
missing is null; nothing here compares rows with each other.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from inkledger.functions.notations import _DIGITS, _ERA, _ERA_OF, _NUM, number, parse_day, tidy
from inkledger.functions.text import form_of, on_distinct, repair, visible
from inkledger.llm.canonical_values import UNMATCHED, Matcher, Normal, aliases
from inkledger.session import cut_lineage

WILD = "〓"
#: Titles before a name and endings after it.
TITLES = ("男爵", "子爵", "伯爵", "故", "監", "技師")
PET_ENDINGS = ("さん", "坊", "公", "君")
_HISTORIC = {"カウ": "コウ", "サウ": "ソウ", "タウ": "トウ", "ナウ": "ノウ", "ハウ": "ホウ", "マウ": "モウ", "ヤウ": "ヨウ", "ラウ": "ロウ", "ワウ": "オウ"}
_SAME_KANA = str.maketrans("ァィゥェォャュョッヮヂヅヱヰヲ", "アイウエオヤユヨツワジズエイオ")
_LATIN = re.compile("[A-Za-z]")


def name_core(form: str) -> str | None:
    """Name without title, pet ending and unreadable marks; None for Latin letters and blanks."""
    if not form or _LATIN.search(form):
        return None
    core = re.sub("[□?？_＿◯○*]", WILD, form)
    for title in TITLES:
        if core.startswith(title) and len(core) > len(title) + 1:
            core = core[len(title) :]
            break
    for ending in PET_ENDINGS:
        if core.endswith(ending) and len(core) > len(ending) + 1:
            core = core[: -len(ending)]
            break
    return core if core.strip(WILD) else None


def kana_key(text: str) -> str | None:
    """Folded reading: width, small letters, voicing and historical spelling do not count."""
    kana = unicodedata.normalize("NFKC", text).translate(_SAME_KANA)
    kana = "".join(c for c in unicodedata.normalize("NFD", kana) if "ァ" <= c <= "ヺ")
    for old, new in _HISTORIC.items():
        kana = kana.replace(old, new)
    return kana or None


#: Hepburn syllables, in the order of the kana they stand for.
_ROMAN = {
    "kya": "キヤ", "kyu": "キユ", "kyo": "キヨ", "sha": "シヤ", "shu": "シユ", "sho": "シヨ", "cha": "チヤ", "chu": "チユ", "cho": "チヨ", "nya": "ニヤ", "nyu": "ニユ", "nyo": "ニヨ",
    "hya": "ヒヤ", "hyu": "ヒユ", "hyo": "ヒヨ", "mya": "ミヤ", "myu": "ミユ", "myo": "ミヨ", "rya": "リヤ", "ryu": "リユ", "ryo": "リヨ", "gya": "キヤ", "gyu": "キユ", "gyo": "キヨ",
    "bya": "ヒヤ", "byu": "ヒユ", "byo": "ヒヨ", "shi": "シ", "chi": "チ", "tsu": "ツ", "ja": "シヤ", "ju": "シユ", "jo": "シヨ", "ji": "シ", "fu": "フ",
}
_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "カキクケコ", "z": "サシスセソ", "d": "タチツテト", "b": "ハヒフヘホ", "p": "ハヒフヘホ"}
_ROMAN |= {c + v: kana[i] for c, kana in _ROWS.items() for i, v in enumerate("aiueo") if c + v not in ("si", "ti", "tu", "hu", "zi")} | {"ya": "ヤ", "yu": "ユ", "yo": "ヨ", "wa": "ワ", "n": "ン"}


def short_vowels(kana: str) -> str:
    """Long vowels written short: オウ, オオ and ウウ as one, since Latin spellings drop them."""
    out = ""
    for c in kana:
        if out and c in "ウオ" and out[-1] in "オコソトノホモヨロ" or out and c == "ウ" and out[-1] in "ウクスツヌフムユル":
            continue
        out += c
    return out


def roman_kana(word: str) -> str | None:
    """Folded kana of a romanised word; None if it is none."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c.isascii() and c.isalpha())
    out, at = "", 0
    while at < len(plain):
        for size in (3, 2, 1):
            if kana := _ROMAN.get(plain[at : at + size]):
                out, at = out + kana, at + size
                break
        else:
            if plain[at : at + 2] and plain[at] == plain[at + 1 : at + 2]:
                at += 1  # a doubled consonant
                out += "ツ"
            else:
                return None
    return out or None


def latin_readings(text: str) -> list[str]:
    """Folded readings a romanised name may stand for: family and given name in both orders;
    none where one of them is an initial, which says too little."""
    words = [repair(visible(w)) for w in re.split(r"[\s,]+", unicodedata.normalize("NFKC", text)) if visible(w)]
    if len(words) != 2 or any(len(w.strip(".")) < 2 or not _LATIN.search(w) for w in words):
        return []
    kana = [roman_kana(w) for w in words]
    if None in kana:
        return []
    return sorted({short_vowels(kana[0] + kana[1]), short_vowels(kana[1] + kana[0])})


_YEAR = re.compile("(?:" + _ERA + " ?)?" + _NUM + "(?:[、,.・/ -]|年|$)")


def year_of(text: str, context_era: str | None) -> int | None:
    """Year of a date that need not be complete."""
    d = tidy(text).translate(_DIGITS)
    if m := re.match(r"(\d{4})(?!\d)", d):
        return int(m[1])
    m = _YEAR.match(d)
    if m is None:
        return None
    era = m[1] or (tidy(context_era or "") if "、" in d or m[1] else "")
    if era not in _ERA_OF or number(m[2]) < 1:
        return None
    before, _, last = _ERA_OF[era]
    year = before + number(m[2])
    return year if year <= last.year else None


_SEP = "(?:[、,.・/ -] ?|年 ?)"
_MONTH_OF = re.compile("(?:" + _ERA + " ?)?" + _NUM + _SEP + _NUM + "(?:[、,.・/ -]|月|$)")
_MONTH_DAY = re.compile(_SEP + _NUM + "(?:[、,.・/ -] ?|月 ?)" + _NUM + r"日?(?: ?[^\d]{1,4})?$")


def date_facts(text: str, context_era: str | None) -> tuple[str | None, int | None, str | None, str | None]:
    """What a date says that need not be complete: day, year, year and month, month and day."""
    day = parse_day(text, context_era)
    if day:
        return day, int(day[:4]), day[:7], day[5:]
    year = year_of(text, context_era)
    d = tidy(text).translate(_DIGITS)
    month = None
    if year and (m := re.match(r"\d{4}[-/.年] ?(\d{1,2})(?!\d)", d) or _MONTH_OF.match(d)):
        month = number(m.groups()[-1])
    ending = _MONTH_DAY.search(d)
    within = ending and (number(ending[1]), number(ending[2]))
    return (
        None,
        year,
        f"{year}-{month:02d}" if month and 1 <= month <= 12 else None,
        f"{within[0]:02d}-{within[1]:02d}" if within and 1 <= within[0] <= 12 and 1 <= within[1] <= 31 else None,
    )


@functools.lru_cache(200_000)
def _facts_of(text: str, context_era: str | None) -> tuple[str | None, int | None, str | None, str | None]:
    return date_facts(text, context_era)


def dates_of(text: Column, context_era: Column | None = None) -> Column:
    """``struct<day string, year int, month string, within string>`` of a date column."""

    @F.pandas_udf("day string, year int, month string, within string")
    def run(texts: pd.Series, eras: pd.Series) -> pd.DataFrame:
        rows = [_facts_of(t, e if isinstance(e, str) else None) if isinstance(t, str) else (None,) * 4 for t, e in zip(texts, eras)]
        return pd.DataFrame(rows, columns=["day", "year", "month", "within"]).astype({"year": "Int32"})

    return run(text, F.lit(None).cast("string") if context_era is None else context_era)


def name_fields(column: str, variants: dict[str, str]) -> Column:
    """``struct<form string, core string>`` of a name column."""
    table = str.maketrans(variants)

    @F.pandas_udf("form string, core string")
    def run(values: pd.Series) -> pd.DataFrame:
        found = on_distinct(values, lambda x: (f := form_of(x, table), name_core(f)))
        return pd.DataFrame([x if x is not None else (None, None) for x in found], columns=["form", "core"])

    return run(F.col(column))


def reading_fields(column: str, variants: dict[str, str]) -> Column:
    """``struct<form string, kana string, said string>`` of a reading column; ``said`` has its long
    vowels short, as romanised names are compared."""
    table = str.maketrans(variants)

    @F.pandas_udf("form string, kana string, said string")
    def run(values: pd.Series) -> pd.DataFrame:
        found = on_distinct(values, lambda x: (form_of(x, table), k := kana_key(x), short_vowels(k) if k else None))
        return pd.DataFrame([x if x is not None else (None, None, None) for x in found], columns=["form", "kana", "said"])

    return run(F.col(column))


def romanised(column: str) -> Column:
    """Folded readings of a romanised name, an empty array for any other."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return on_distinct(values, lambda x: latin_readings(x) if _LATIN.search(x) or not x.isascii() else [])

    return run(F.col(column))


@functools.lru_cache(4)
def _matcher(entries: tuple, variants: tuple) -> Matcher:
    """One matcher for each worker and list, with what it has decided."""
    normal = Normal(dict(variants))
    return Matcher(aliases(list(entries), normal), normal)


def branch_of(column: str, entries: list[tuple], variants: dict[str, str]) -> Column:
    """Branch code that a typed value means, else null."""
    listed, pairs = tuple(entries), tuple(sorted(variants.items()))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        match = _matcher(listed, pairs)
        return on_distinct(values, lambda x: (code if (code := match(x)[0]) != UNMATCHED else None) if x.strip() else None)

    return run(F.col(column))


def branch_in_post(column: str, entries: list[tuple], variants: dict[str, str]) -> Column:
    """Branch code with whose name a post begins, else null."""
    table = str.maketrans(variants)
    stems = sorted({(form_of(e[1], table)[:-1], e[0]) for e in entries if e[1] and len(e[1]) > 2}, key=lambda s: -len(s[0]))

    def find(text: str) -> str | None:
        form = form_of(text, table)
        return next((code for stem, code in stems if form.startswith(stem)), None)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return on_distinct(values, find)

    return run(F.col(column))


@functools.lru_cache(maxsize=200_000)
def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; a wildcard equals any character."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = before + 1 if x == y or x == WILD or y == WILD else max(here, row[j - 1])
            before = here
    return row[-1]


def name_ratio(a: str, b: str) -> float:
    """Longest-common-subsequence ratio, at its best over the orders family-given, given-family.

    The ratio of names that share fewer than half their characters is 0; every unreadable mark
    takes a tenth off, as it fits anything.
    """
    if a == b:
        return 1.0
    least = (len(a) + len(b)) / 4
    if sum(min(a.count(c), b.count(c)) for c in set(a)) + a.count(WILD) + b.count(WILD) < least:
        return 0.0
    doubt = 0.1 * (a.count(WILD) + b.count(WILD))
    return max(0.0, min(0.99, 2 * _common_in_order(a, b) / (len(a) + len(b))) - doubt)


def kana_ratio(a: str, b: str) -> float:
    """The same for folded readings, one of which may be the given name only."""
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 3 and long_.endswith(short):
        return 0.95
    tail = long_[-len(short) - 1 :] if len(short) < len(long_) - 2 else long_
    return min(0.99, 2 * _common(short, tail) / (len(short) + len(tail)))


def _common_in_order(a: str, b: str) -> int:
    best = _common(a, b)
    if best < min(len(a), len(b)) and len(b) > 3:
        best = max(best, _common(a, b[2:] + b[:2]), _common(a, b[-2:] + b[:-2]))
    return best


#: Levels of likeness of two names, from the length of their longest common subsequence: none;
#: ratio of 0.6; ratio of 0.66 with one character missing; one character replaced; one replaced by an unreadable mark; one is
#: the other with characters left out or doubled; the same characters in another order; equal.
UNLIKE, DISTANT, NEAR, REPLACED, MARKED, WITHIN, MOVED, EQUAL = range(8)
#: No name on one side.
NO_NAME = 8


def name_level(a: str, b: str) -> int:
    if a == b:
        return EQUAL if len(a) > 2 else NEAR
    wild = a.count(WILD) + b.count(WILD)
    common = _common_in_order(a, b)
    ratio = 2 * common / (len(a) + len(b))
    least, most = sorted((len(a), len(b)))
    if ratio < 0.6:
        return UNLIKE
    if least >= 3 and not wild and least == most and sorted(a) == sorted(b):
        return MOVED
    if common == least >= 3 and most - least <= 2:
        return WITHIN if not wild else MARKED if common - wild >= 2 else DISTANT
    if least == most >= 4 and common == least - 1 and not wild:
        return REPLACED
    return NEAR if ratio >= 0.66 and common >= 3 and least - common <= 1 and not wild else DISTANT


#: Levels of likeness of two folded readings: none on one side, unlike, 0.6, 0.75, the given name of
#: the other, equal.
KANA_NONE, KANA_UNLIKE, KANA_DISTANT, KANA_NEAR, KANA_WITHIN, KANA_EQUAL = range(6)


def kana_level(a: str, b: str) -> int:
    """The best over the readings that either side may have, separated by a bar."""
    return max(_kana_level(x, y) for x in a.split("|") for y in b.split("|"))


def _kana_level(a: str, b: str) -> int:
    if a == b:
        return KANA_EQUAL
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 3 and long_.startswith(short):
        return KANA_WITHIN
    ratio = kana_ratio(a, b)
    if ratio == 0.95:
        return KANA_WITHIN
    return KANA_NEAR if ratio >= 0.75 else KANA_DISTANT if ratio >= 0.6 else KANA_UNLIKE


def _level_udf(function, missing: int):
    """Level of two texts; ``missing`` if one of them is null."""

    @F.pandas_udf(IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        level = functools.lru_cache(None)(function)
        return pd.Series([level(x, y) if isinstance(x, str) and isinstance(y, str) else missing for x, y in zip(a, b)], dtype="int32")

    return run


def _pair_udf(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        score = functools.lru_cache(None)(function)
        return pd.Series([score(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")

    return run


name_similarity = _pair_udf(name_ratio)
name_likeness = _level_udf(name_level, NO_NAME)
kana_likeness = _level_udf(kana_level, KANA_NONE)


def char_bits(text: Column) -> Column:
    """The characters of a text as a set of 64 bits, by hash."""
    bit = F.transform(F.split(text, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(c), F.lit(64))))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda all_, one: all_.bitwiseOR(one))


def sketch(text: Column) -> Column:
    """What bounds the likeness of a text in few bytes: its characters as bits, its length and whether it
    has unreadable marks; null for null."""
    return F.when(text.isNotNull(), F.struct(char_bits(text).alias("bits"), F.length(text).alias("size"), text.contains(WILD).alias("wild")))


def _kept(a: Column, b: Column) -> Column:
    """Upper bound of how many characters of ``a`` occur in the other text."""
    return a["size"] - F.bit_count(a["bits"].bitwiseAND(F.bitwise_not(b["bits"])))


def may_be_like(a: Column, b: Column, ratio: float = 0.6) -> Column:
    """Whether two names, given as sketches, can reach a ratio of common subsequence: a bound from the
    characters that the other name has at all, so that most pairs of a block never reach Python.  Bit
    sets keep the join's generated code and its rows small."""
    kept = F.least(_kept(a, b), _kept(b, a))
    return (2 * kept >= ratio * (a["size"] + b["size"])) | a["wild"] | b["wild"]


def may_sound_like(a: Column, b: Column) -> Column:
    """Whether a reading can be like another, or the given name of the other: the same bound, against
    the shorter one."""
    return F.least(_kept(a, b), _kept(b, a)) >= 0.75 * F.least(a["size"], b["size"])


def readings(observation_in: DataFrame, variants: dict[str, str], branches: list[tuple]) -> DataFrame:
    """One row for each reading: obs_id, cell, form, core, latin (readings of a romanised name), day,
    year, month, within (month and day), branch.

    A row delivered twice counts once; a reading without a full cell key is a cell of its own.
    """
    rows = observation_in.select("obs_id", "volume_id", "frame_no", "row_index", "name_raw", "commissioning_date", "context_era", "branch_code").where("obs_id IS NOT NULL").dropDuplicates(["obs_id"])
    full = F.col("volume_id").isNotNull() & F.col("frame_no").isNotNull() & F.col("row_index").isNotNull()
    rows = rows.select(
        "obs_id",
        "name_raw",
        F.when(full, F.concat_ws(":", "volume_id", "frame_no", "row_index")).otherwise(F.concat(F.lit("#"), F.col("obs_id"))).alias("cell"),
        name_fields("name_raw", variants).alias("n"),
        romanised("name_raw").alias("latin"),
        dates_of(F.col("commissioning_date"), F.col("context_era")).alias("d"),
        branch_of("branch_code", branches, variants).alias("branch"),
    )
    return rows.select("obs_id", "cell", "name_raw", "n.form", "n.core", "latin", "d.day", "d.year", "d.month", "d.within", "branch")


def by_cell(rows: DataFrame) -> DataFrame:
    """Readings with the day, year and branch that most readings of their cell give (of equals the
    larger), so that one slip does not part a cell."""
    facts = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in ("day", "year", "month", "within", "branch")])
    votes = rows.select("cell", F.explode(facts).alias("x"))
    votes = votes.where("x.v IS NOT NULL").groupBy("cell", "x.f", "x.v").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("cell").agg(*[F.max(F.when(F.col("f") == f, F.struct("n", "v"))).alias(f) for f in ("day", "year", "month", "within", "branch")])
    day = F.col("day.v")
    top = top.select(
        "cell",
        day.alias("day"),
        F.coalesce(F.substring(day, 1, 4), F.col("year.v")).cast("int").alias("year"),
        F.coalesce(F.substring(day, 1, 7), F.col("month.v")).alias("month"),
        F.coalesce(F.substring(day, 6, 5), F.col("within.v")).alias("within"),
        F.col("branch.v").alias("branch"),
    )
    return rows.select("obs_id", "cell", "form", "core", "latin", "words").join(top, "cell", "left")


def printed(officers: DataFrame, variants: dict[str, str], branches: list[tuple]) -> DataFrame:
    """One row for each printed officer: officer_id, form, core, reading_form, kana, said, latin,
    cohort, days, birth (day), birth_year, birth_month, branch."""
    rows = officers.select("officer_id", "name", "reading", "cohort", "dates", "birth", "post").where("officer_id IS NOT NULL").dropDuplicates(["officer_id"])
    base = rows.select(
        "officer_id",
        name_fields("name", variants).alias("n"),
        reading_fields("reading", variants).alias("r"),
        romanised("name").alias("latin"),
        "name",
        "cohort",
        dates_of(F.col("birth")).alias("b"),
        branch_in_post("post", branches, variants).alias("branch"),
    )
    listed = rows.select("officer_id", F.explode("dates").alias("d")).select("officer_id", dates_of(F.col("d")).alias("d")).select("officer_id", "d.day", "d.year")
    dated = listed.groupBy("officer_id").agg(F.collect_set("day").alias("days"), F.collect_set("year").alias("years"))
    columns = ["officer_id", "name", "n.form", "n.core", F.col("r.form").alias("reading_form"), "r.kana", "r.said", "latin", "cohort", "days", "years"]
    return base.join(dated, "officer_id", "left").select(*columns, F.col("b.day").alias("birth"), F.col("b.year").alias("birth_year"), F.col("b.month").alias("birth_month"), "branch")

"""Column functions on readings: digits, marks, hashes, patterns, string likeness."""

from __future__ import annotations

import difflib
import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
#: Characters that count as text of a reading: kana, ideographs, ASCII letters and digits.
TEXT_CHARS = "\\x{3000}-\\x{9FFF}0-9A-Za-z"


def folded(column: Column | str, variants: dict[str, str]) -> Column:
    """Single-pass character map; built in, so it stays in generated code."""
    return F.translate(F.trim(column), "".join(variants), "".join(variants.values()))


def canonical(variants: dict[str, str]):
    """Column function: compatibility forms, trimmed, the variant table in a single pass; for
    comparison only, null gives ``''``."""
    table = str.maketrans(variants)

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        fold = functools.lru_cache(None)(lambda x: unicodedata.normalize("NFKC", x).strip().translate(table))
        return pd.Series([fold(x) if isinstance(x, str) else "" for x in values], dtype=object)

    return run


def sha256(column: Column | str) -> Column:
    """SHA-256 of a text's UTF-8 bytes, in hexadecimal."""
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def plain_number(column: Column) -> Column:
    """``struct<value bigint, reason string>``: a plain number xor a refusal."""
    text = F.trim(F.translate(column, WIDE_DIGITS, DIGITS))
    ok = text.rlike("^[0-9]{1,18}$")
    return F.struct(F.when(ok, text.try_cast("bigint")).alias("value"), F.when(~F.coalesce(ok, F.lit(False)), "not a plain number").alias("reason"))


def geta_count(column: Column | str) -> Column:
    """Number of unreadable marks; null counts as none."""
    return F.coalesce(F.regexp_count(column, F.lit("〓")), F.lit(0))


def strip_marks(column: Column | str) -> Column:
    """Text without what stands in ASCII brackets, unreadable and uncertain marks, and anything but
    text characters; full-width brackets fall, what is in them stays."""
    c = F.regexp_replace(column, "(?s)\\(.*?\\)|\\[.*?\\]", "")
    c = F.replace(F.replace(c, F.lit("〔?〕"), F.lit("")), F.lit("〓"), F.lit(""))
    return F.regexp_replace(c, f"[^{TEXT_CHARS}]", "")


def no_space(column: Column | str) -> Column:
    return F.regexp_replace(column, "(?U)\\s", "")


def sha1_mod_100(column: Column | str) -> Column:
    """The 160-bit SHA-1 of a text modulo 100, folded over five 32-bit parts (2^32 mod 100 = 96)."""
    digest = F.sha1(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))
    rest = F.lit(0).cast("bigint")
    for i in range(5):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        rest = (rest * 96 + part) % 100
    return rest


def era_in_title(column: Column | str) -> Column:
    """The era date inside a title, as written, or null."""
    found = F.regexp_extract(column, "((?:明治|大正|昭和)[元0-9０-９〇一二三四五六七八九十百]+年[0-9０-９〇一二三四五六七八九十]+月[0-9０-９〇一二三四五六七八九十]+日)", 1)
    return F.nullif(found, F.lit(""))


def label_date(column: Column | str) -> Column:
    """ISO date of a ``YYYY年MM月DD日`` label, or null."""
    text = F.regexp_replace(F.nullif(F.regexp_extract(column, "(\\d{4}年\\d{2}月\\d{2}日)", 1), F.lit("")), "[年月日]", "-")
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def contents_entry(column: Column | str) -> Column:
    """``struct<section, page, frame>`` of a ``section[/page] (NNNN.jp2)`` entry."""
    pattern = "^(.*?)(?:/(\\d+))? \\((\\d{4})\\.jp2\\)$"
    part = lambda i: F.nullif(F.regexp_extract(column, pattern, i), F.lit(""))
    return F.struct(part(1).alias("section"), part(2).try_cast("int").alias("page"), part(3).try_cast("int").alias("frame"))


#: What tells the fields of a roster column apart by their text.
ERA_START, NUMBER, POST_HINT, HONOUR_HINT, KATAKANA = "^[明大昭]", "^\\p{Nd}{1,4}$", "[長附官員部隊課級校]", "[从正勲功旭瑞]", "^[ァ-ヶー・]+$"


def box_field(text: Column, place: Column, width: Column, median_width: Column) -> Column:
    """The field that a box of a roster column belongs to, by an ordered decision on text, place (share
    of the table's height from above) and width; null for a blank one.

    ``seniority`` is a candidate: only the first of a column is its number.
    """
    t = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    n = F.translate(t, WIDE_DIGITS, DIGITS).try_cast("int")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
        .when(t.rlike(NUMBER), F.when((place > 0.8) & (n < 60), "cohort").when((place > 0.3) & (place < 0.55), "seniority").otherwise("other"))
        .when(t.rlike(ERA_START), F.when(place > 0.6, "birth").otherwise("date"))
        .when(t.rlike(KATAKANA) & (place > 0.55), "reading")
        .when(t.rlike(HONOUR_HINT) & (place > 0.55) & (place < 0.82) & (F.length(t) <= 8), "honours")
        .when(t.rlike(POST_HINT) & (place < 0.72), "post")
        .when((place > 0.6) & (width >= 1.35 * median_width) & ~t.startswith("同") & ~t.rlike("[、。\\p{Nd}]"), "name")
        .otherwise("other")
    )


def region_url(service: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Image region URL of the IIIF pattern."""
    return F.format_string("%s/%d,%d,%d,%d/full/0/default.jpg", service, x, y, w, h)


def _likeness(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        done: dict = {}
        out = []
        for key in zip(a, b):
            if key not in done:
                x, y = (v if isinstance(v, str) else "" for v in key)
                done[key] = function(x, y)
            out.append(done[key])
        return pd.Series(out, dtype="float64")

    return run


def _ratio(a: str, b: str) -> float:
    return 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def _coverage(line: str, page: str) -> float:
    if not line:
        return 0.0
    blocks = difflib.SequenceMatcher(None, line, page, autojunk=False).get_matching_blocks()
    return sum(m.size for m in blocks) / len(line)


def _page_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def folded_similarity(variants: dict[str, str]):
    """Gestalt ratio after both sides are folded (compatibility forms, trimmed, the variant table in a
    single pass): 0 if either is empty, 1 if they are equal.  The folded form is compared, never
    given back."""
    table = str.maketrans(variants)

    def fold(x: str) -> str:
        return unicodedata.normalize("NFKC", x).strip().translate(table)

    return _likeness(lambda a, b: _ratio(fold(a), fold(b)))


#: Ratio of two pages, every character counting.
page_likeness = _likeness(_page_ratio)
#: Gestalt ratio of reading and entry (argument order matters), 0 if either is empty.
similarity = _likeness(_ratio)
#: Share of a line's characters found, in order, on a page.
line_coverage = _likeness(_coverage)

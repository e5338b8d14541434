"""Consistent form of roster text.

``consistent_form`` makes equal what displays alike: compatibility characters (NFKC),
white space and invisible characters (dropped), look-alikes of another script (taken to the
script that dominates the token) and the equivalences of a variant table (followed over
several steps).  Two different ideographs stay different unless the table equates them.

Null gives null; empty, blank or wholly invisible text gives ``''``; any length is processed
whole.  The Arrow functions work on the distinct values of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkledger.session import small_rows

#: Characters without visible form or with none but width: format controls, variation
#: selectors, fillers, white space.
INVISIBLE = re.compile(
    "[\\s\\u0000-\\u001f\\u007f-\\u00a0\\u00ad\\u034f\\u061c\\u115f\\u1160\\u1680\\u17b4\\u17b5"
    "\\u180b-\\u180f\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\u3164\\ufe00-\\ufe0f"
    "\\ufeff\\uffa0\\ufff9-\\ufffb\\U000e0000-\\U000e0fff]"
)

#: Look-alikes between ideographs and kana.
HAN_KATAKANA = {"二": "ニ", "八": "ハ", "力": "カ", "口": "ロ", "工": "エ", "夕": "タ", "卜": "ト"}
#: Horizontal strokes that pass for the ideograph one or the long-vowel mark.
STROKES = "ー—―‐‑‒–─━－-"
#: Cyrillic and Greek letters that display as Latin ones.
LATIN_LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
}
#: Hiragana and katakana that display alike.
KANA_LOOKALIKE = {"へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ"}

_TO_HAN = {k: h for h, k in HAN_KATAKANA.items()} | dict.fromkeys(STROKES, "一")
_TO_KATAKANA = HAN_KATAKANA | {"一": "ー"} | dict.fromkeys("—―─━－", "ー") | KANA_LOOKALIKE
_TO_HIRAGANA = {k: h for h, k in KANA_LOOKALIKE.items()}
_TO_CYRILLIC = {v: k for k, v in LATIN_LOOKALIKE.items() if "Ѐ" <= k <= "ԯ"}
_TO_GREEK = {v: k for k, v in LATIN_LOOKALIKE.items() if "Ͱ" <= k <= "Ͽ"}
REPAIRS = {
    "han": str.maketrans(_TO_HAN),
    "katakana": str.maketrans(_TO_KATAKANA),
    "hiragana": str.maketrans(_TO_HIRAGANA),
    "latin": str.maketrans(LATIN_LOOKALIKE),
    "cyrillic": str.maketrans(_TO_CYRILLIC),
    "greek": str.maketrans(_TO_GREEK),
}

_SCRIPTS = (
    ("latin", "A", "Z"), ("latin", "a", "z"), ("latin", "À", "ɏ"), ("greek", "Ͱ", "Ͽ"), ("cyrillic", "Ѐ", "ԯ"),
    ("hiragana", "ぁ", "ゟ"), ("katakana", "ァ", "ヺ"), ("katakana", "ㇰ", "ㇿ"), ("han", "㐀", "䶿"),
    ("han", "一", "鿿"), ("han", "豈", "﫿"), ("han", "𠀀", "𳍿"),
)


def script_of(char: str) -> str | None:
    """Script of a letter; None for digits, punctuation, marks and strokes."""
    if char in "々〇":
        return "han"
    return next((name for name, lo, hi in _SCRIPTS if lo <= char <= hi), None)


def visible(text: str) -> str:
    """NFKC without invisible characters and white space."""
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)))


def script_counts(token: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for char in token:
        if name := script_of(char):
            counts[name] = counts.get(name, 0) + 1
    return counts


def dominant(counts: dict[str, int]) -> list[str]:
    """Scripts from the most to the least frequent; ties in order of name."""
    return sorted(counts, key=lambda name: (-counts[name], name))


def is_mixed(token: str, counts: dict[str, int]) -> bool:
    """More than one script, or a stroke that may stand for a letter of the only one."""
    return len(counts) > 1 or (bool(counts) and next(iter(counts)) in ("han", "katakana") and any(c in STROKES for c in token))


def taken_to(token: str, script: str) -> str:
    """Look-alikes taken to a script; marks that now find their letter are composed with it."""
    return unicodedata.normalize("NFC", token.translate(REPAIRS[script]))


def repairs(token: str) -> list[str]:
    """What a mixed token may stand for, best first; empty for a token of one script.

    A script in which the whole token comes out pure goes before one that leaves letters over,
    then the more frequent one: a Latin name half written in Cyrillic look-alikes is Latin, for
    the rest of its letters have no Cyrillic twin.
    """
    counts = script_counts(token)
    if not is_mixed(token, counts):
        return []
    taken = [taken_to(token, script) for script in dominant(counts)]
    return list(dict.fromkeys(sorted(taken, key=lambda t: len(script_counts(t)) > 1)))


def repair(token: str) -> str:
    """Look-alikes taken to the script that a mixed token is of."""
    return next(iter(repairs(token)), token)


def closed_variants(pairs: Iterable[tuple[str | None, str | None]]) -> dict[str, str]:
    """Variant table followed to its end.

    Entries are cleaned first (invisible characters, white space, compatibility forms);
    entries that are empty, longer than one character or map to themselves say nothing.
    Repeated rows are one.  In a ring the smallest character stands for all of it.
    """
    step: dict[str, str] = {}
    for variant, canonical in pairs:
        a, b = visible(variant or ""), visible(canonical or "")
        if len(a) == 1 and len(b) == 1 and a != b:
            step[a] = min(b, step.get(a, b))
    closed = {}
    for start in step:
        seen, at = [start], start
        while at in step:
            at = step[at]
            if at in seen:
                at = min(seen[seen.index(at) :])
                break
            seen.append(at)
        closed[start] = at
    return {a: b for a, b in closed.items() if a != b}


def variant_map(kanji_variant: DataFrame, bound: int = 20_000) -> dict[str, str]:
    """The closed variant table; ``bound`` limits the rows brought to the driver."""
    rows = small_rows(kanji_variant.select("variant_char", "canonical_char").distinct(), bound)
    return closed_variants(sorted((r[0] or "", r[1] or "") for r in rows))


def form_of(text: str, variants: dict[int, str]) -> str:
    """Consistent form of one text; ``variants`` is a translation table."""
    return repair(visible(text)).translate(variants)


def on_distinct(values: pd.Series, function) -> pd.Series:
    """``function`` applied once to each distinct value that is not null."""
    codes, unique = pd.factorize(values)
    if not len(unique):
        return pd.Series([None] * len(values), dtype=object)
    done = [function(x) for x in unique]
    return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def consistent_form(column: Column | str, variants: dict[str, str]) -> Column:
    """Arrow column with the consistent form of a text column."""
    table = str.maketrans(variants)

    @F.pandas_udf(StringType())
    def fold(values: pd.Series) -> pd.Series:
        return on_distinct(values, lambda x: form_of(x, table))

    return fold(column)

"""How written names sound: readings of characters learnt from printed names and their readings.

A printed officer has a name and, often, a reading of it, of the given name only or of both.  Which
part of a reading belongs to which character is not said; it is learnt by expectation and
maximisation over all ways to cut the reading, so that no list of readings is kept.  Names in Latin
letters can then be compared with written ones by sound.

Readings are folded (``people.kana_key``) and have their long vowels short, as Latin spellings do.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from inkledger.functions.text import REPAIRS, on_distinct, repair, visible
from inkledger.llm.people import _LATIN, _ROMAN, WILD, roman_kana, short_vowels

#: Names the model is fitted on at most, taken by hash; rounds; share below which a reading of a
#: character is forgotten, and from which an initial may stand for it.
SAMPLE, ROUNDS, RARE, LIKELY = 4000, 8, 0.02, 0.1
#: Signs of one character at most; characters of a family name.
LONGEST, FAMILY = 4, 2
#: Levels of likeness by sound: none; a word and the initial of the other; a word, the other nearly;
#: both words.
SILENT, INITIAL, HALF, BOTH = range(4)
_FIRST_LETTERS: dict[str, set[str]] = defaultdict(set)
for _latin, _kana in _ROMAN.items():
    _FIRST_LETTERS[_kana[0]].add(_latin[0])

Readings = dict[str, dict[str, float]]


def _cuts(name: str, say: str, table: Readings | None) -> dict[tuple[int, str], float]:
    """Expected number of uses of each (place, part of the reading), over all cuts."""
    n, m = len(name), len(say)
    chance = lambda i, part: 1.0 / len(part) if table is None else table.get(name[i], {}).get(part, 1e-6)
    forward = [[0.0] * (m + 1) for _ in range(n + 1)]
    backward = [[0.0] * (m + 1) for _ in range(n + 1)]
    for start in {0, FAMILY if n > FAMILY else 0}:
        forward[start][0] = 1.0
    backward[n][m] = 1.0
    parts = [(i, j, size, chance(i, say[j : j + size])) for i in range(n) for j in range(m) for size in range(1, min(LONGEST, m - j) + 1)]
    for i, j, size, p in parts:
        forward[i + 1][j + size] += forward[i][j] * p
    for i, j, size, p in reversed(parts):
        backward[i][j] += p * backward[i + 1][j + size]
    if not forward[n][m]:
        return {}
    used: dict[tuple[int, str], float] = defaultdict(float)
    for i, j, size, p in parts:
        if share := forward[i][j] * p * backward[i + 1][j + size] / forward[n][m]:
            used[i, say[j : j + size]] += share
    return used


def learn(people: DataFrame, sample: int = SAMPLE) -> Readings:
    """Readings of each character with their shares, from printed names (core, said); fitted on at
    most ``sample`` distinct ones, empty if there are none."""
    rows = people.where(F.col("core").isNotNull() & F.col("said").isNotNull() & ~F.col("core").contains(WILD) & F.length("core").between(2, 8) & F.length("said").between(2, 20))
    rows = rows.select("core", "said").distinct().orderBy(F.xxhash64("core", "said"), "core", "said").limit(sample).collect()
    table: Readings | None = None
    for _ in range(ROUNDS):
        seen: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for core, said in rows:
            for (i, part), share in _cuts(core, said, table).items():
                seen[core[i]][part] += share
        table = {c: {part: x / total for part, x in parts.items() if x / total >= RARE / 4} for c, parts in seen.items() if (total := sum(parts.values()))}
    return {c: {part: x for part, x in parts.items() if x >= RARE} for c, parts in (table or {}).items()}


def spoken(name: str, table: Readings) -> str | None:
    """The usual reading of a word, None if a character has none."""
    parts = [max(table[c].items(), key=lambda x: (x[1], x[0]))[0] if table.get(c) else None for c in name]
    return short_vowels("".join(parts)) if parts and None not in parts else None


def can_say(name: str, say: str, table: Readings) -> bool:
    """Whether a reading is made of known readings of the characters."""
    ends = {0}
    for c in name:
        known = table.get(c, {})
        ends = {j + len(part) for j in ends for part in known if say.startswith(part, j)}
    return len(say) in ends


def latin_words(text: str) -> list[str]:
    """The two words of a romanised name, folded; an initial is its letter; else none."""
    words = [repair(visible(w)) for w in re.split(r"[\s,]+", unicodedata.normalize("NFKC", text)) if visible(w)]
    if len(words) != 2:
        return []
    words = [w.translate(REPAIRS["latin"]) if len(w.strip(".")) == 1 else w for w in words]
    out = []
    for word in words:
        plain = word.strip(".")
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            out.append(plain.lower())
        elif _LATIN.search(plain) and (kana := roman_kana(plain)):
            out.append(short_vowels(kana))
    return out if len(out) == 2 and any(len(w) > 1 for w in out) else []


def sound_level(core: str, words: list[str], table: Readings) -> int:
    family, given = core[:FAMILY], core[FAMILY:]
    best = SILENT
    for pair in (words, words[::-1]):
        said = [can_say(name, word, table) if len(word) > 1 else None for name, word in zip((family, given), pair)]
        if said == [True, True]:
            return BOTH
        if True not in said:
            continue
        other = said.index(True) ^ 1
        usual = spoken((family, given)[other], table)
        if said[other] is None:
            first = {part[0] for part, share in table.get((family, given)[other][:1], {}).items() if share >= LIKELY}
            best = max(best, INITIAL if any(pair[other] in _FIRST_LETTERS[sign] for sign in first) else SILENT)
        elif usual and 2 * sum(min(usual.count(c), pair[other].count(c)) for c in set(usual)) >= 0.6 * (len(usual) + len(pair[other])):
            best = max(best, HALF)
    return best


def words_of(column: str) -> Column:
    """The words of a romanised name as an array, empty for any other."""
    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return on_distinct(values, lambda x: latin_words(x) if _LATIN.search(x) or not x.isascii() else [])

    return run(F.col(column))


def usual_words(core: Column, table: Readings) -> Column:
    """The usual readings of family and given name of a written name, as far as they are known."""

    @F.pandas_udf("array<string>")
    def run(cores: pd.Series) -> pd.Series:
        say = functools.lru_cache(None)(lambda name: [w for part in (name[:FAMILY], name[FAMILY:]) if (w := spoken(part, table))])
        return pd.Series([say(c) if isinstance(c, str) else [] for c in cores], dtype=object)

    return run(core)


def sounds_like(core: Column, words: Column, table: Readings) -> Column:
    """Level of a written name and the words of a romanised one; null if either is missing."""

    @F.pandas_udf(IntegerType())
    def run(cores: pd.Series, said: pd.Series) -> pd.Series:
        level = functools.lru_cache(None)(lambda c, w: sound_level(c, list(w), table))
        return pd.Series([level(c, tuple(w)) if isinstance(c, str) and w is not None and len(w) == 2 else None for c, w in zip(cores, said)], dtype="Int32")

    return run(core, words)

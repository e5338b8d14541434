"""Freely typed values mapped to a reference list, with a BK-tree.

The tree holds the codes, labels and variants of the entries under the unrestricted
Damerau-Levenshtein distance, a true metric, so the triangle inequality prunes soundly and every
entry within the threshold is returned.  The nearest entry wins if no other entry is as near.
What finds nothing may be an abbreviation: its words must be shortened forms of an entry's
words in order, and the entry that needs the fewest words left out wins if it is the only one.
Everything else is reported as ``unmatched``.

Up to ``small`` entries travel with the tasks and rows are mapped without a shuffle.  A longer list
is cut into shards by entry: every block of distinct values meets every shard, each with a tree of
its own, and what the shards find is merged by the same decision, so the result does not depend on
the cut.  Null and blank values give no row; ties between entries are unmatched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.text import closed_variants, consistent_form, repair, visible
from inkledger.session import cut_lineage, small_rows

UNMATCHED = "unmatched"
#: Numerals that mean the same.
_NUMERALS = {"壱": "一", "弐": "二", "参": "三", "1": "一", "2": "二", "3": "三", "iii": "三", "ii": "二", "i": "一"}
_ORDINALS = {"1st": "first", "2nd": "second", "3rd": "third"}
#: Words put around an entry that say nothing about which it is.
_BEFORE, _AFTER = ("調査団", "任"), ("殿", "員", "(正)", "部")
_AFTER_LATIN = ("branch", "dept", "department", "section")
_HAN = re.compile(r"[぀-ヿ㐀-鿿々〓]")


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (with transpositions of any blocks between)."""
    if a == b:
        return 0
    most = len(a) + len(b)
    last: dict[str, int] = {}
    table = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        row, above = table[i + 1], table[i]
        for j in range(1, len(b) + 1):
            k, before = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            else:
                cost = 1
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, table[k][before] + (i - k - 1) + 1 + (j - before - 1))
        last[a[i - 1]] = i
    return table[-1][-1]


class BKTree:
    """Entries by their distance from each other; ``within`` returns all within a threshold."""

    def __init__(self, words: Iterable[str] = ()):
        self.root: list | None = None
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = [word, {}]
            return
        node = self.root
        while (d := distance(word, node[0])) != 0:
            if d not in node[1]:
                node[1][d] = [word, {}]
                return
            node = node[1][d]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            text, children = open_.pop()
            d = distance(word, text)
            if d <= most:
                found.append((d, text))
            open_ += [child for at, child in children.items() if d - most <= at <= d + most]
        return sorted(found)


def threshold(word: str) -> int:
    """Edits allowed: one in four ideographs from four on, a quarter of other letters."""
    if _HAN.search(word):
        return 1 if len(word) >= 4 else 0
    return round(len(word) / 4) if len(word) >= 4 else 0


class Normal:
    """One spelling for both sides of the comparison."""

    def __init__(self, variants: dict[str, str]):
        self.table = str.maketrans(variants)

    def __call__(self, text: str) -> str:
        flat = re.sub(r"[​-‏⁠-⁯﻿­︀-️\U000e0100-\U000e01ef]", "", text)
        if _HAN.search(visible(flat)):
            han = repair(visible(flat).lower()).translate(self.table).strip("、。.,")
            han = re.sub(r"^(任|調査団)?(iii|ii|i)(?=等)", lambda m: (m[1] or "") + _NUMERALS[m[2]], han)
            return "".join(_NUMERALS.get(c, c) for c in han)
        words = re.sub(r"[\s_\-./,]+", " ", " ".join(repair(visible(w)) for w in flat.split()).lower()).strip()
        return " ".join(_ORDINALS.get(w, w) for w in words.split())

    def bare(self, normal: str) -> str:
        """Without the words put around an entry."""
        if _HAN.search(normal):
            for word in _BEFORE:
                if normal.startswith(word) and len(normal) > len(word):
                    normal = normal[len(word) :]
            for word in _AFTER:
                if normal.endswith(word) and len(normal) > len(word):
                    normal = normal[: -len(word)]
            return normal
        words = normal.split()
        while len(words) > 1 and words[-1] in _AFTER_LATIN:
            words.pop()
        return " ".join(words)


def aliases(entries: Iterable[tuple], normal: Normal) -> dict[str, set[str]]:
    """Codes by the normal form of every spelling; entries are (code, label_ja, label_en, variants)."""
    entries = [e for e in entries if e[0]]
    out: dict[str, set[str]] = {}

    def put(text: str | None, code: str) -> None:
        if text and (form := normal(text)):
            out.setdefault(form, set()).add(code)

    labels = [e[1] for e in entries if e[1]]
    ending = labels[0][-1] if len(labels) > 1 and len({x[-1] for x in labels}) == 1 else ""
    for code, label_ja, label_en, variants in entries:
        for text in (code, label_ja, label_en, *(variants or "").split(";")):
            put(text, code)
        if ending and label_ja and len(label_ja) > 2:
            put(label_ja[: -len(ending)], code)
    return out


def _shortened(short: str, word: str) -> bool:
    if word.startswith(short):
        return True
    rest = iter(word)
    return len(short) > 1 and short[0] == word[0] and short[-1] in word[1:] and all(c in rest for c in short)


def _left_out(words: list[str], entry: list[str]) -> int | None:
    """Words of the entry that are left out if the words shorten the rest, in order; else None."""
    at = 0
    for word in words:
        while at < len(entry) and not _shortened(word, entry[at]):
            at += 1
        if at == len(entry):
            return None
        at += 1
    return len(entry) - len(words)


class Matcher:
    """Maps one normalised value to (code, distance, how)."""

    def __init__(self, spellings: dict[str, set[str]], normal: Normal, labels: Iterable[str | None] = ()):
        """``labels`` are the spellings that initials may stand for."""
        self.spellings, self.normal = spellings, normal
        self.labels = {normal(x) for x in labels if x}
        self.tree = BKTree(sorted(spellings))
        self.known: dict[str, tuple] = {}

    def near(self, form: str) -> dict[str, int]:
        """Smallest distance of every code within the threshold."""
        found: dict[str, int] = {}
        for d, text in self.tree.within(form, threshold(form)):
            for code in self.spellings[text]:
                found[code] = min(d, found.get(code, d))
        return found

    def short(self, form: str) -> dict[str, int]:
        """Words or characters left out, by code, if the value is an abbreviation."""
        found: dict[str, int] = {}
        han = bool(_HAN.search(form))
        words = list(form) if han else form.split()
        for text, codes in self.spellings.items():
            if bool(_HAN.search(text)) != han:
                continue
            if han:
                rest = iter(text)
                fits = text[0] == form[0] and len(form) < len(text) and all(c in rest for c in form)
                gap = len(text) - len(form) if fits else None
            else:
                entry = text.split()
                gap = _left_out(words, entry)
                if gap is None and text in self.labels and len(words) == 1 and len(entry) > 1 and form == "".join(w[0] for w in entry):
                    gap = 0
            if gap is not None:
                for code in codes:
                    found[code] = min(gap, found.get(code, gap))
        return found

    def __call__(self, raw: str) -> tuple[str, int | None, str]:
        form = self.normal(raw)
        if form not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[form] = self._decide(form)
        return self.known[form]

    def evidence(self, raw: str) -> list[tuple[int, int, str]]:
        """(stage, distance, code) of all that speaks for an entry of this list: its spelling (three
        readings of the value, in order), the nearest ones, the shortest abbreviations."""
        form = self.normal(raw)
        bare = self.normal.bare(form)
        texts = (form, bare, bare.removesuffix("科"))
        out = [(stage, 0, code) for stage, text in enumerate(texts) for code in self.spellings.get(text, ())]
        if not out and "〓" not in bare and bare:
            for stage, found in ((3, self.near(bare)), (4, self.short(bare))):
                out += [(stage, d, code) for code, d in found.items() if d == min(found.values())]
        return out

    def _decide(self, form: str) -> tuple[str, int | None, str]:
        bare = self.normal.bare(form)
        for text, how in ((form, "spelling"), (bare, "spelling"), (bare.removesuffix("科"), "spelling")):
            if codes := self.spellings.get(text):
                return (next(iter(codes)), 0, how) if len(codes) == 1 else (UNMATCHED, None, "tie")
        if "〓" in bare or not bare:
            return UNMATCHED, None, "unreadable"
        for how, found in (("near", self.near(bare)), ("short", self.short(bare))):
            if found:
                least = min(found.values())
                codes = [code for code, d in found.items() if d == least]
                if len(codes) == 1:
                    return codes[0], least, how
                if how == "short":
                    return UNMATCHED, None, "tie"
        return UNMATCHED, None, "none"


def map_values(df: DataFrame, column: str, entries: list[tuple], variants: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` plus raw, mapped_code, distance, how; one row per value that is not blank."""
    from pyspark.sql.types import StructType

    schema = StructType(df.select(*keep, F.col(column).alias("raw")).schema.fields).add("mapped_code", "string").add("distance", "integer").add("how", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = Normal(variants)
        matcher = Matcher(aliases(entries, normal), normal, [e[2] for e in entries])
        for batch in batches:
            batch = batch[batch["raw"].map(lambda x: bool(visible(x)))].copy()
            codes, unique = pd.factorize(batch["raw"])
            found = [matcher(x) for x in unique]
            for k, name in enumerate(("mapped_code", "distance", "how")):
                batch[name] = pd.Series([found[c][k] for c in codes], index=batch.index, dtype="Int32" if name == "distance" else object)
            yield batch

    return df.select(*keep, F.col(column).alias("raw")).where("raw IS NOT NULL").mapInPandas(run, schema)


def map_sharded(values: DataFrame, vocab: DataFrame, variants: dict[str, str], shard_size: int = 2000, block_size: int = 20_000) -> DataFrame:
    """``(raw, mapped_code)`` of distinct values against a list of any length: ``vocab`` has code, label_ja,
    label_en, variants.  Shards and blocks are tasks of bounded size; only what is found is shuffled."""
    values = values.select("raw").where("raw IS NOT NULL").distinct()
    entries = vocab.select("code", "label_ja", "label_en", "variants").where("code IS NOT NULL").distinct()
    shards, blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((entries, shard_size), (values, block_size)))
    left = values.select("raw", F.pmod(F.xxhash64("raw"), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    right = entries.select("code", "label_ja", "label_en", "variants", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"))

    def search(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        listed = [tuple(x if isinstance(x, str) else None for x in row) for row in shard[["code", "label_ja", "label_en", "variants"]].itertuples(index=False)]
        normal = Normal(variants)
        matcher = Matcher(aliases(listed, normal), normal, [e[2] for e in listed])
        rows = [(raw, *found) for raw in block["raw"] if visible(raw) for found in matcher.evidence(raw)]
        return pd.DataFrame(rows, columns=["raw", "stage", "distance", "code"])

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, "raw string, stage int, distance int, code string")
    found = cut_lineage(found)
    least = found.groupBy("raw", "stage").agg(F.min("distance").alias("distance"))
    best = found.join(least, ["raw", "stage", "distance"]).groupBy("raw", "stage").agg(F.min("code").alias("code"), F.count_distinct("code").alias("n"))
    spelt, at = F.min(F.when(F.col("stage") < 3, F.struct("stage", "code", "n"))), lambda stage: F.max(F.when(F.col("stage") == stage, F.struct("code", "n")))
    merged = best.groupBy("raw").agg(spelt.alias("s"), at(3).alias("near"), at(4).alias("short"))
    only = lambda c: F.when(F.col(f"{c}.n") == 1, F.col(f"{c}.code"))
    code = F.when(F.col("s").isNotNull(), only("s")).otherwise(F.coalesce(only("near"), only("short")))
    mapped = values.join(merged, "raw", "left").select("raw", F.coalesce(code, F.lit(UNMATCHED)).alias("mapped_code"))
    return mapped.where(consistent_form("raw", {}) != "")


def map_free_values(observation_in: DataFrame, rank_vocab: DataFrame, branch_vocab: DataFrame, kanji_variant: DataFrame, small: int = 5000) -> DataFrame:
    """``(obs_id, field_name, mapped_code)`` of the ranks and branches of all readings."""
    variants = closed_variants(sorted((r[0] or "", r[1] or "") for r in small_rows(kanji_variant.select("variant_char", "canonical_char").distinct(), 20_000)))
    out = None
    for field, vocab in (("rank_code", rank_vocab), ("branch_code", branch_vocab)):
        listed = vocab.select(F.col(field).alias("code"), "label_ja", "label_en", "variants")
        if listed.count() > small:
            rows = observation_in.select("obs_id", F.col(field).alias("raw")).where("raw IS NOT NULL")
            rows = rows.join(map_sharded(rows, listed, variants), "raw")
        else:
            rows = map_values(observation_in, field, [tuple(r) for r in small_rows(listed, small)], variants, ["obs_id"])
        part = rows.select("obs_id", F.lit(field).alias("field_name"), "mapped_code")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def nearest_in_shards(values: DataFrame, entries: DataFrame, shard_size: int = 2000, block_size: int = 20_000) -> DataFrame:
    """``(value, code, distance)`` of the one nearest entry of a list of any length.

    ``values`` has a column value, ``entries`` spelling and code.  Both are cut by hash: every
    block of distinct values meets every shard of the list once, in a task of bounded size; the
    shards' winners are merged by an aggregation.  Values with no entry, or two codes, within
    the threshold at the least distance have a null code.
    """
    values = values.select("value").where("value IS NOT NULL AND value <> ''").distinct()
    entries = entries.select("spelling", "code").where("spelling IS NOT NULL AND code IS NOT NULL").distinct()
    shards = max(1, math.ceil(entries.count() / shard_size))
    blocks = max(1, math.ceil(values.count() / block_size))
    left = values.select("value", F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    right = entries.select("spelling", "code", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64("spelling"), F.lit(shards)).alias("shard"))

    def search(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        codes = shard.groupby("spelling")["code"].agg(set).to_dict()
        tree, out = BKTree(sorted(codes)), []
        for value in block["value"]:
            found = tree.within(value, threshold(value))
            least = found[0][0] if found else None
            out += [(value, code, d) for d, text in found if d == least for code in codes[text]]
        return pd.DataFrame(out, columns=["value", "code", "distance"])

    winners = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, "value string, code string, distance int")
    least = winners.groupBy("value").agg(F.min("distance").alias("distance"))
    codes = winners.join(least, ["value", "distance"]).groupBy("value", "distance").agg(F.collect_set("code").alias("codes"))
    return values.join(codes, "value", "left").select("value", F.when(F.size("codes") == 1, F.col("codes")[0]).alias("code"), F.when(F.size("codes") == 1, F.col("distance")).alias("distance"))

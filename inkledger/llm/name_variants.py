"""Variant spellings of one officer's name, found by suffix blocking.

Names are indexed by their suffixes (and those of their reversal) above a least length.  Suffixes
that are too common are discarded only after refining: the names that share one are compared where
they agree in a second field or a third (the year or the branch of a reading, the cohort or the year
of birth of a printed officer), and where that is still common, in both.  A row without the field
is compared with all rows of the suffix.  Names that agree in neither are compared where they share
one more character, without which they are not alike.  Pairs of a block are compared by the ratio of their
longest common subsequence, in either order of family and given name; how much a ratio says beside
dates, branches, births and cohorts is learnt from all pairs (``evidence``), so nothing is fitted to
one size.  What is accepted is closed over chains.

The readers of one roster cell read one officer; their names are compared too, with this as a
further piece of evidence.  Names in Latin letters are compared by their sound (``sounds``).  Equal
profiles (name, day, branch) are one vertex, so copies are never compared with each other.  Null and
blank names have no pairs; a row delivered twice counts once; rows without a cell key stand for
themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.text import variant_map
from inkledger.llm import people as P
from inkledger.llm import sounds
from inkledger.llm.evidence import counted, log_odds, random_pairs, table_of, with_value
from inkledger.llm.graph import components, edge_tokens, met_pairs, spare_characters
from inkledger.llm.people import by_cell, kana_likeness, may_be_like, may_sound_like, name_likeness, printed, readings, sketch
from inkledger.llm.sounds import Readings, learn, sounds_like, usual_words, words_of
from inkledger.session import cut_lineage, phase, small_rows

#: Rows above which a suffix is common.
COMMON = 60
#: Log-odds from which a pair is accepted: two to one.
ACCEPT = float(np.log(2.0))
#: What two readings of one cell have in their favour, in log-odds.
ONE_CELL = 12.0

#: First level of likeness by sound, after those of written names.
SOUND = P.NO_NAME + 1
#: Levels of agreement of two days: nothing to compare; equal; two parts of three equal, or a day
#: apart; month with year or day equal, the rest unknown; only the year known on a side, and equal;
#: other days of one year; other years, or months and days of unknown year that differ.
UNKNOWN, SAME, CLOSE, PARTLY, IN_YEAR, OTHER_DAY, APART = range(7)
#: Expected of pairs of one officer: days; branches (one unknown, equal, different); days of birth;
#: cohorts (unknown, equal, ten apart, one apart, different).  Worth twenty pairs beside the data.
USUAL_DAYS = np.array([0.15, 0.69, 0.04, 0.05, 0.02, 0.02, 0.03])
USUAL_BRANCHES = np.array([0.12, 0.86, 0.02])
USUAL_BIRTHS = np.array([0.18, 0.5, 0.02, 0.15, 0.1, 0.02, 0.03])
USUAL_COHORTS = np.array([0.12, 0.83, 0.02, 0.02, 0.01])


def branch_entries(branch_vocab: DataFrame, bound: int = 5000) -> list[tuple]:
    return [tuple(r) for r in small_rows(branch_vocab.select("branch_code", "label_ja", "label_en", "variants"), bound)]


def near_day(a: Column, b: Column) -> Column:
    """Two of year, month and day are equal."""
    same = [(F.substring(a, i, n) == F.substring(b, i, n)).cast("int") for i, n in ((1, 4), (6, 2), (9, 2))]
    return same[0] + same[1] + same[2] == 2


def day_level(a: str, b: str) -> Column:
    """Agreement of two days given as structs (day, year, month, within), by their names."""
    f = lambda field: (F.col(f"{a}.{field}"), F.col(f"{b}.{field}"))
    (day_a, day_b), (year_a, year_b), (month_a, month_b), (within_a, within_b) = map(f, ("day", "year", "month", "within"))
    next_day = F.abs(F.date_diff(day_a.try_cast("date"), day_b.try_cast("date"))) == 1
    return (
        F.when(day_a == day_b, SAME)
        .when(near_day(day_a, day_b) | next_day, CLOSE)
        .when(day_a.isNotNull() & day_b.isNotNull(), F.when(year_a == year_b, OTHER_DAY).otherwise(APART))
        .when((within_a == within_b) | (month_a == month_b), PARTLY)
        .when((year_a == year_b) & ((month_a != month_b) | (within_a != within_b)), OTHER_DAY)
        .when(year_a == year_b, IN_YEAR)
        .when((year_a != year_b) | (within_a != within_b), APART)
        .otherwise(UNKNOWN)
    )


def code_level(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).when(a != b, 2).otherwise(0)


def cohort_level(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).when(F.abs(a - b) == 10, 2).when(F.abs(a - b) == 1, 3).when(a != b, 4).otherwise(0)


def known(value: Column) -> Column:
    """A value as the array of the values a row may have: one or none."""
    return F.array_compact(F.array(value))


def with_odds(pairs: DataFrame, levels: int, chance: np.ndarray, anchors: tuple[int, ...], usual: tuple, complete: np.ndarray) -> DataFrame:
    """Pairs with ``score``, the log-odds of one person that names (``n``) and two fields (``f1``, ``f2``)
    give together."""
    pairs = cut_lineage(pairs)
    free = pairs.where("cell = 0") if "cell" in pairs.columns else pairs
    table = table_of(counted(free, F.col("n"), F.col("f1"), F.col("f2")), levels, len(usual[0]), len(usual[1]))
    odds = log_odds(table, chance, anchors, usual, complete)
    return with_value(pairs, "score", odds, "n", "f1", "f2")


def chance_of(rows: DataFrame, first: Column, second: Column, *sizes: int) -> np.ndarray:
    """Counts of the levels of two fields in random pairs of ``rows`` (id and a struct ``v``)."""
    pairs = random_pairs(rows, ["v"]).select(F.col("v_a").alias("va"), F.col("v_b").alias("vb"))
    return table_of(counted(pairs, first, second), *sizes)


def profiles_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``profile``, the id of their (core, day, branch); without a day the cell
    takes part, so that namesakes of unknown date stay apart."""
    name = F.coalesce("core", F.concat(F.lit("="), "form"))
    key = F.xxhash64(name, F.coalesce("day", F.concat(F.lit("c"), "cell")), F.coalesce("branch", F.lit("")))
    return rows.withColumn("profile", F.when(F.col("form") != "", key))


def with_spread(rows: DataFrame, year: str) -> DataFrame:
    """``rows`` with the span of years among those of the same name: over one where there are
    namesakes, 0 where no year is known."""
    spans = rows.groupBy(F.col("core").alias("_core")).agg(F.coalesce(F.max(year) - F.min(year), F.lit(0)).alias("spread"))
    return rows.join(spans, F.col("core") == F.col("_core"), "left").drop("_core")


def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with what ``rows`` (id and a struct ``v``) have of either: ``va`` and ``vb``."""
    side = lambda s: rows.select(F.col("id").alias(s), F.col("v").alias(f"v{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


@phase
def linked_profiles(profiles: DataFrame, cells: DataFrame, heard: Readings, most: int = COMMON) -> DataFrame:
    """Accepted ``(a, b, score)`` between distinct profiles (id, core, words, day, year, month,
    within, branch); ``cells`` are the pairs of profiles read in one cell, ``heard`` the readings of
    characters by which names in Latin letters are compared.

    A name alone, without date or branch, links only where nobody of that name is of another
    year: it must not bridge namesakes.
    """
    fields = ("core", "words", "day", "year", "month", "within", "branch", "spread")
    held = cut_lineage(with_spread(profiles, "year").select("id", *fields, usual_words(F.col("core"), heard).alias("usual")))
    named = held.select("id", F.struct(*fields).alias("v"))
    keys = [known(F.col("year").cast("string")).alias("y"), known(F.col("branch")).alias("b")]
    tokens = held.where(F.length("core") >= 2).select("id", sketch(F.col("core")).alias("v"), "core", F.explode(edge_tokens(F.col("core"))).alias("token"), *keys)
    tokens = tokens.withColumn("rest", spare_characters(F.col("core"), F.col("token"))).drop("core")
    met = met_pairs(tokens, most, "y", "b", lambda a, b: may_be_like(a, b, 0.66), "rest")
    # Romanised names meet written ones by the sound of either word.
    whole = F.filter("words", lambda w: F.length(w) > 1)
    worded = F.coalesce(F.size("words") > 0, F.lit(False)).alias("v")
    latin = held.where(F.size("words") > 0).select("id", worded, F.explode(whole).alias("token"), *keys)
    spelt = latin.select("token").distinct()
    written = held.select("id", worded, F.explode("usual").alias("token"), *keys).join(spelt, "token", "left_semi")
    none = F.array().cast("array<string>")
    both = latin.unionByName(written.select(*latin.columns)).withColumn("rest", F.when(F.col("v"), none))
    sounded = met_pairs(both, most, "y", "b", lambda a, b: a != b, "rest")
    met = met.unionByName(sounded).withColumn("cell", F.lit(0))
    pairs = met.unionByName(cells.select("a", "b", F.lit(1).alias("cell"))).groupBy("a", "b").agg(F.max("cell").alias("cell"))
    days, branches = day_level("va", "vb"), code_level(F.col("va.branch"), F.col("vb.branch"))
    chance = chance_of(named, days, branches, 7, 3)
    complete = np.zeros((SOUND + sounds.BOTH + 1, 7, 3))
    complete[:, [SAME, IN_YEAR, OTHER_DAY], :] = complete[:, :, 1] = 1
    complete[P.EQUAL, SAME, 1] = 0  # one profile, no pair
    heard_as = F.coalesce(sounds_like(F.col("va.core"), F.col("vb.words"), heard), sounds_like(F.col("vb.core"), F.col("va.words"), heard))
    level = F.coalesce(SOUND + heard_as, name_likeness(F.col("va.core"), F.col("vb.core")))
    namesakes = (F.col("va.spread") > 1) | (F.col("vb.spread") > 1)
    pairs = beside(pairs, named).select("a", "b", "cell", level.alias("n"), days.alias("f1"), branches.alias("f2"), namesakes.alias("namesakes"))
    scored = with_odds(pairs, len(complete), chance, (P.WITHIN, P.MOVED), (USUAL_DAYS, USUAL_BRANCHES), complete)
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("cell") == 1, ONE_CELL).otherwise(0.0))
    bridge = (F.col("cell") == 0) & (F.col("f2") != 1) & F.col("f1").isin(UNKNOWN, APART) & F.col("namesakes")
    unlike = (F.col("cell") == 0) & F.col("n").isin(P.UNLIKE, P.DISTANT, P.NO_NAME, SOUND + sounds.SILENT)
    return scored.where((F.col("score") >= ACCEPT) & ~bridge & ~unlike).select("a", "b", "score", "n", "f1", "f2", "cell")


@phase
def linked_officers(rows: DataFrame, most: int = COMMON) -> DataFrame:
    """Accepted ``(a, b, score)`` between printed officers."""
    birth = F.struct(F.col("birth").alias("day"), F.col("birth_year").alias("year"), F.col("birth_month").alias("month"), F.substring("birth", 6, 5).alias("within"))
    # A romanised name is heard in either order; a printed reading stands for both.
    says = F.coalesce("kana", F.when(F.size("latin") > 0, F.array_join("latin", "|")))
    held = rows.select(F.col("officer_id").alias("id"), F.struct("core", says.alias("says"), "cohort", birth.alias("birth"), "branch").alias("v"))
    held = cut_lineage(held.where("v.core IS NOT NULL OR v.says IS NOT NULL"))
    none = F.array().cast("array<string>")
    names = F.when(F.length("v.core") >= 2, edge_tokens(F.col("v.core")))
    # A reading may be that of the given name only, or lack its last sign.
    heard = F.flatten(F.transform(F.split("v.says", "[|]"), lambda say: F.array(say, F.substr(say, F.lit(1), F.length(say) - 1))))
    sounds = F.transform(F.flatten(F.transform(heard, lambda say: edge_tokens(say, frame=False))), lambda t: F.concat(F.lit("k:"), t))
    # Two written names meet by their own tokens; sound is for those without one.
    entry = lambda side: lambda t: F.struct(t.alias("t"), side.alias("s"))
    by_sound = F.when(F.col("v.core").isNull(), F.lit("b")).otherwise(F.lit("r"))
    every = F.concat(F.transform(F.coalesce(names, none), entry(F.lit("b"))), F.transform(F.array_distinct(F.coalesce(sounds, none)), entry(by_sound)))
    bounds = F.struct(sketch(F.col("v.core")).alias("core"), sketch(F.col("v.says")).alias("says"))
    tokens = held.select("id", bounds.alias("bounds"), F.col("v.core").alias("core"), F.explode(every).alias("t"), known(F.col("v.cohort").cast("string")).alias("c"), known(F.col("v.birth.year").cast("string")).alias("y"))
    tokens = tokens.select("id", F.col("bounds").alias("v"), F.col("t.t").alias("token"), F.col("t.s").alias("side"), "c", "y", F.when(~F.col("t.t").startswith("k:"), spare_characters(F.col("core"), F.col("t.t"))).alias("rest"))

    def may(a: Column, b: Column) -> Column:
        sound = F.coalesce(may_sound_like(a["says"], b["says"]), F.lit(False))
        return F.when(a["core"].isNotNull() & b["core"].isNotNull(), may_be_like(a["core"], b["core"], 0.66) | (may_be_like(a["core"], b["core"]) & sound)).otherwise(sound)

    pairs = beside(met_pairs(tokens, most, "c", "y", may, "rest"), held)
    births, cohorts = day_level("va.birth", "vb.birth"), cohort_level(F.col("va.cohort"), F.col("vb.cohort"))
    chance = chance_of(held, births, cohorts, 7, 5)
    level = name_likeness(F.col("va.core"), F.col("vb.core")) * 6 + kana_likeness(F.col("va.says"), F.col("vb.says"))
    complete = np.zeros((54, 7, 5))
    complete[:, [SAME, IN_YEAR, OTHER_DAY], :] = complete[:, :, 1] = 1
    anchors = tuple(n * 6 + k for n in (P.EQUAL, P.MOVED, P.WITHIN) for k in (P.KANA_NONE, P.KANA_NEAR, P.KANA_WITHIN, P.KANA_EQUAL))
    pairs = pairs.select("a", "b", level.alias("n"), births.alias("f1"), cohorts.alias("f2"))
    scored = with_odds(pairs, 54, chance, anchors, (USUAL_BIRTHS, USUAL_COHORTS), complete)
    # Names under two thirds alike, or missing, need a reading that says more.
    k, n = F.col("n") % 6, F.floor(F.col("n") / 6)
    unlike = ((n < P.NEAR) & (k < P.KANA_WITHIN)) | ((n == P.NO_NAME) & (k < P.KANA_NEAR))
    return scored.where((F.col("score") >= ACCEPT) & ~unlike).select("a", "b", "score", "n", "f1", "f2")


def printed_rows(officers: DataFrame, branch_vocab: DataFrame, kanji_variant: DataFrame) -> DataFrame:
    """Checkpointed printed officers, with the words of romanised names."""
    people = printed(officers, variant_map(kanji_variant), branch_entries(branch_vocab))
    return cut_lineage(people.withColumn("words", words_of("name")).drop("name"))


def cell_clusters(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``(obs_id, root)``: readings of linked profiles share a root; a reading without a profile is its own."""
    vertex = rows.select("obs_id", F.coalesce("profile", F.xxhash64(F.lit("row"), "obs_id")).alias("id"))
    return vertex.join(components(links.select("a", "b")), "id", "left").select("obs_id", F.coalesce("root", "id").alias("root"))


def reading_rows(observation_in: DataFrame, branch_vocab: DataFrame, kanji_variant: DataFrame) -> DataFrame:
    """Checkpointed readings with their profile."""
    variants = variant_map(kanji_variant)
    rows = readings(observation_in, variants, branch_entries(branch_vocab))
    rows = cut_lineage(rows.withColumn("words", words_of("name_raw")).drop("name_raw"))
    return cut_lineage(profiles_of(by_cell(rows)), over=rows)


def distinct_profiles(rows: DataFrame) -> DataFrame:
    fields = [F.min(c).alias(c) for c in ("core", "words", "day", "year", "month", "within", "branch")]
    return rows.where("profile IS NOT NULL").groupBy(F.col("profile").alias("id")).agg(*fields)


def cell_pairs(rows: DataFrame) -> DataFrame:
    """Each profile of a cell with the smallest one of it: ``(a, b)``, smaller id first."""
    held = rows.where("profile IS NOT NULL").select("cell", F.col("profile").alias("p")).distinct()
    low = held.groupBy("cell").agg(F.min("p").alias("a"))
    return held.join(low, "cell").where("p <> a").select("a", F.col("p").alias("b")).distinct()


@phase
def forms_by_person(observation_in: DataFrame, officers: DataFrame, branch_vocab: DataFrame, kanji_variant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings (obs_id, form, root) and printed officers (officer_id, form, said, root); rows of one
    person share a root."""
    people = printed_rows(officers, branch_vocab, kanji_variant)
    rows = reading_rows(observation_in, branch_vocab, kanji_variant)
    roots = cell_clusters(rows, linked_profiles(distinct_profiles(rows), cell_pairs(rows), learn(people)))
    entered = rows.where("form <> ''").select("obs_id", "form").join(roots, "obs_id")
    roots = components(linked_officers(people).select("a", "b")).select(F.col("id").alias("officer_id"), "root")
    roots = roots.unionByName(roots.select(F.col("root").alias("officer_id"), "root").distinct())
    binned = people.select("officer_id", F.nullif("form", F.lit("")).alias("form"), F.nullif("reading_form", F.lit("")).alias("said")).join(roots, "officer_id")
    return entered, binned


def variant_pairs(observation_in: DataFrame, officers: DataFrame, branch_vocab: DataFrame, kanji_variant: DataFrame) -> DataFrame:
    """``(source_table, id_a, id_b)``, smaller id first: one officer, different names."""
    named, said = forms_by_person(observation_in, officers, branch_vocab, kanji_variant)
    a, b = (named.select(F.col("obs_id").alias(f"id_{s}"), F.col("form").alias(f"form_{s}"), "root") for s in "ab")
    entered = a.join(b, "root").where("id_a < id_b AND form_a <> form_b").select(F.lit("observation_in").alias("source_table"), "id_a", "id_b")
    a, b = (said.select(F.col("officer_id").alias(f"id_{s}"), F.col("form").alias(f"form_{s}"), F.col("said").alias(f"said_{s}"), "root") for s in "ab")
    apart = F.coalesce(F.col("form_a") != F.col("form_b"), F.lit(False)) | F.coalesce(F.col("said_a") != F.col("said_b"), F.lit(False))
    binned = a.join(b, "root").where((F.col("id_a") < F.col("id_b")) & apart).select(F.lit("officers").alias("source_table"), "id_a", "id_b")
    return entered.unionByName(binned)

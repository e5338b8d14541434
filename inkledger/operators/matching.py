"""Lexicon matching with margins, agreement of engines, coverage buckets, the hash split."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions.readings import DIGITS, WIDE_DIGITS, box_field, page_likeness, sha1_mod_100, strip_marks

PROBABLE, MARGIN, AMBIGUOUS = 0.90, 0.15, 0.60


def margin_status(best: Column, runner_up: Column) -> Column:
    """PROBABLE, AMBIGUOUS or NO_MATCH; decided on the unrounded margin, no runner-up counts 0."""
    margin = best - F.coalesce(runner_up, F.lit(0.0))
    return F.when((best >= PROBABLE) & (margin >= MARGIN), "PROBABLE").when(best >= AMBIGUOUS, "AMBIGUOUS").otherwise("NO_MATCH")


def lexicon_matches(readings: DataFrame, lexicon: DataFrame, score: Callable[[Column, Column], Column], least_bound: float = 0.0, shard_size: int = 2000, block_size: int = 500) -> DataFrame:
    """Scores of readings against every entry; only pairs whose bound on the ratio is under
    ``least_bound`` are left out.

    ``readings`` has reading, ``lexicon`` entry and ordinal.  Blank readings are not scored.  An
    entry without a common character pair may still be the best or the runner-up, so there is no
    blocking: both sides are cut by hash and every block of distinct readings meets every shard of
    the lexicon once, by a join on keys.
    """
    left = readings.select("reading").where(F.col("reading").rlike("(?U)\\S")).distinct()
    right = lexicon.select("entry", "ordinal").where("entry <> ''")
    shards, blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((right, shard_size), (left, block_size)))
    left = left.select("reading", F.pmod(F.xxhash64("reading"), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    right = right.select("entry", "ordinal", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64("entry"), F.lit(shards)).alias("shard"))
    la, lb = F.length("reading"), F.length("entry")
    both = left.join(right, ["block", "shard"]).where(2 * F.least(la, lb) / (la + lb) >= least_bound).select("reading", "entry", "ordinal")
    return both.withColumn("score", score(F.col("reading"), F.col("entry")))


def suggestions(matches: DataFrame, readings: DataFrame) -> DataFrame:
    """Best entry, runner-up, margin (rounded for show) and status of every distinct reading.

    A reading to which every entry scores 0 has no best.
    """
    ranked = matches.withColumn("place", F.row_number().over(Window.partitionBy("reading").orderBy(F.desc("score"), "ordinal"))).where("place <= 5")
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    top = ranked.groupBy("reading").agg(at(1, "entry").alias("best"), at(1, "score").alias("best_score"), at(2, "score").alias("runner_up")).where("best_score > 0")
    every = readings.select("reading").where("reading IS NOT NULL").distinct().join(top, "reading", "left")
    status = F.when(F.col("best_score").isNull(), "NO_MATCH").otherwise(margin_status(F.col("best_score"), F.col("runner_up")))
    return every.select("reading", "best", F.round("best_score", 4).alias("best_score"), F.round(F.col("best_score") - F.coalesce("runner_up", F.lit(0.0)), 4).alias("margin"), status.alias("status"))


def agreement(candidates: DataFrame, keys: list[str], human: str, value: str, fold: Callable[[Column], Column]) -> DataFrame:
    """Status per key: no_human_value before anything, then agree, variant_equal, disagree."""
    h, v = F.trim(F.coalesce(human, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    judged = candidates.select(*keys, (h == "").alias("none"), (v != "").alias("given"), ((v == h) & (v != "")).alias("same"), ((fold(v) == fold(h)) & (v != "")).alias("like"))
    seen = judged.groupBy(*keys).agg(F.bool_or("none").alias("none"), F.bool_or("given").alias("given"), F.bool_or("same").alias("same"), F.bool_or("like").alias("like"))
    status = F.when(F.col("none") | ~F.col("given"), "no_human_value").when(F.col("same"), "agree").when(F.col("like"), "variant_equal").otherwise("disagree")
    return seen.select(*keys, status.alias("status"))


SEVERITY = {"disagree": 3, "variant_equal": 2, "agree": 1, "no_human_value": 0}


def worst_status(statuses: DataFrame, key: str) -> DataFrame:
    """The worst status of every cell."""
    rank = F.lit(-1)
    for name, n in SEVERITY.items():
        rank = F.when(F.col("status") == name, n).otherwise(rank)
    return statuses.groupBy(key).agg(F.max_by("status", F.struct(rank.alias("r"), "status")).alias("worst"))


def score_bucket(score: Column) -> Column:
    """Half-open buckets from below at 0.9, 0.8, 0.7 and 0.5."""
    return F.when(score >= 0.9, ">=0.90").when(score >= 0.8, "0.80-0.90").when(score >= 0.7, "0.70-0.80").when(score >= 0.5, "0.50-0.70").otherwise("<0.50")


def bucketed(df: DataFrame, score: str, measure: str) -> DataFrame:
    """Rows and mean measure of every bucket that has any."""
    return df.groupBy(score_bucket(F.col(score)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 6).alias("mean"))


def holdout_split(df: DataFrame, identity: Column, order: list[str], salt: str, percent: int = 30) -> DataFrame:
    """Deterministic split: an id from the identity and its ordinal, hold-out by a salted hash.

    Independent of row order but for exact duplicates, which are told apart by their ordinal.
    """
    key = df.withColumn("_key", identity)
    numbered = key.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(*order)) - 1)
    coded = numbered.withColumn("academy_id", F.substring(F.sha1(F.concat_ws("|", "_key", F.col("_k").cast("string")).cast("binary")), 1, 16))
    held = sha1_mod_100(F.concat("academy_id", F.lit(salt))) < percent
    return coded.withColumn("use_flag", F.when(held, "holdout").otherwise("train")).drop("_key", "_k")


def split_coverage(split: DataFrame, stratum: str) -> DataFrame:
    """Train and hold-out rows of every stratum, and whether it has no hold-out."""
    counted = split.groupBy(stratum).agg(F.count_if(F.col("use_flag") == "train").alias("train"), F.count_if(F.col("use_flag") == "holdout").alias("holdout"))
    return counted.withColumn("uncovered", F.col("holdout") == 0)


def machine_readings(suggested: DataFrame, key: str, engine: str) -> DataFrame:
    """Suggestions as rows of machine readings: the value stays what was read, what the lexicon
    says goes into the provenance, and nothing is accepted by it."""
    provenance = F.to_json(F.struct("best", "best_score", "margin", "status"))
    return suggested.select(key, F.lit(engine).alias("engine"), F.col("reading").alias("value"), F.coalesce("best_score", F.lit(0.0)).alias("confidence"), provenance.alias("provenance"))


def text_lines(df: DataFrame, text: str, boilerplate: str, least: int = 6) -> DataFrame:
    """Lines that are text: not boilerplate; ``counted`` tells those long enough to be scored."""
    return df.where(F.col(text).isNotNull() & ~F.col(text).rlike(boilerplate)).withColumn("counted", F.length(text) >= least)


def page_agreement(first: DataFrame, second: DataFrame, key: str, page: str) -> DataFrame:
    """Likeness of two readings of every page of the first: ``first`` and ``second`` have key, page and
    text (cleaned of marks here); a page the second lacks counts as empty, two empty ones as equal."""
    other = second.select(key, page, strip_marks("text").alias("_other"))
    both = first.select(key, page, strip_marks("text").alias("_own")).join(other, [key, page], "left")
    return both.select(key, page, page_likeness(F.coalesce("_own", F.lit("")), F.coalesce("_other", F.lit(""))).alias("score"))


def agreement_summary(scores: DataFrame, key: str, page: str, low: float = 0.25) -> DataFrame:
    """Pages, mean likeness and, in order, the pages under ``low``, which are to be looked at first."""
    poor = F.array_sort(F.collect_list(F.when(F.col("score") < low, F.col(page))))
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("score"), 6).alias("mean"), poor.alias("low"))


def fields_of_columns(boxes: DataFrame, key: str) -> DataFrame:
    """One record for each column of boxes (key, line, text, place, width): seniority, cohort, name,
    reading, post, dates, birth, honours, other.

    Boxes are taken in order of ``line``; the first number of the seniority band is the seniority,
    later ones are ``other``; the last cohort counts; name parts stand from above to below; parts of
    a field are joined.  A column holds tens of boxes.
    """
    middle = boxes.groupBy(key).agg(F.median("width").alias("_m"))
    wide = F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))
    kinds = boxes.join(middle, key).withColumn("kind", box_field(F.col("text"), F.col("place"), F.col("width"), wide))
    t = F.replace(F.trim("text"), F.lit(" "), F.lit(""))
    number = F.translate(t, WIDE_DIGITS, DIGITS).try_cast("int")
    rows = kinds.where("kind IS NOT NULL").select(key, "line", "kind", "place", t.alias("t"), F.trim("text").alias("whole"), number.alias("n"))
    first = F.min(F.when(F.col("kind") == "seniority", F.col("line"))).over(Window.partitionBy(key))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "seniority") & (F.col("line") > first), "other").otherwise(F.col("kind")))
    listed = lambda kind, order="line", value="t": F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(order, "line", value)))), lambda s: s[value])
    joined = lambda parts: F.nullif(F.array_join(parts, ""), F.lit(""))
    return rows.groupBy(key).agg(
        F.max(F.when(F.col("kind") == "seniority", F.col("n"))).alias("seniority"),
        F.max_by("n", F.when(F.col("kind") == "cohort", F.col("line"))).alias("cohort"),
        joined(listed("name", "place", "whole")).alias("name"),
        joined(listed("reading")).alias("reading"),
        joined(listed("post")).alias("post"),
        listed("date").alias("dates"),
        joined(listed("birth")).alias("birth"),
        joined(listed("honours")).alias("honours"),
        listed("other").alias("other"),
    )

"""Operators that the record's plan describes but no earlier code had: links over time and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of intervals of one key that overlap, by buckets of ``width`` days.

    ``start`` and ``end`` are day numbers; a missing end is open up to the last start of the
    other side.  A pair is taken in the bucket where its overlap begins, so it comes once.
    """
    latest = F.max(F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start))))
    ends = [df.agg(latest).first()[0] for df in (a, b)]
    last = F.lit(max((e for e in ends if e is not None), default=0))

    def spread(df: DataFrame, side: str) -> DataFrame:
        until = F.coalesce(F.col(end), last)
        named = [F.col(c).alias(f"{c}_{side}") for c in df.columns if c != key]
        return df.select(key, *named, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(until, F.col(start)) / width))).alias("bucket"))

    both = spread(a, "a").join(spread(b, "b"), [key, "bucket"])
    begin = F.greatest(f"{start}_a", f"{start}_b")
    meet = (F.col(f"{start}_a") <= F.coalesce(f"{end}_b", last)) & (F.col(f"{start}_b") <= F.coalesce(f"{end}_a", last))
    return both.where(meet & (F.floor(begin / width) == F.col("bucket"))).drop("bucket")


def overlap_totals(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: pairs of intervals that overlap or touch, and the days they share, summed over pairs.

    No pair is made: intervals are counted by the day they begin and the day they end, and running
    sums over a key's days do the rest.  The days of a key are as many as the calendar has, however
    many intervals lie on them.  Both ends are given and in order; keys without a pair are left out.
    """
    day = F.explode(F.array(F.struct(F.col(start).alias("d"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).alias("d"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    days = intervals.select(key, day.alias("x")).groupBy(key, F.col("x.d").alias("d")).agg(F.sum("x.s").alias("s"), F.sum("x.e").alias("e"))
    order = Window.partitionBy(key).orderBy("d")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = days.select(
        key,
        "e",
        F.sum("s").over(Window.partitionBy(key)).alias("n"),
        F.sum("s").over(upto).alias("begun"),
        (F.sum("s").over(upto) - F.sum("e").over(upto)).alias("open"),
        (F.lead("d").over(order) - F.col("d")).alias("span"),
    )
    apart = F.sum(F.col("e") * (F.col("n") - F.col("begun")))
    shared = F.sum((F.coalesce("span", F.lit(0)) * F.col("open") * (F.col("open") - 1) / 2).cast("bigint"))
    totals = swept.groupBy(key).agg(((F.max("n") * (F.max("n") - 1) / 2).cast("bigint") - apart).alias("pairs"), shared.alias("days"))
    return totals.where("pairs > 0")


def linkage_score(weights: list[tuple[Column, float, float]]) -> Column:
    """Sum of agreement and disagreement weights; a comparison that is null says nothing."""
    total = F.lit(0.0)
    for agrees, plus, minus in weights:
        total = total + F.when(agrees, F.lit(plus)).when(~agrees, F.lit(-minus)).otherwise(F.lit(0.0))
    return total


def linkage_band(score: Column, link: float, review: float) -> Column:
    return F.when(score >= link, "link").when(score >= review, "review").otherwise("no_link")


def reconciled(events: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Events between two neighbouring snapshots of a key, with the values before and after.

    ``events`` has key, at; ``snapshots`` key, at, value.  A range join within the key, whose
    snapshots are few.
    """
    window = Window.partitionBy(key).orderBy("at")
    spans = snapshots.select(key, F.col("at").alias("since"), F.lead("at").over(window).alias("until"), F.col("value").alias("before"), F.lead("value").over(window).alias("after")).where("until IS NOT NULL")
    return events.join(spans, key).where((F.col("at") > F.col("since")) & (F.col("at") <= F.col("until")))


def edition_changes(older: DataFrame, newer: DataFrame, keys: list[str], value: str, order: DataFrame) -> DataFrame:
    """Change class of everyone in either edition: appeared, disappeared, same, promoted, demoted.

    ``keys`` are the person and, where several editions are compared at once, the step between two.
    ``order`` gives the rank order of a value; values without one are other changes.
    """
    rank = lambda side: order.select(F.col(value).alias(f"{value}_{side}"), F.col("place").alias(f"place_{side}"))
    a = older.select(*keys, F.col(value).alias(f"{value}_old"), F.lit(True).alias("_o"))
    b = newer.select(*keys, F.col(value).alias(f"{value}_new"), F.lit(True).alias("_n"))
    both = a.join(b, keys, "full").join(rank("old"), f"{value}_old", "left").join(rank("new"), f"{value}_new", "left")
    kind = (
        F.when(F.col("_o").isNull(), "appeared")
        .when(F.col("_n").isNull(), "disappeared")
        .when(F.col(f"{value}_old").eqNullSafe(F.col(f"{value}_new")), "same")
        .when(F.col("place_new") > F.col("place_old"), "promoted")
        .when(F.col("place_new") < F.col("place_old"), "demoted")
        .otherwise("changed")
    )
    return both.select(*keys, f"{value}_old", f"{value}_new", kind.alias("change"))


def throughput(readings: DataFrame) -> DataFrame:
    """Quality metrics per month: readings, readers, flagged share, linked share, frames."""
    month = F.date_format("created_at", "yyyy-MM")
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    return readings.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("author_user_id").alias("readers"), share(F.col("status") == "flagged").alias("flag_rate"), share(F.col("person_id").isNotNull()).alias("link_rate"), F.count_distinct("page_id").alias("pages"))


def event_scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: events found, true, both, precision and recall; distinct events by ``keys``."""
    a, b = found.select(*keys).distinct().withColumn("_a", F.lit(1)), truth.select(*keys).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count("_a").alias("found"), F.count("_b").alias("true"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
    return n.select("found", "true", "both", F.round(F.try_divide("both", "found"), 6).alias("precision"), F.round(F.try_divide("both", "true"), 6).alias("recall"))


def coverage(read: DataFrame, worklist: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per group of a worklist: items, those read, and the share."""
    done = worklist.select(*keys, group).distinct().join(read.select(*keys).distinct().withColumn("_r", F.lit(1)), keys, "left")
    counted = done.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.count("_r").alias("done"))
    return counted.withColumn("share", F.round(F.col("done") / F.col("items"), 6))

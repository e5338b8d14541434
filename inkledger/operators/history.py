"""Full history of changing attributes from periodic snapshots, by Merkle comparison.

Each snapshot (edition) is a tree: the rows of a person hash into one of ``fanout ** depth``
leaf buckets, a leaf's hash is the order-free sum of its rows' hashes, an inner node's hash the
sum of its children's, mixed with their numbers.  Neighbouring snapshots are compared from the
root; only under branches that differ are children looked at, and only rows of changed leaves
are compared.  What appeared or differs opens a version, what went or differs closes one.

Shape on a cluster: one aggregation by (person, edition) picks the row that holds (map-side
combine, so a hot person or unit does no harm), the tree is a roll-up of one small row for each
(edition, leaf), the descent joins levels of that roll-up, and one window by person pairs
openings with closings.  A person has at most one row an edition, so no window partition grows
beyond the number of editions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions.text import consistent_form, variant_map
from inkledger.session import cut_lineage, small_rows

OPEN_END = "9999-12-31"
FANOUT = 16
#: Bound of the calendar that is brought to every task.
MOST_EDITIONS = 20_000


def edition_calendar(volumes: DataFrame, series: str) -> DataFrame:
    """The dated editions of a series: edition (0, 1, ...) and as_of_date.

    Editions of one date are one; undated volumes are none.  The window has one partition; it
    holds one row for each edition ever printed of one series.
    """
    dates = volumes.where((F.col("series") == series) & F.col("edition_date").isNotNull()).select(F.col("edition_date").alias("as_of_date")).distinct()
    by_date = Window.partitionBy(F.lit(0)).orderBy("as_of_date")
    rows = small_rows(dates.select("as_of_date", (F.row_number().over(by_date) - 1).alias("edition")), MOST_EDITIONS)
    return volumes.sparkSession.createDataFrame(rows, "as_of_date string, edition int")


def snapshots(observation: DataFrame, calendar: DataFrame, variants: dict[str, str]) -> DataFrame:
    """One row for each person and edition: the one created last (of equals the largest id)."""
    linked = observation.where("person_id IS NOT NULL AND as_of_date IS NOT NULL")
    order = F.struct("created_at", "obs_id")
    state = F.struct("rank_code", "post", "seniority_no")
    last = linked.groupBy("person_id", "as_of_date").agg(F.max_by(state, order).alias("s"))
    dated = last.join(F.broadcast(calendar.select("as_of_date", "edition")), "as_of_date")
    return dated.select("person_id", "edition", F.col("s.rank_code").alias("rank_code"), consistent_form(F.col("s.post"), variants).alias("post"), F.col("s.seniority_no").alias("seniority_no"))


def _row_hash(*columns: str) -> Column:
    """Hash that tells null from every value."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def _sum(column: Column) -> Column:
    """Order-free combination that cannot overflow: exclusive or of hashes, with the count."""
    return F.xxhash64(F.bit_xor(column), F.count(F.lit(1)))


def leaf_level(rows: DataFrame) -> DataFrame:
    """(node, edition, hash) of the leaves."""
    return rows.groupBy(F.col("leaf").alias("node"), "edition").agg(_sum(F.col("row_hash")).alias("hash"))


def parent_level(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(node, edition, hash) one level nearer the root."""
    return level.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("node"), "edition").agg(_sum(F.xxhash64("node", "hash")).alias("hash"))


def changed_nodes(level: DataFrame, last_edition: int, under: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """(node, edition) whose hash differs from that in the edition before.

    Only children of the nodes in ``under`` are compared.  A node without rows has no hash;
    going and coming are changes.
    """
    new = level.select("node", "edition", F.col("hash").alias("new"), F.lit(None).cast("long").alias("old"))
    old = level.select("node", (F.col("edition") + 1).alias("edition"), F.lit(None).cast("long").alias("new"), F.col("hash").alias("old"))
    both = new.unionByName(old.where(F.col("edition") <= last_edition))
    if under is not None:
        parents = under.select(F.col("node").alias("_parent"), F.col("edition").alias("_edition"))
        both = both.join(parents, (F.floor(both.node / fanout) == F.col("_parent")) & (both.edition == F.col("_edition")), "left_semi")
    pair = both.groupBy("node", "edition").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    return pair.where(~F.col("new").eqNullSafe(F.col("old"))).select("node", "edition")


def changed_leaves(leaves: DataFrame, depth: int, last_edition: int, fanout: int = FANOUT) -> DataFrame:
    """(leaf, edition) reached from the root by descending only under nodes that differ."""
    levels = [leaves]
    for _ in range(depth):
        levels.append(cut_lineage(parent_level(levels[-1], fanout)))
    found = None
    for level in reversed(levels):
        found = cut_lineage(changed_nodes(level, last_edition, found, fanout))
    return found.select(F.col("node").alias("leaf"), "edition")


def depth_for(people: int, fanout: int = FANOUT, leaf_size: int = 4) -> int:
    """Depth at which a leaf holds about ``leaf_size`` people; at most ``fanout ** 15`` leaves."""
    return min(15, max(1, math.ceil(math.log(max(people, 1) / leaf_size, fanout)))) if people > leaf_size else 1


def version_events(rows: DataFrame, changed: DataFrame, last_edition: int) -> DataFrame:
    """Rows of changed leaves compared by person: (person_id, edition, new, old), null where absent."""
    state = F.struct("rank_code", "post", "seniority_no")
    none = F.lit(None).cast(rows.select(state.alias("s")).schema["s"].dataType)
    new = rows.select("leaf", "edition", "person_id", state.alias("new"), none.alias("old"))
    old = rows.select("leaf", (F.col("edition") + 1).alias("edition"), "person_id", none.alias("new"), state.alias("old"))
    both = new.unionByName(old.where(F.col("edition") <= last_edition)).join(changed, ["leaf", "edition"], "left_semi")
    pair = both.groupBy("person_id", "edition").agg(F.first("new", ignorenulls=True).alias("new"), F.first("old", ignorenulls=True).alias("old"))
    return pair.where(~F.col("new").eqNullSafe(F.col("old")))


def build_history(rows: DataFrame, calendar: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Versions ``(person_id, valid_from, valid_to, rank_code, post, seniority_no)``.

    ``rows`` has person_id, edition and the attributes, one row for each person and edition; a
    null attribute is a value.  ``valid_to`` is the date of the edition after the last of the
    version, or ``9999-12-31``.
    """
    span = rows.agg(F.approx_count_distinct("person_id"), F.max("edition")).first()
    depth, last = depth_for(span[0], fanout), -1 if span[1] is None else span[1]
    leaf = F.pmod(F.xxhash64("person_id"), F.lit(fanout**depth)).cast("long")
    rows = rows.withColumn("leaf", leaf).withColumn("row_hash", _row_hash("person_id", "rank_code", "post", "seniority_no"))
    last = max(last, calendar.agg(F.max("edition")).first()[0] or 0)
    leaves = cut_lineage(leaf_level(rows))
    events = version_events(rows, changed_leaves(leaves, depth, last, fanout), last)
    by_person = Window.partitionBy("person_id").orderBy("edition")
    spans = events.select("person_id", "edition", "new", F.lead("edition").over(by_person).alias("until")).where("new IS NOT NULL")
    days = calendar.select("edition", "as_of_date")
    dated = spans.join(F.broadcast(days.withColumnRenamed("as_of_date", "valid_from")), "edition")
    dated = dated.join(F.broadcast(days.select(F.col("edition").alias("until"), F.col("as_of_date").alias("valid_to"))), "until", "left")
    return dated.select("person_id", "valid_from", F.coalesce("valid_to", F.lit(OPEN_END)).alias("valid_to"), "new.rank_code", "new.post", "new.seniority_no")


def leaf_of(depth: int, fanout: int = FANOUT) -> Column:
    return F.pmod(F.xxhash64("person_id"), F.lit(fanout**depth)).cast("long")


def edition_tree(rows: DataFrame, depth: int) -> DataFrame:
    """``(node, hash)`` of the leaves of one edition's rows (person_id and the attributes): what is
    stored beside the history, so that the next edition need not read this one again."""
    hashed = rows.withColumn("row_hash", _row_hash("person_id", "rank_code", "post", "seniority_no")).withColumn("leaf", leaf_of(depth)).withColumn("edition", F.lit(0))
    return leaf_level(hashed).select("node", "hash")


def append_edition(history: DataFrame, tree: DataFrame, rows: DataFrame, day: str, depth: int, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """History and tree once another edition has come: ``(history, tree)``.

    ``history`` has the versions so far, open ones ending at ``9999-12-31``; ``tree`` is the stored tree
    of the edition before; ``rows`` are the new edition's, one for each person, printed on ``day``,
    which is later than all before.  Trees are compared from the root down.  Only open versions in
    leaves that differ are read against the new rows: those that changed or went are closed on
    ``day``, those that changed or came are opened; every other version is passed on as it is.
    """
    fresh = cut_lineage(edition_tree(rows, depth))
    levels = fresh.select("node", F.lit(1).alias("edition"), "hash").unionByName(tree.select("node", F.lit(0).alias("edition"), "hash"))
    changed = changed_leaves(levels, depth, 1, fanout).where("edition = 1").select("leaf")
    placed = history.withColumn("leaf", leaf_of(depth, fanout)).join(changed.withColumn("_changed", F.lit(True)), "leaf", "left")
    touched = (F.col("valid_to") == OPEN_END) & F.col("_changed")
    state = F.struct("rank_code", "post", "seniority_no")
    old = placed.where(touched).select("person_id", "valid_from", state.alias("old"))
    new = rows.withColumn("leaf", leaf_of(depth, fanout)).join(changed, "leaf", "left_semi").select("person_id", state.alias("new"))
    both = old.join(new, "person_id", "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    keep = F.when(F.col("old").isNotNull(), F.struct("valid_from", F.when(same, OPEN_END).otherwise(day).alias("valid_to"), F.col("old").alias("s")))
    begin = F.when(~same & F.col("new").isNotNull(), F.struct(F.lit(day).alias("valid_from"), F.lit(OPEN_END).alias("valid_to"), F.col("new").alias("s")))
    versions = both.select("person_id", F.explode(F.array_compact(F.array(keep, begin))).alias("v")).select("person_id", "v.valid_from", "v.valid_to", "v.s.rank_code", "v.s.post", "v.s.seniority_no")
    passed = placed.where(~F.coalesce(touched, F.lit(False))).select(*versions.columns)
    return passed.unionByName(versions), fresh


def attribute_history(observation: DataFrame, volumes: DataFrame, kanji_variant: DataFrame, series: str = "retsuji") -> DataFrame:
    """History of rank, post and seniority of every linked person over the editions of a series.

    Rows without person or date, and dates that are no edition, give nothing; a row delivered
    twice counts once; with no editions the history is empty.
    """
    calendar = edition_calendar(volumes, series)
    rows = cut_lineage(snapshots(observation, calendar, variant_map(kanji_variant)))
    return build_history(rows, calendar)

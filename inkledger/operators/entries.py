"""Entries on their way into the record: guards, creation with a log, page listings, work order.

An entry that fails a precondition is returned with the reason and never stored; what is stored is
always a draft of its caller.  Nothing here guesses: a date that cannot be read is stored as none,
with what was written and why it was refused beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.operators.records import display_name

#: Reasons for which an entry is refused, in the order they are looked for.
NO_PAGE, NO_EDITION, NO_CELL = "page is not registered", "volume has no edition date", "officer has no roster cell"


def resolved_pages(pages: DataFrame, volumes: DataFrame) -> DataFrame:
    """Registered pages by archive number and frame, with their volume's title and date; pages of
    unknown volumes are left out."""
    vol = volumes.select("volume_id", "pid", "title", "edition_date")
    return pages.select("page_id", "volume_id", "frame_no").join(vol, "volume_id").select("pid", "frame_no", "page_id", "volume_id", "title", "edition_date")


def guarded(entries: DataFrame, pages: DataFrame, cells: DataFrame) -> DataFrame:
    """``entries`` (volume_id, frame_no, row_index, ...) with page_id, cell_id, as_of_date and
    ``reject_reason``, the first precondition that fails, else null.

    ``pages`` has volume_id, frame_no, page_id, edition_date, one row each; ``cells`` page_id,
    row_index, cell_id.  An empty edition date is none.
    """
    page = pages.select("volume_id", "frame_no", "page_id", F.nullif(F.trim("edition_date"), F.lit("")).alias("as_of_date"))
    known = entries.join(page, ["volume_id", "frame_no"], "left").join(cells.select("page_id", "row_index", "cell_id"), ["page_id", "row_index"], "left")
    reason = F.when(F.col("page_id").isNull(), NO_PAGE).when(F.col("as_of_date").isNull(), NO_EDITION).when(F.col("cell_id").isNull(), NO_CELL)
    return known.withColumn("reject_reason", reason)


def created(accepted: DataFrame, parsed: Column) -> DataFrame:
    """Drafts of accepted entries: the parsed date or none, and in ``confidence`` the entry's own marks,
    its trimmed notes, and a date that was refused as written with the reason.

    ``parsed`` is a struct of value and reason over the entry; an empty date is neither.
    """
    written = F.coalesce(F.col("commissioning_date"), F.lit("")) != ""
    rows = accepted.withColumn("_d", F.when(written, parsed))
    own = F.coalesce(F.from_json("field_confidence", "map<string,string>"), F.create_map().cast("map<string,string>"))
    notes = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.create_map(F.lit("notes"), F.trim("notes")))
    refused = F.when(F.col("_d.reason").isNotNull(), F.create_map(F.lit("commissioning_date"), F.to_json(F.struct(F.col("commissioning_date").alias("raw"), F.col("_d.reason").alias("refused")))))
    added = F.map_concat(*[F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (notes, refused)])
    marks = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(added, k)), added)
    return rows.withColumn("day", F.col("_d.value")).withColumn("confidence", F.map_from_entries(F.array_sort(F.map_entries(marks)))).withColumn("status", F.lit("draft")).drop("_d")


def marked_fields(confidence: Column) -> tuple[Column, Column]:
    """Fields that were refused, and those with characters nobody could read, sorted; of nested marks
    ``refused`` and a true ``unreadable``."""
    nested = lambda v, key: F.get_json_object(v, f"$.{key}")
    fields = lambda keep: F.array_sort(F.map_keys(F.map_filter(confidence, keep)))
    truthy = lambda v: F.coalesce(~nested(v, "unreadable").isin("", "0", "false", "null"), F.lit(False))
    return fields(lambda k, v: nested(v, "refused").isNotNull()), fields(lambda k, v: truthy(v))


def creation_log(drafts: DataFrame, action: str = "create_observation") -> DataFrame:
    """What is logged with every draft: who, what, where.  A second output of the same input."""
    return drafts.select(F.col("author_user_id").alias("user_id"), F.lit(action).alias("action"), "volume_id", "frame_no", "row_index", "obs_id")


def page_listing(observations: DataFrame, cells: DataFrame, users: DataFrame) -> DataFrame:
    """Readings of pages with their row and their author's public name; readings without a cell are
    left out, those of unknown authors kept."""
    user = users.select(F.col("user_id").alias("author_user_id"), display_name().alias("author"))
    joined = observations.join(cells.select("cell_id", "row_index"), "cell_id").join(user, "author_user_id", "left")
    return joined.withColumn("author", F.coalesce("author", F.lit("(unnamed)"))).drop("author_user_id")


def with_value(df: DataFrame, key: str, at: Column, column: str, value: Column) -> DataFrame:
    """The table with one field of one key set; all else as it was."""
    return df.withColumn(column, F.when(F.col(key) == at, value).otherwise(F.col(column)))


def backfill_state(present: Column, found: Column, parsed: Column) -> Column:
    """What a backfill of edition dates does with a volume: already set, would write, refused; a
    title without a date says so."""
    return F.when(F.coalesce(F.trim(present), F.lit("")) != "", "already set").when(found.isNull(), "no date").when(parsed.isNull(), "refused").otherwise("would write")


def by_year(worklist: DataFrame, year: str, pid: str) -> DataFrame:
    """The worklist in order of year and number, both as text, missing ones first."""
    return worklist.orderBy(F.col(year).cast("string").asc_nulls_first(), F.col(pid).cast("string").asc_nulls_first())


def expected_order(readings: DataFrame, keys: list[str], seniority: str, tie: str) -> DataFrame:
    """Place of every reading in the order of seniority expected of the next edition: by the number
    it had, readings without one last."""
    window = Window.partitionBy(*keys).orderBy(F.col(seniority).asc_nulls_last(), tie)
    return readings.withColumn("expected", F.row_number().over(window))


def variants_json(variants: Column) -> Column:
    """A list written with semicolons as a JSON array, trimmed, without empty parts."""
    parts = F.filter(F.transform(F.split(F.coalesce(variants, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")
    return F.to_json(parts)


def portable(df: DataFrame) -> DataFrame:
    """Columns in types every store has: days and instants as ISO text, decimals as doubles, truth as
    0 or 1, arrays, maps and structs as JSON."""

    def plain(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if kind.startswith("decimal"):
            return c.cast("double")
        if kind == "boolean":
            return c.cast("int")
        return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c

    return df.select(*[plain(name, kind).alias(name) for name, kind in df.dtypes])


def tasks_of(flags: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """One review task for each flagged cell that has none open: cell_id, the code and detail of its
    first flag in order of check (line ends flattened), and the audit status its flags give it."""
    first = flags.groupBy("cell_id").agg(
        F.min(F.struct("check_order", "code", F.regexp_replace(F.coalesce("detail", F.lit("")), "\\s*[\\r\\n]+\\s*", " ").alias("detail"))).alias("f"),
        F.min(F.when(F.col("audit_status").isNotNull(), F.struct("check_order", "audit_status"))).alias("s"),
    )
    return first.join(open_tasks.select("cell_id").distinct(), "cell_id", "left_anti").select("cell_id", F.col("f.code").alias("code"), F.col("f.detail").alias("detail"), F.col("s.audit_status").alias("audit_status"))

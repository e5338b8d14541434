"""The relational record: joins, roll-ups, merges and guards over readings.

Every enrichment join is a left join (unlinked readings are kept).  Dimensions are joined without
a hint: Spark broadcasts them while their size is small and known, else AQE decides at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_parts(df: DataFrame) -> DataFrame:
    """volume_id, frame_no and row_index out of ``volume:frame:row`` cell ids."""
    part = F.split("cell_id", ":")
    return df.withColumns({"volume_id": F.try_element_at(part, F.lit(1)), "frame_no": F.try_element_at(part, F.lit(2)).try_cast("int"), "row_index": F.try_element_at(part, F.lit(3)).try_cast("int")})


def display_name(column: Column | str = "display_name") -> Column:
    """A user's public name; the login never leaves the user table."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("(unnamed)"))


def officer_record(observation: DataFrame, volumes: DataFrame, ranks: DataFrame, branches: DataFrame, users: DataFrame) -> DataFrame:
    """The full record, one row for each reading of a known volume."""
    obs = cell_parts(observation)
    vol = volumes.select("volume_id", "pid", "title", "edition_date")
    rank = ranks.select("rank_code", F.col("label_ja").alias("rank_ja"), F.col("label_en").alias("rank_en"))
    branch = branches.select("branch_code", F.col("label_ja").alias("branch_ja"), F.col("label_en").alias("branch_en"))
    user = users.select(F.col("user_id").alias("author_user_id"), display_name().alias("author"))
    joined = obs.join(vol, "volume_id").join(rank, "rank_code", "left").join(branch, "branch_code", "left").join(user, "author_user_id", "left")
    return joined.select("obs_id", "pid", "title", "edition_date", "frame_no", "row_index", "name_raw", "rank_ja", "rank_en", "branch_ja", "branch_en", "post", "seniority_no", "commissioning_date", "as_of_date", "status", F.coalesce("author", F.lit("(unnamed)")).alias("author"))


def work_log(log: DataFrame, users: DataFrame) -> DataFrame:
    """Log entries with their author's public name, in order of the log."""
    user = users.select("user_id", display_name().alias("author"))
    return log.join(user, "user_id", "left").orderBy("log_id")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of every key; an aggregation, so no window is filled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def counted_authors(users: DataFrame, readings: DataFrame, key: str) -> DataFrame:
    """Every user with the number of readings, zero included."""
    counts = readings.groupBy(F.col(key).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return users.join(counts, "user_id", "left").select("user_id", display_name().alias("author"), F.coalesce("n", F.lit(0)).alias("n_readings"))


def progress(readings: DataFrame) -> DataFrame:
    """Per volume and frame: readings, distinct rows, last entry; unread frames are omitted."""
    return readings.groupBy("volume_id", "frame_no").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("row_index").alias("rows_read"), F.max("created_at").alias("last_at"))


def progress_rollup(frames: DataFrame) -> DataFrame:
    return frames.groupBy("volume_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("observations").alias("observations"))


def merge_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], kept: Sequence[str], refreshed: Sequence[str]) -> DataFrame:
    """Upsert: ``kept`` columns stay as first stored, ``refreshed`` take the update's value."""
    old = base.select(*keys, *[F.col(c).alias(f"old_{c}") for c in (*kept, *refreshed)], F.lit(True).alias("_old"))
    new = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in (*kept, *refreshed)], F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full")
    take = [F.when(F.col("_old"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in kept]
    take += [F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in refreshed]
    action = F.when(F.col("_old") & F.col("_new"), "updated").when(F.col("_new"), "inserted").otherwise("kept")
    return both.select(*keys, *take, action.alias("action"))


def insert_missing(existing: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offered rows whose key is not there yet, once each (insert or ignore)."""
    return offered.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, null being a key value like any other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def changed_snapshots(df: DataFrame, key: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Rows that differ from the one before of the same key: re-submissions are no-ops."""
    mark = F.struct(*state)
    before = F.lag(F.struct(mark.alias("s"))).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b.s").eqNullSafe(mark)).drop("_b")


def union_catalogues(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], attributes: Sequence[str]) -> DataFrame:
    """Full union by key with provenance; the first catalogue's attributes win, blank keys drop."""
    a = left.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, *[F.col(c).alias(f"a_{c}") for c in attributes], F.lit(names[0]).alias("_a"))
    b = right.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, *[F.col(c).alias(f"b_{c}") for c in attributes], F.lit(names[1]).alias("_b"))
    return a.join(b, key, "full").select(key, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in attributes], F.concat_ws("+", "_a", "_b").alias("source"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def confidence_marks(df: DataFrame, column: str, level: str) -> DataFrame:
    """Fields whose JSON confidence is ``level``, sorted; malformed JSON has none."""
    fields = F.from_json(column, "map<string,string>")
    marked = F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: v == level)))
    return df.withColumn("marked", F.coalesce(F.array_join(marked, ","), F.lit("")))


def blank(*columns: str) -> Column:
    """Whether every field is empty after trimming."""
    return F.forall(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: F.trim(x) == "")


def build_readings(df: DataFrame, parsed: Column) -> DataFrame:
    """Records with a date xor a refusal, the refused and the unreadable fields apart.

    Unreadable marks (geta) take precedence over refusals; nothing is guessed, nothing dropped.
    """
    geta = lambda c: F.coalesce(F.regexp_count(c, F.lit("〓")), F.lit(0))
    out = df.withColumn("_d", parsed)
    refused = F.when(F.col("_d.reason").isNotNull() & (geta("commissioning_date") == 0) & (F.trim(F.coalesce("commissioning_date", F.lit(""))) != ""), F.array(F.lit("commissioning_date"))).otherwise(F.array().cast("array<string>"))
    recheck = F.filter(F.array(*[F.when(geta(c) > 0, F.lit(c)) for c in ("name_raw", "post", "commissioning_date")]), lambda x: x.isNotNull())
    return out.select("obs_id", F.col("_d.value").alias("day"), F.col("_d.reason").alias("reason"), F.array_join(refused, ",").alias("flagged"), F.array_join(recheck, ",").alias("needs_recheck"), blank("name_raw", "rank_code", "branch_code", "post", "commissioning_date").alias("is_blank"))


def not_exactly_one(*columns: str) -> Column:
    """Whether none or more than one of the columns is given."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) != 1


def ends_before(start: str, end: str) -> Column:
    """Whether an interval ends before it begins; an open one does not."""
    return F.coalesce(F.col(end) < F.col(start), F.lit(False))


def constraint_violations(checks: Sequence[tuple[str, DataFrame, str, Column]]) -> DataFrame:
    """``(constraint, key, n)``: rows that break a rule, as (name, table, key column, condition)."""
    out = None
    for name, df, key, broken in checks:
        part = df.where(broken).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint_name"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def swap_suggestions(df: DataFrame, key: str, text: str, variants: DataFrame) -> DataFrame:
    """Variant swaps offered for a text: every table pair one side of which the text has, in both
    directions, once for each text and in the order of first appearance."""
    chars = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "")).alias("at", "from")).where(F.col("from") != "")
    first = chars.groupBy(key, "from").agg(F.min("at").alias("at"))
    pairs = variants.where("length(variant_char) = 1 AND length(canonical_char) = 1").select(F.col("variant_char").alias("v"), F.col("canonical_char").alias("c")).distinct()
    both = pairs.select(F.col("v").alias("from"), F.col("c").alias("to")).unionByName(pairs.select(F.col("c").alias("from"), F.col("v").alias("to"))).distinct()
    return first.join(both, "from").select(key, "at", "from", "to")


def service_mismatch(day: Column, years: Column, months: Column, days: Column, edition: Column) -> Column:
    """Days by which a rank's date plus elapsed service misses the edition's date."""
    return F.date_diff(edition, F.date_add(F.add_months(day, years * 12 + months), days))


def issue_pid(issue: Column, offset: int = 2956479) -> Column:
    """Archive number of a gazette issue of the mid-1930s, whose numbers run in parallel."""
    return issue + F.lit(offset)

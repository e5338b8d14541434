"""Ordered scans as windows: monotone sequences, clusters, runs, gaps, repairs, carry-forward.

Every window is partitioned by a page, a person or a like key; pages and persons are short, so no
partition grows with the data.  Every order is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.session import cut_lineage


def sequence_breaks(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not above the previous non-null one; nulls are transparent.

    The broken value becomes the predecessor, so one outlier breaks once.
    """
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.last(value, ignorenulls=True).over(window)).where(F.col(value) <= F.col("previous"))


def sequence_audit(df: DataFrame, keys: list[str], order: list[str], value: str, expected: int) -> DataFrame:
    """Per key: rows, rows with a value, breaks as text, and the row-count check."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_p", F.last(value, ignorenulls=True).over(window)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    broken = F.when(F.col(value) <= F.col("_p"), F.struct("_k", F.concat_ws(">", F.col("_p").cast("string"), F.col(value).cast("string")).alias("t")))
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_with_value"), F.array_join(F.transform(F.array_sort(F.collect_list(broken)), lambda b: b.t), ";").alias("breaks"))
    check = F.when(F.col("n") < expected, "missing_row").when(F.col("n") > expected, "extra_row")
    return out.select(*keys, "n", "n_with_value", (F.col("breaks") == "").alias("monotone_ok"), "breaks", check.alias("row_check"))


def gap_clusters(df: DataFrame, keys: list[str], value: str, tie: str, gap: float, least: int = 1) -> DataFrame:
    """Clusters of a sorted value that part where the step is above ``gap`` (gaps and islands)."""
    window = Window.partitionBy(*keys).orderBy(value, tie)
    step = F.col(value) - F.lag(value).over(window)
    marked = df.where(F.col(value).isNotNull()).withColumn("_new", F.when(step > gap, 1).otherwise(0))
    marked = marked.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return marked.where(F.col("_size") >= least).withColumn("cluster", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new", "_size")


def cluster_positions(clusters: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One position for each cluster: the floor of its mean."""
    return clusters.groupBy(*keys, "cluster").agg(F.floor(F.avg(value)).alias("position"), F.count(F.lit(1)).alias("n"))


def steps(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Rows with the step from the value before (the first has none)."""
    window = Window.partitionBy(*keys).orderBy(value, tie)
    return df.withColumn("k", F.row_number().over(window)).withColumn("step", F.col(value) - F.lag(value).over(window))


def longest_regular_run(df: DataFrame, keys: list[str], value: str, tie: str, tolerance: float = 0.2, most: int = 4, usual: tuple[float, float] | None = None) -> DataFrame:
    """Longest run of steps near a whole multiple (1..``most``) of the median step; the earliest
    of equals.  Gives first and last place of the run, its steps and the pitch.  With ``usual`` the
    pitch is the median of the steps within these multiples of the median of all, if there are any."""
    stepped = steps(df.where(F.col(value).isNotNull()), keys, value, tie)
    pitch = stepped.where("step IS NOT NULL").groupBy(*keys).agg(F.median("step").alias("pitch"))
    if usual is not None:
        core = stepped.join(pitch, keys).where(F.col("step").between(usual[0] * F.col("pitch"), usual[1] * F.col("pitch"))).groupBy(*keys).agg(F.median("step").alias("_core"))
        pitch = pitch.join(core, keys, "left").select(*keys, F.coalesce("_core", "pitch").alias("pitch"))
    pitch = pitch.where("pitch > 0")
    times = F.col("step") / F.col("pitch")
    whole = F.round(times)
    good = stepped.where("step IS NOT NULL").join(pitch, keys).where((whole >= 1) & (whole <= most) & (F.abs(times - whole) <= tolerance))
    island = F.col("k") - F.row_number().over(Window.partitionBy(*keys).orderBy("k"))
    runs = good.withColumn("_i", island).groupBy(*keys, "_i", "pitch").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("n_steps"))
    best = runs.groupBy(*keys).agg(F.min(F.struct((-F.col("n_steps")).alias("m"), "first_k", "last_k", "pitch")).alias("b"))
    return best.select(*keys, F.col("b.first_k").alias("first_k"), F.col("b.last_k").alias("last_k"), (-F.col("b.m")).alias("n_steps"), F.col("b.pitch").alias("pitch"))


def fill_gaps(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Whole numbers missing between neighbours at most ``most`` apart, marked interpolated."""
    following = F.lead(value).over(Window.partitionBy(*keys).orderBy(value))
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_n", following)
    until = F.when((F.col("_n") - F.col(value)).between(2, most), F.col("_n") - 1).otherwise(F.col(value))
    filled = rows.select(*keys, F.col(value).alias("_v"), F.explode(F.sequence(F.col(value), until)).alias(value))
    return filled.select(*keys, value, (F.col(value) != F.col("_v")).alias("interpolated"))


def recovered(reading: Column, previous: Column, following: Column) -> Column:
    """Value of a number whose leading digits were cropped: the only prefix 1..99 that puts it
    strictly between its neighbours.  Null if it fits already, is no number, or is ambiguous."""
    digits = F.trim(reading)
    low, high = F.least(previous, following), F.greatest(previous, following)
    known = previous.isNotNull() & following.isNotNull() & (high - low >= 2) & digits.rlike("^[0-9]{1,9}$")
    now = digits.try_cast("bigint")
    fits = F.filter(F.transform(F.sequence(F.lit(1), F.lit(99)), lambda p: F.concat(p.cast("string"), digits).try_cast("bigint")), lambda x: (x > low) & (x < high))
    return F.when(known & ~((now > low) & (now < high)) & (F.size(fits) == 1), F.element_at(fits, 1))


def repaired_numbers(df: DataFrame, keys: list[str], order: list[str], reading: str, truth: str) -> DataFrame:
    """Rows with the value recovered from their neighbours' numbers."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("recovered", recovered(F.col(reading), F.lag(truth).over(window), F.lead(truth).over(window)))


def carried_forward(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each field with its own value or the nearest earlier non-empty one, independently."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_carried": F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(window) for c in fields})


def next_unread(read: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Smallest number after each run of read ones: where reading goes on."""
    here = read.select(*keys, value).distinct()
    following = here.select(*keys, (F.col(value) + 1).alias(value))
    return following.join(here, [*keys, value], "left_anti").groupBy(*keys).agg(F.min(value).alias("next_unread"))


def next_after(read: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each current number of a key the smallest greater one that has not been read, null where
    none has: ``current`` has keys and ``at``."""
    here = read.select(*keys, value).distinct()
    last = here.groupBy(*keys).agg(F.max(value).alias("_top"))
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    runs = here.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(value).alias("_from"), F.max(value).alias("_to"))
    # the first number after `at` is free, or it lies in a run, which is then passed
    met = current.join(last, keys, "left").join(runs, keys, "left").where(F.col("_from").isNull() | (F.col("at") + 1).between(F.col("_from"), F.col("_to")))
    held = met.groupBy(*keys, "at").agg(F.max("_to").alias("_to"))
    return current.join(held, [*keys, "at"], "left").select(*keys, "at", (F.coalesce("_to", "at") + 1).alias("next_unread"))


def page_labels(frames: DataFrame, model: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Estimated printed pages of frames by their key's page-number model: front matter before page 1,
    two pages where the slope is 2; unknown without a model."""
    page = F.floor(F.col("slope") * F.col(frame) + F.col("offset"))
    number = page.cast("bigint").cast("string")
    label = (
        F.when(F.col("slope").isNull(), "printed page unknown")
        .when(page < 1, "front matter")
        .when(F.col("slope") == 2, F.concat(F.lit("pages "), (page - 1).cast("bigint").cast("string"), F.lit("-"), number))
        .otherwise(F.concat(F.lit("page "), number))
    )
    return frames.join(model.select(*keys, "slope", "offset"), keys, "left").select(*frames.columns, label.alias("label"))


def cluster_totals(clusters: DataFrame, key: str, frame: str) -> DataFrame:
    """Per key: frames, clusters in all and, rounded to a tenth, their mean a frame."""
    per_frame = clusters.groupBy(key, frame).agg(F.max("n").alias("n"))
    return per_frame.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("columns"), F.bround(F.avg("n"), 1).alias("mean"))


def half_even_median(values: Column) -> Column:
    """Median that takes one element of an even list: place (n-1)/2 rounded half to even; null for an
    empty list."""
    return F.get(F.array_sort(values), F.bround((F.size(values) - 1) / 2).cast("int"))


def page_number_model(df: DataFrame, keys: list[str], frame: str, page: str) -> DataFrame:
    """Slope 1 or 2 (nearest to the median rate, 2 of equals), offset and largest deviation.

    A key has as many anchors as a volume has dated frames, so the lists are short.
    """
    window = Window.partitionBy(*keys).orderBy(frame)
    rated = df.withColumn("_r", (F.col(page) - F.lag(page).over(window)) / (F.col(frame) - F.lag(frame).over(window)))
    rate = rated.groupBy(*keys).agg(half_even_median(F.collect_list("_r")).alias("_m"))
    sloped = df.join(rate.where("_m IS NOT NULL"), keys).withColumn("slope", F.when(F.abs(F.col("_m") - 1) < F.abs(F.col("_m") - 2), 1).otherwise(2))
    offset = sloped.groupBy(*keys, "slope").agg(half_even_median(F.collect_list(F.col(page) - F.col("slope") * F.col(frame))).alias("offset"))
    deviation = F.abs(F.col(page) - F.col("slope") * F.col(frame) - F.col("offset"))
    return sloped.join(offset, [*keys, "slope"]).groupBy(*keys, "slope", "offset").agg(F.max(deviation).alias("deviation"))


def ordinals(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of earlier rows of the same identity (from 0)."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def spread_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int = 0) -> DataFrame:
    """Place (from 0) of every row within its key, for keys of any size.

    Rows are range-partitioned by key and order, so a hot key lies in many partitions; each
    numbers its own rows, and the rows of a key in the partitions before it are added.  The
    partitioning is written once, as a second sampling could put rows elsewhere.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(offsets, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")

"""Mixed timestamp formats and time zones brought to one unambiguous form.

An ordered cascade of anchored patterns with strict parsing (``functions.notations``), a default
zone looked up by source, and an explicit policy for local times that occur twice or never:
they stand for no single instant and give no row.

Shape on a cluster: one narrow projection per table, the zone lookup is a join with the user
table (Spark broadcasts it while it is small, else the join is by hash with skew splitting),
and one aggregation with map-side combine takes out rows delivered twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.notations import any_day, any_instant


def zones_of(users: DataFrame) -> DataFrame:
    """One default zone for each user; contradicting rows give none."""
    valid = users.select("user_id", F.col("time_zone").alias("zone")).where("user_id IS NOT NULL")
    return valid.groupBy("user_id").agg(F.when(F.count_distinct("zone") == 1, F.min("zone")).alias("zone"))


def normal_days(df: DataFrame, key: str, field: str, text: Column, pos: Column, context_era: Column | None = None) -> DataFrame:
    """``(record_id, field_name, pos, normal)`` for the texts that name one day."""
    day = any_day(text, context_era)
    return df.select(F.col(key).cast("long").alias("record_id"), F.lit(field).alias("field_name"), pos.cast("int").alias("pos"), day.alias("normal")).where("normal IS NOT NULL")


def normal_instants(df: DataFrame, key: str, field: str, author: str, zones: DataFrame) -> DataFrame:
    """The same for texts that name one instant; ``zones`` is the source lookup."""
    rows = df.select(F.col(key).cast("long").alias("record_id"), F.col(field).alias("_text"), F.col(author).alias("user_id")).where("_text IS NOT NULL")
    found = rows.join(zones, "user_id", "left").select("record_id", F.lit(field).alias("field_name"), F.lit(0).alias("pos"), any_instant(F.col("_text"), F.col("zone")).alias("normal"))
    return found.where("normal IS NOT NULL")


def normalise_times(observation_in: DataFrame, officers: DataFrame, users: DataFrame) -> DataFrame:
    """All dated fields of readings and officers: record_id, field_name, pos, normal.

    Null, blank, incomplete, unreadable or impossible values give no row; a record delivered
    twice gives one; an empty table gives none; further columns of the inputs are not read.
    """
    zero = F.lit(0)
    listed = officers.select("officer_id", F.posexplode("dates").alias("_pos", "_text"))
    parts = [
        normal_days(observation_in, "obs_id", "commissioning_date", F.col("commissioning_date"), zero, F.col("context_era")),
        normal_instants(observation_in, "obs_id", "created_at", "author_user_id", zones_of(users)),
        normal_days(officers, "officer_id", "birth", F.col("birth"), zero),
        normal_days(listed, "officer_id", "dates", F.col("_text"), F.col("_pos")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()

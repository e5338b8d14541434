"""Append-only readings as a stream: an extension beyond batch use.

Readings arrive as files in a folder; late rows are held to a watermark, rows delivered twice are
dropped within it.  State is bounded by the watermark, or by the number of pages for the
predecessors of a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def readings_stream(spark: SparkSession, folder: str, schema, late: str = "30 days", files: int = 16) -> DataFrame:
    """The stream with its watermark, each obs_id once."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["obs_id"])


def progress_stream(readings: DataFrame, every: str = "7 days") -> DataFrame:
    """Readings and approximate rows read of every volume and window."""
    volume = F.split("page_id", ":")[0]
    return readings.groupBy(F.window("created_at", every), volume.alias("volume_id")).agg(F.count(F.lit(1)).alias("readings"), F.approx_count_distinct("cell_id").alias("cells"))


def sessions_stream(readings: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Reading sessions of every author: gap clustering as session windows."""
    return readings.groupBy(F.session_window("created_at", gap), "author_user_id").agg(F.count(F.lit(1)).alias("readings"))


def breaks_stream(readings: DataFrame) -> DataFrame:
    """Sequence breaks of every page in order of arrival: the state is the last number seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for rows in batches:
            for at, value in rows.sort_values("obs_id")[["obs_id", "seniority_no"]].itertuples(index=False):
                if pd.isna(value):
                    continue
                if last is not None and value <= last:
                    out.append((key[0], int(at), int(value), int(last)))
                last = int(value)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["page_id", "obs_id", "seniority_no", "previous"])

    schema = "page_id string, obs_id long, seniority_no long, previous long"
    return readings.groupBy("page_id").applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)

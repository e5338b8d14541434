"""Sinks: single-file tables for people, folders of files for machines."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> int:
    """One CSV with a byte-order mark and its header even when there are no rows.

    Rows come to the driver partition by partition and are written as they come, so its memory
    holds one partition at most.  Gives the number of rows.
    """
    n = 0
    with Path(path).open("w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def export_folder(df: DataFrame, path: str, partition: str | None = None) -> None:
    """CSV files with headers, by partition where one is named."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def registration(split: DataFrame, stratum: str) -> DataFrame:
    """One row of JSON that registers a split: counts, coverage by stratum, digest of all ids."""
    per = split.groupBy(F.coalesce(stratum, F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("use_flag") == "holdout").alias("h"))
    strata = F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", F.struct("n", "h")))))
    totals = per.agg(F.sum("n").alias("rows"), F.sum("h").alias("holdout"), strata.alias("strata"))
    digest = split.agg(F.hex(F.bit_xor(F.xxhash64("academy_id", "use_flag"))).alias("digest"))
    both = totals.withColumn("_k", F.lit(1)).join(digest.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.to_json(F.struct("rows", "holdout", "strata", "digest")).alias("json"))


def chunk_files(chunks: DataFrame, folder: str, key: str, chunk: str, body: str) -> None:
    """One text file for each chunk, in a folder for each key."""
    named = chunks.select(F.col(key), F.col(chunk), F.col(body))
    named.write.mode("overwrite").partitionBy(key, chunk).option("lineSep", "\n").text(folder)


def inline_markup(column: Column | str) -> Column:
    """Markdown of one line as HTML: escapes, then code, bold and emphasis."""
    c = F.col(column) if isinstance(column, str) else column
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    c = F.regexp_replace(c, "`([^`]+)`", "<code>$1</code>")
    c = F.regexp_replace(c, "\\*\\*([^*]+)\\*\\*", "<strong>$1</strong>")
    return F.regexp_replace(c, "\\*([^*]+)\\*", "<em>$1</em>")


def markup_line(column: Column | str) -> Column:
    """Kind of a markdown line: heading, rule, item, table, blank or text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.trim(c) == "", "blank").when(c.rlike("^#{1,6} "), "heading").when(c.rlike("^(-{3,}|\\*{3,})$"), "rule").when(c.rlike("^\\s*([-*]|[0-9]+\\.) "), "item").when(c.rlike("^\\|.*\\|$"), "table").otherwise("text")

"""Scans of landed files: headered tables, lexicons, vocabularies, templates, blocks of text."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TEMPLATE_SCHEMA = "template_id string, tolerance double, min_bands int, min_explained double, min_columns int, bands array<double>, fields array<struct<name:string, a:int, b:int>>"


def headered(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headered table, all strings, a byte-order mark before the first name ignored; a missing
    file is an empty table."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    named = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[F.col(f"`{named[c]}`").alias(c) if c in named else F.lit(None).cast("string").alias(c) for c in columns])


def lexicon(spark: SparkSession, path: str, name: str, attributes: list[str]) -> DataFrame:
    """A lexicon with each row's line number in its file (the header is line 1).

    Blank names are left out, blank attributes are null.  File order is not kept by a parallel
    scan, so lines are numbered by offset: each partition counts its lines after the counts of
    the partitions before it.  Fields may not hold line breaks.
    """
    lines = spark.sparkContext.textFile(path).zipWithIndex()
    numbered = spark.createDataFrame(lines, "line string, at long")
    header = numbered.where("at = 0").first()[0].lstrip("﻿")
    schema = ", ".join(f"`{c.strip()}` string" for c in header.split(","))
    rows = numbered.where("at > 0").select((F.col("at") + 1).alias("row_ref"), F.from_csv("line", schema).alias("r"))
    clean = lambda c: F.nullif(F.trim(F.col(f"r.`{c}`")), F.lit(""))
    return rows.select("row_ref", clean(name).alias(name), *[clean(c).alias(c) for c in attributes]).where(F.col(name).isNotNull())


def vocabulary_periods(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, valid_from, valid_to) as dates; blanks are open, what is no date is open too."""
    rows = headered(spark, path, [code, "valid_from", "valid_to"])
    date = lambda c: F.try_to_date(F.nullif(F.trim(c), F.lit("")), "yyyy-MM-dd").alias(c)
    return rows.select(code, date("valid_from"), date("valid_to"))


def entry_vocabulary(spark: SparkSession, path: str, code: str) -> DataFrame:
    """A vocabulary for entry forms: variants as arrays, in order, entries without one last."""
    rows = headered(spark, path, [code, "label_ja", "label_en", "seniority_order", "variants"])
    split = F.filter(F.split(F.coalesce("variants", F.lit("")), "[;|\\s]+"), lambda v: v != "")
    return rows.select(code, "label_ja", "label_en", F.col("seniority_order").try_cast("int").alias("seniority_order"), split.alias("variants")).orderBy(F.asc_nulls_last("seniority_order"), code)


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """Layout templates of a folder of JSON files, thresholds defaulted."""
    raw = spark.read.schema(TEMPLATE_SCHEMA).option("multiLine", True).json(f"{folder}/*.json")
    return raw.select(
        "template_id",
        F.coalesce("tolerance", F.lit(0.015)).alias("tolerance"),
        F.coalesce("min_bands", F.size("bands") - 1).alias("min_bands"),
        F.coalesce("min_explained", F.lit(0.8)).alias("min_explained"),
        F.coalesce("min_columns", F.lit(2)).alias("min_columns"),
        "bands",
        "fields",
    ).orderBy("template_id")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def stripped_rows(df: DataFrame) -> DataFrame:
    """Spreadsheet rows as strings, trimmed; rows of nothing but blanks are left out."""
    texts = df.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns])
    return texts.na.drop("all")


def pdf_path(html: str = "html"):
    """The first PDF path of a page, or null."""
    return F.nullif(F.regexp_extract(html, "(?i)(?:href|src)=[\"']([^\"']+\\.pdf)[\"']", 1), F.lit(""))


def copy_table(spark: SparkSession, reader_options: dict[str, str], target: str) -> None:
    """Bulk copy of one table from a database to columnar files; types carry over."""
    spark.read.format("jdbc").options(**reader_options).load().write.mode("overwrite").parquet(target)

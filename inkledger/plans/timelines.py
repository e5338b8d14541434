"""Registered queries of the time and history operators (no SQL: Unicode folding and zone rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkledger.operators.history import attribute_history
from inkledger.operators.normalise_times import normalise_times
from inkledger.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, field_name, pos, normal of every value that names one day or instant."""
    t = lambda name: table(spark, sf_dir, name)
    return normalise_times(t("observation_in"), t("officers"), t("app_user"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its attributes."""
    t = lambda name: table(spark, sf_dir, name)
    return attribute_history(t("observation"), t("source_volume"), t("kanji_variant"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, valid_from, valid_to of every version."""
    return p5_history(spark, sf_dir).select("person_id", "valid_from", "valid_to")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_history": p5_history}
SQL: dict[str, str] = {}

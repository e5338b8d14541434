"""Text that looks the same brought to one form: script-aware repair against the corpus.

The dominant script of each token is determined; only tokens of mixed script are repaired, by
look-alikes of the scripts they hold, first the script in which the whole token comes out pure.  A repaired token is taken if
the corpus has it as a token of one script (evidence ``word``), else if the corpus has all its
pairs of neighbouring characters that the repair touched (``pairs``), else the first
such script decides (``script``); tokens of one script stay as they are (``none``).  Compatibility forms,
white space, invisible characters and the variant table are dealt with on the way.

Null stays null, blank becomes ''; texts are processed whole; an empty table gives an empty one.
Rows are never compared with each other here: the vocabulary is an aggregate of all tokens, and
only distinct mixed tokens are joined with it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.text import is_mixed, on_distinct, repairs, script_counts, variant_map, visible
from inkledger.session import cut_lineage

_READING = "struct<visible string, plain string, mixed boolean, repaired array<string>>"


def _readings(variants: dict[str, str]):
    table = str.maketrans(variants)

    def reading(text: str) -> tuple:
        seen = visible(text)
        counts = script_counts(seen)
        mixed = is_mixed(seen, counts)
        repaired = list(dict.fromkeys(t.translate(table) for t in repairs(seen)))
        return seen, seen.translate(table), mixed, repaired

    @F.pandas_udf(_READING)
    def read(values: pd.Series) -> pd.DataFrame:
        found = on_distinct(values, reading)
        none = (None, None, None, None)
        return pd.DataFrame([x if x is not None else none for x in found], columns=["visible", "plain", "mixed", "repaired"])

    return read


def _pairs(column):
    """Neighbouring characters of a text."""
    size = F.greatest(F.length(column) - 1, F.lit(0))
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(column, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def unify(df: DataFrame, column: str, kanji_variant: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``df`` with ``form`` and ``evidence``; the vocabulary comes from ``corpus`` (one text
    column of that name) or from ``df`` itself."""
    read = _readings(variant_map(kanji_variant))
    rows = cut_lineage(df.withColumn("_r", read(F.col(column))))  # read once, used in every branch below
    words = (corpus.withColumn("_r", read(F.col(column))) if corpus is not None else rows).select("_r.*")
    lexicon = words.where("NOT mixed AND plain <> ''").groupBy("plain").agg(F.count(F.lit(1)).alias("seen"))
    mixed = words if corpus is None else rows.select("_r.*")
    mixed = mixed.where("mixed").select("visible", "repaired").distinct()
    choices = mixed.select("visible", F.posexplode("repaired").alias("rank", "choice"))
    known = choices.join(lexicon.select(F.col("plain").alias("choice"), "seen"), "choice", "left")
    best = F.struct(F.col("seen").isNull().alias("unseen"), "rank", "choice")
    chosen = known.groupBy("visible").agg(F.min(best).alias("b")).select("visible", "b.unseen", F.col("b.choice").alias("choice"))
    open_ = chosen.where("unseen")
    pairs = lexicon.select(F.explode(_pairs(F.col("plain"))).alias("pair")).distinct()
    touched = F.transform(F.filter(F.sequence(F.lit(1), F.length("choice")), lambda i: F.substring("choice", i, F.lit(1)) != F.substring("visible", i, F.lit(1))), lambda i: i)
    own = open_.where(F.length("choice") == F.length("visible")).select("visible", F.explode(F.array_distinct(F.flatten(F.transform(touched, lambda i: F.array(i - 1, i))))).alias("i"), "choice")
    own = own.where((F.col("i") >= 1) & (F.col("i") < F.length("choice"))).select("visible", F.substring("choice", F.col("i"), F.lit(2)).alias("pair"))
    backed = own.join(pairs.withColumn("known", F.lit(1)), "pair", "left").groupBy("visible").agg((F.count("known") == F.count(F.lit(1))).alias("backed"))
    decided = chosen.join(backed, "visible", "left").select("visible", F.col("choice").alias("_form"), F.when(~F.col("unseen"), "word").when(F.col("backed"), "pairs").otherwise("script").alias("_evidence"))
    keep = [F.col(c) for c in df.columns]
    plain = rows.where("_r IS NULL OR _r.visible IS NULL OR NOT _r.mixed").select(*keep, F.col("_r.plain").alias("form"), F.when(F.col("_r.plain").isNotNull(), "none").alias("evidence"))
    fixed = rows.where("_r.mixed").withColumn("visible", F.col("_r.visible")).join(decided, "visible").select(*keep, F.col("_form").alias("form"), F.col("_evidence").alias("evidence"))
    return plain.unionByName(fixed)


def same_cell_pairs(observation_in: DataFrame, kanji_variant: DataFrame) -> DataFrame:
    """``(obs_id_a, obs_id_b)`` of one roster cell, unequal as stored, equal in consistent form.

    Null and blank names, and rows without a full cell key, have no partner; a row delivered
    twice counts once.  Cells have few readers; a cell that has not is split by the join.
    """
    cell = ["volume_id", "frame_no", "row_index"]
    names = observation_in.select("obs_id", *cell, "name_raw").where("name_raw IS NOT NULL").dropDuplicates(["obs_id"])
    forms = unify(names, "name_raw", kanji_variant).where("form <> ''")
    a = forms.select(F.col("obs_id").alias("obs_id_a"), *cell, "form", F.col("name_raw").alias("raw_a"))
    b = forms.select(F.col("obs_id").alias("obs_id_b"), *cell, "form", F.col("name_raw").alias("raw_b"))
    return a.join(b, [*cell, "form"]).where("obs_id_a < obs_id_b AND raw_a <> raw_b").select("obs_id_a", "obs_id_b")

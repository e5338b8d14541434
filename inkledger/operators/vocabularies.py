"""Controlled vocabularies: resolve, suggest, lint, dated use, bounds and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flag codes that change a cell's audit status.
STRUCTURAL = ("sequence_break", "missing_row", "extra_row")


def alias_table(vocab: DataFrame, code: str) -> DataFrame:
    """(alias, code, priority): labels and codes first, variants second."""
    exact = F.array(F.struct(F.col("label_ja").alias("alias"), F.lit(0).alias("priority")), F.struct(F.col(code).alias("alias"), F.lit(0).alias("priority")))
    variants = F.transform(F.filter(F.transform(F.split(F.coalesce("variants", F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != ""), lambda v: F.struct(v.alias("alias"), F.lit(1).alias("priority")))
    return vocab.select(F.explode(F.concat(exact, variants)).alias("a"), F.col(code).alias("code")).select("a.alias", "code", "a.priority").where("alias IS NOT NULL")


def resolve(df: DataFrame, column: str, vocab: DataFrame, code: str) -> DataFrame:
    """Exact resolution without guessing: code or null; ties go to the smaller code."""
    best = alias_table(vocab, code).groupBy("alias").agg(F.min(F.struct("priority", "code")).alias("b")).select(F.col("alias").alias("_alias"), F.col("b.code").alias("resolved"))
    return df.join(best, F.col(column) == F.col("_alias"), "left").drop("_alias")


def suggest(vocab: DataFrame, code: str, prefixes: DataFrame, most: int = 8) -> DataFrame:
    """First ``most`` entries whose label, code, English label or variant begins with a prefix,
    in vocabulary order; an empty prefix suggests the first ones.  A top-k report."""
    spelt = F.array_compact(F.concat(F.array("label_ja", F.col(code)), F.filter(F.split(F.coalesce("variants", F.lit("")), "[;|\\s]+"), lambda v: v != "")))
    heads = lambda x: F.transform(F.sequence(F.lit(0), F.length(x)), lambda n: F.substr(x, F.lit(1), n))
    keyed = vocab.select(F.col(code).alias("code"), F.coalesce("seniority_order", F.lit(999999)).alias("o"), F.array_distinct(F.flatten(F.transform(spelt, heads))).alias("own"), heads(F.lower(F.coalesce("label_en", F.lit("")))).alias("en"))
    own = keyed.select("code", "o", F.explode("own").alias("prefix"))
    english = keyed.select("code", "o", F.explode("en").alias("_low"))
    asked = prefixes.select("prefix").distinct()
    hits = asked.join(own, "prefix").unionByName(asked.withColumn("_low", F.lower("prefix")).join(english, "_low").drop("_low").select("prefix", "code", "o")).distinct()
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy("o", "code")))
    return ranked.where(F.col("place") <= most).select("prefix", "place", "code")


def out_of_order(vocab: DataFrame, code: str, order: str, place: str) -> DataFrame:
    """Entries whose ``order`` is not greater than that of the entry before, by ``place`` in the list.
    A vocabulary is a small reference table, sorted in one task."""
    before = F.lag(order).over(Window.orderBy(place))
    return vocab.withColumn("_before", before).where(F.col(order) <= F.col("_before")).select(F.lit("order_not_increasing").alias("problem"), F.col(code).alias("detail"))


def lint(vocab: DataFrame, code: str, kind: str, order: tuple[str, str] | None = None) -> DataFrame:
    """(kind, problem, detail): duplicate codes and labels, a variant under two codes, a variant that is
    another entry's label, a validity that ends before it begins and, if ``order`` names the column
    and the place in the list, an order that does not strictly increase."""
    names = alias_table(vocab, code)
    variants, labels = names.where("priority = 1"), vocab.select(F.col("label_ja").alias("alias"), F.col(code).alias("owner"))
    parts = [
        vocab.groupBy(code).count().where("count > 1").select(F.lit("duplicate_code").alias("problem"), F.col(code).alias("detail")),
        variants.groupBy("alias").agg(F.count_distinct("code").alias("n")).where("n > 1").select(F.lit("variant_of_two").alias("problem"), F.col("alias").alias("detail")),
        variants.join(labels, "alias").select(F.lit("variant_is_label").alias("problem"), F.col("alias").alias("detail")),
        vocab.where("valid_to < valid_from").select(F.lit("ends_before_begin").alias("problem"), F.col(code).alias("detail")),
        vocab.groupBy("label_ja").count().where("count > 1").select(F.lit("duplicate_label").alias("problem"), F.col("label_ja").alias("detail")),
    ]
    if order is not None:
        parts.append(out_of_order(vocab, code, *order))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(kind).alias("kind"), "problem", "detail")


def lint_variants(pairs: DataFrame) -> DataFrame:
    """Problems of a character table: self maps, several targets, chains, stray length."""
    a, b = F.col("variant_char"), F.col("canonical_char")
    rows = pairs.select("variant_char", "canonical_char")
    targets = rows.distinct().groupBy("variant_char").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = rows.distinct().join(rows.select(F.col("variant_char").alias("canonical_char")).distinct(), "canonical_char", "left_semi")
    parts = [
        rows.where(a == b).select(F.lit("self_map").alias("problem"), a.alias("detail")),
        targets.select(F.lit("two_targets").alias("problem"), a.alias("detail")),
        chained.select(F.lit("chain").alias("problem"), a.alias("detail")),
        rows.where((F.length(a) != 1) | (F.length(b) != 1)).select(F.lit("not_one_character").alias("problem"), a.alias("detail")),
        rows.groupBy("variant_char", "canonical_char").count().where("count > 1").select(F.lit("repeated_row").alias("problem"), a.alias("detail")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_period(day: Column, first: Column, last: Column) -> Column:
    """Closed period; a missing bound is open."""
    return (first.isNull() | (day >= first)) & (last.isNull() | (day <= last))


def out_of_period(df: DataFrame, code: str, day: str, vocab: DataFrame, flag: str) -> DataFrame:
    """Flags for codes used outside their period; unknown and null codes pass."""
    dated = vocab.select(code, "valid_from", "valid_to").where("valid_from IS NOT NULL OR valid_to IS NOT NULL")
    return df.join(dated, code).where(F.col(day).isNotNull() & ~in_period(F.col(day), F.col("valid_from"), F.col("valid_to"))).select("cell_id", "page_id", F.lit(flag).alias("code"), F.concat_ws(" ", F.col(code), F.col(day)).alias("detail"))


def out_of_bounds(df: DataFrame, date: str, day: str, earliest: str = "1868-01-01") -> DataFrame:
    """Dates before the era of the record or after the edition that shows them."""
    early, late = F.col(date) < earliest, F.col(date) > F.col(day)
    return df.where(early | late).select("cell_id", "page_id", F.lit("date_out_of_bounds").alias("code"), F.col(date).alias("detail"))


def engine_disagreement(readings: DataFrame, value: str) -> DataFrame:
    """Cells whose machine readings disagree with what a person read: rows of agreement status (cell_id,
    page_id, status) as flags."""
    rows = readings.where(F.col(value) == "disagree").select("cell_id", "page_id").distinct()
    return rows.select("cell_id", "page_id", F.lit("engine_disagreement").alias("code"), F.lit("machine readings disagree").alias("detail"))


def audit_status(code: Column) -> Column:
    """Status a flag gives its cell; vocabulary flags are queued but leave it alone."""
    return F.when(code.isin(*STRUCTURAL), code)


def validate(parts: list[DataFrame]) -> DataFrame:
    """All flags with the order of their check; flags describe, they never change a datum."""
    out = None
    for at, part in enumerate(parts, 1):
        part = part.select(F.lit(at).alias("check_order"), "cell_id", "page_id", "code", "detail", audit_status(F.col("code")).alias("audit_status"))
        out = part if out is None else out.unionByName(part)
    return out


def review_queue(flags: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """One new task for each flagged cell that has none open."""
    return flags.select("cell_id").distinct().join(open_tasks, "cell_id", "left_anti")

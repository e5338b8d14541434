"""Registered queries of the vocabulary and validation operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.operators import records as R
from inkledger.operators import sequences as S
from inkledger.operators import vocabularies as V
from inkledger.session import table


def vocab_resolve(spark, sf):
    rows = table(spark, sf, "observation_in").select("obs_id", F.trim("rank_code").alias("typed")).distinct()
    return V.resolve(rows, "typed", table(spark, sf, "rank_vocab"), "rank_code")


def vocab_suggest(spark, sf):
    prefixes = table(spark, sf, "observation_in").select(F.substring(F.trim("rank_code"), 1, 1).alias("prefix")).where("prefix IS NOT NULL").distinct()
    return V.suggest(table(spark, sf, "rank_vocab"), "rank_code", prefixes)


def vocab_lint(spark, sf):
    t = lambda n: table(spark, sf, n)
    return V.lint(t("rank_vocab"), "rank_code", "rank", ("seniority_order", "rank_code")).unionByName(V.lint(t("branch_vocab"), "branch_code", "branch"))


def variant_lint(spark, sf):
    return V.lint_variants(table(spark, sf, "kanji_variant"))


def _cells(spark, sf):
    rows = table(spark, sf, "observation").select("cell_id", "page_id", "rank_code", "branch_code", "seniority_no", "commissioning_date", "as_of_date", "created_at", "obs_id")
    return R.cell_parts(R.last_by(rows, ["cell_id", "page_id"], ["created_at", "obs_id"]))


def dated_vocab(spark, sf):
    rows = _cells(spark, sf)
    branch = V.out_of_period(rows, "branch_code", "as_of_date", table(spark, sf, "branch_vocab"), "branch_out_of_period")
    return branch.unionByName(V.out_of_period(rows, "rank_code", "as_of_date", table(spark, sf, "rank_vocab"), "rank_out_of_period"))


def bounded_dates(spark, sf):
    return V.out_of_bounds(_cells(spark, sf), "commissioning_date", "as_of_date")


def validate_all(spark, sf):
    rows = _cells(spark, sf)
    broken = S.sequence_breaks(rows, ["page_id"], ["row_index"], "seniority_no").select("cell_id", "page_id", F.lit("sequence_break").alias("code"), F.concat(F.col("seniority_no").cast("string"), F.lit(" after "), F.col("previous").cast("string")).alias("detail"))
    n = F.col("n")
    counted = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("cell_id", "row_index").alias("cell_id")).where("n <> 20").select("cell_id", "page_id", F.when(n < 20, "missing_row").otherwise("extra_row").alias("code"), F.concat(n.cast("string"), F.lit(" of 20")).alias("detail"))
    # Engines: what was propagated from another reading against what was entered for the cell.
    source = table(spark, sf, "observation").select(F.col("obs_id").alias("propagated_from"), F.col("rank_code").alias("other")).distinct()
    engines = table(spark, sf, "observation").select("cell_id", "page_id", "propagated_from", "rank_code").join(source, "propagated_from")
    status = engines.select("cell_id", "page_id", F.when(F.col("other") == F.col("rank_code"), "agree").otherwise("disagree").alias("agree_status"))
    return V.validate([broken, counted, dated_vocab(spark, sf), bounded_dates(spark, sf), V.engine_disagreement(status, "agree_status")])


def queue_antijoin(spark, sf):
    open_tasks = table(spark, sf, "observation").where("status = 'flagged'").select("cell_id").distinct()
    return V.review_queue(validate_all(spark, sf), open_tasks)


QUERIES = {f.__name__: f for f in (vocab_resolve, vocab_suggest, vocab_lint, variant_lint, dated_vocab, bounded_dates, validate_all, queue_antijoin)}


def _aliases(vocab: str, code: str) -> str:
    return f"""SELECT label_ja AS alias, {code} AS code, 0 AS priority FROM {vocab} UNION ALL SELECT {code}, {code}, 0 FROM {vocab}
 UNION ALL SELECT trim(v), code, 1 FROM (SELECT unnest(string_split(coalesce(variants, ''), ';')) AS v, {code} AS code FROM {vocab}) x WHERE trim(v) <> ''"""


def _lint(vocab: str, code: str, kind: str) -> str:
    a = _aliases(vocab, code)
    return f"""SELECT '{kind}' AS kind, 'duplicate_code' AS problem, {code} AS detail FROM {vocab} GROUP BY {code} HAVING count(*) > 1
 UNION ALL SELECT '{kind}', 'variant_of_two', alias FROM ({a}) a WHERE priority = 1 GROUP BY alias HAVING count(DISTINCT code) > 1
 UNION ALL SELECT '{kind}', 'variant_is_label', a.alias FROM ({a}) a JOIN {vocab} v ON v.label_ja = a.alias WHERE priority = 1
 UNION ALL SELECT '{kind}', 'ends_before_begin', {code} FROM {vocab} WHERE valid_to < valid_from
 UNION ALL SELECT '{kind}', 'duplicate_label', label_ja FROM {vocab} GROUP BY label_ja HAVING count(*) > 1"""


_ORDER = "SELECT 'rank' AS kind, 'order_not_increasing' AS problem, rank_code AS detail FROM (SELECT rank_code, seniority_order, lag(seniority_order) OVER (ORDER BY rank_code) AS before FROM rank_vocab) x WHERE seniority_order <= before"

_CELLS = """SELECT * FROM (SELECT *, CAST(split_part(cell_id, ':', 3) AS INTEGER) AS row_index, row_number() OVER (PARTITION BY cell_id, page_id ORDER BY created_at DESC, obs_id DESC) AS n_ FROM observation) q WHERE n_ = 1"""
_PERIOD = "SELECT c.cell_id, c.page_id, '{0}_out_of_period' AS code, concat_ws(' ', c.{0}_code, as_of_date) AS detail FROM ({1}) c JOIN {0}_vocab v USING ({0}_code) WHERE as_of_date < valid_from OR as_of_date > valid_to"
_DATED = _PERIOD.format("branch", _CELLS) + " UNION ALL " + _PERIOD.format("rank", _CELLS)
_BOUNDS = f"SELECT cell_id, page_id, 'date_out_of_bounds' AS code, commissioning_date AS detail FROM ({_CELLS}) c WHERE commissioning_date < '1868-01-01' OR commissioning_date > as_of_date"
_ALL = f"""SELECT 1 AS check_order, cell_id, page_id, 'sequence_break' AS code, seniority_no || ' after ' || previous AS detail, 'sequence_break' AS audit_status FROM (SELECT *, last_value(seniority_no IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ({_CELLS}) c) s WHERE seniority_no <= previous
 UNION ALL SELECT 2, arg_max(cell_id, row_index), page_id, CASE WHEN count(*) < 20 THEN 'missing_row' ELSE 'extra_row' END, count(*) || ' of 20', CASE WHEN count(*) < 20 THEN 'missing_row' ELSE 'extra_row' END FROM ({_CELLS}) c GROUP BY page_id HAVING count(*) <> 20
 UNION ALL SELECT 3, *, NULL FROM ({_DATED}) d UNION ALL SELECT 4, *, NULL FROM ({_BOUNDS}) b
 UNION ALL SELECT DISTINCT 5, a.cell_id, a.page_id, 'engine_disagreement', 'machine readings disagree', NULL FROM observation a JOIN observation b ON b.obs_id = a.propagated_from WHERE (a.rank_code = b.rank_code) IS NOT TRUE"""

SQL = {
    "vocab_resolve": f"""SELECT o.obs_id, o.typed, a.code AS resolved FROM (SELECT DISTINCT obs_id, trim(rank_code, ' ') AS typed FROM observation_in) o
 LEFT JOIN (SELECT alias, code FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority, code) AS k FROM ({_aliases("rank_vocab", "rank_code")}) x) y WHERE k = 1) a ON o.typed = a.alias""",
    "vocab_suggest": """SELECT prefix, place, rank_code AS code FROM (SELECT prefix, rank_code, row_number() OVER (PARTITION BY prefix ORDER BY coalesce(seniority_order, 999999), rank_code) AS place
 FROM (SELECT DISTINCT substr(trim(rank_code, ' '), 1, 1) AS prefix FROM observation_in WHERE rank_code IS NOT NULL) p JOIN rank_vocab v
 ON starts_with(label_ja, prefix) OR starts_with(rank_code, prefix) OR starts_with(lower(label_en), lower(prefix)) OR len(list_filter(string_split_regex(coalesce(variants, ''), '[;|\\s]+'), lambda x: x <> '' AND starts_with(x, prefix))) > 0) s WHERE place <= 8""",
    "vocab_lint": _lint("rank_vocab", "rank_code", "rank") + " UNION ALL " + _ORDER + " UNION ALL " + _lint("branch_vocab", "branch_code", "branch"),
    "variant_lint": """SELECT 'self_map' AS problem, variant_char AS detail FROM kanji_variant WHERE variant_char = canonical_char
 UNION ALL SELECT 'two_targets', variant_char FROM kanji_variant GROUP BY variant_char HAVING count(DISTINCT canonical_char) > 1
 UNION ALL SELECT 'chain', variant_char FROM (SELECT DISTINCT variant_char, canonical_char FROM kanji_variant) k WHERE canonical_char IN (SELECT variant_char FROM kanji_variant)
 UNION ALL SELECT 'not_one_character', variant_char FROM kanji_variant WHERE length(variant_char) <> 1 OR length(canonical_char) <> 1
 UNION ALL SELECT 'repeated_row', variant_char FROM kanji_variant GROUP BY variant_char, canonical_char HAVING count(*) > 1""",
    "dated_vocab": _DATED,
    "bounded_dates": _BOUNDS,
    "validate_all": _ALL,
    "queue_antijoin": f"SELECT DISTINCT cell_id FROM ({_ALL}) f WHERE cell_id NOT IN (SELECT cell_id FROM observation WHERE status = 'flagged' AND cell_id IS NOT NULL)",
}

"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm.canonical_values import map_free_values
from inkledger.llm.consensus import annotators, consensus, krippendorff
from inkledger.llm.containers import fill_containers
from inkledger.llm.entity_graph import same_people
from inkledger.llm.name_variants import variant_pairs
from inkledger.llm.pieces import split_oversized
from inkledger.llm.tokens import encode_corpus, read_tokenizer
from inkledger.llm.unify_characters import same_cell_pairs
from inkledger.session import table


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_people(*(table(spark, sf_dir, t) for t in ("observation_in", "officers", "branch_vocab", "kanji_variant")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_links(spark, sf_dir).select("obs_id", "officer_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_cell_pairs(table(spark, sf_dir, "observation_in"), table(spark, sf_dir, "kanji_variant"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_free_values(*(table(spark, sf_dir, t) for t in ("observation_in", "rank_vocab", "branch_vocab", "kanji_variant")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(*(table(spark, sf_dir, t) for t in ("observation_in", "officers", "branch_vocab", "kanji_variant")))


def p7_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "cell_label"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_consensus(spark, sf_dir).select("cell_id", "field_name", "consensus")


def p7_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators(table(spark, sf_dir, "cell_label"))


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return krippendorff(table(spark, sf_dir, "cell_label")).withColumn("alpha", F.round("alpha", 6))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), read_tokenizer())


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"), read_tokenizer())


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), read_tokenizer())


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p3_found, p6_found, p7_found, p7_consensus, p7_readers, p7_agreement, p8_ids, p9_containers, p10_pieces)}
SQL: dict[str, str] = {
    "p7_agreement": """
WITH v AS (
  SELECT DISTINCT cell_id, user_id, f AS field_name, x AS value FROM (
    SELECT cell_id, user_id, 'name_raw' AS f, name_raw AS x FROM cell_label
    UNION ALL SELECT cell_id, user_id, 'seniority_no', CAST(seniority_no AS VARCHAR) FROM cell_label
    UNION ALL SELECT cell_id, user_id, 'commissioning_date', commissioning_date FROM cell_label) s
  WHERE x IS NOT NULL AND cell_id IS NOT NULL),
c AS (SELECT field_name, cell_id, value, count(*) AS n FROM v GROUP BY ALL),
u AS (SELECT field_name, cell_id, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT field_name, sum(m) AS n_labels, sum((m * m - sq) / CAST(m - 1 AS DOUBLE)) AS apart FROM u GROUP BY ALL),
t AS (SELECT field_name, sum(n * n) AS sq FROM (
        SELECT c.field_name, c.value, sum(c.n) AS n FROM c JOIN u USING (field_name, cell_id) GROUP BY ALL) s GROUP BY ALL)
SELECT field_name, CAST(n_labels AS BIGINT) AS n_labels,
       round(1 - apart / ((n_labels * n_labels - t.sq) / CAST(n_labels - 1 AS DOUBLE)), 6) AS alpha
FROM o JOIN t USING (field_name)""",
}

"""Queries do the whole job: made-up tables on which a left-out row shows, and SQL without cuts."""

from __future__ import annotations

import datetime

import pytest
from conftest import SMALL
from oracle import differences
from pyspark.sql import functions as F

from inkledger.functions import readings as T
from inkledger.operators import matching as M
from inkledger.plans import geometry as GP
from inkledger.plans import planned as PP
from inkledger.plans import texts as TP

_POSTINGS = "SELECT unit_id, person_id, min(CAST(as_of_date AS DATE)) - DATE '1970-01-01' AS s, max(CAST(as_of_date AS DATE)) - DATE '1970-01-01' AS e FROM observation WHERE person_id IS NOT NULL AND unit_id IS NOT NULL GROUP BY ALL"


def test_unit_overlap_of_every_two_persons(spark, tmp_path):
    rows = [("u", "p2", "1911-10-01"), ("u", "p2", "1912-10-01"), ("u", "p4", "1912-10-01"), ("u", "p3", "1911-10-01"), ("u", "p5", "1911-10-01"), ("u", "p5", "1912-10-01"), ("v", "p2", "1911-10-01"), ("v", "p6", "1911-10-01")]
    spark.createDataFrame(rows, "unit_id string, person_id string, as_of_date string").write.parquet(f"{tmp_path}/observation.parquet")
    got = {r.unit_id: (r.pairs, r.days) for r in PP.unit_overlap(spark, str(tmp_path)).collect()}
    assert got == {"u": (5, 366), "v": (1, 0)}  # all of u but p3 with p4


def test_unit_overlap_like_a_full_join(spark):
    sql = f"SELECT a.unit_id, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS days FROM ({_POSTINGS}) a JOIN ({_POSTINGS}) b ON a.unit_id = b.unit_id AND a.person_id < b.person_id AND a.s <= b.e AND b.s <= a.e GROUP BY a.unit_id"
    assert differences(spark, SMALL, PP.unit_overlap, sql) == ""


def test_reading_order_places_every_box(spark, tmp_path):
    rows = [(1, 0, [0.1, 0.0]), (2, 0, [0.3, 0.0]), (5, 0, [0.2, 0.0]), (7, 1, [0.1, 0.0])]
    spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.place for r in GP.reading_order(spark, str(tmp_path)).collect()}
    assert got == {2: 0, 5: 1, 1: 2, 7: 0}


def test_reading_order_like_sql_over_all_boxes(spark):
    sql = f"SELECT vec_id, panel, CAST(row_number() OVER (PARTITION BY panel ORDER BY x DESC, vec_id) - 1 AS INTEGER) AS place FROM ({GP._BOX}) b"
    assert differences(spark, SMALL, GP.reading_order, sql) == ""


def test_column_edges_from_every_order(spark, tmp_path):
    days = [10003, 10014, 10025, 10037, 10058, 10069]  # of the grid lines from 10000 to 10060, that at 10040 has none
    rows = [(5, datetime.datetime(1970, 1, 1) + datetime.timedelta(d)) for d in days]
    spark.createDataFrame(rows, "o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in GP.column_edges(spark, str(tmp_path)).collect()] == [("5", 7, 1, 10000.0, 10060.0)]


def test_every_order_becomes_a_line(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert GP._vertical(spark, SMALL).count() == orders.count()


def _levenshtein(a, b):
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


@pytest.mark.parametrize("score", [T.similarity, _levenshtein])
def test_lexicon_scores_entries_without_a_common_pair(spark, score):
    names = ["富永政", "山本一二三", "黒田重徳"]
    lexicon = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entry string, ordinal int")
    readings = spark.createDataFrame([("富水政",), ("山木一仁三",), ("石原徳",), ("\u3000",), ("東京",)], "reading string")
    got = {r.reading: (r.status, r.best) for r in M.suggestions(M.lexicon_matches(readings, lexicon, score), readings).collect()}
    assert got["富水政"] == ("AMBIGUOUS", "富永政") and got["山木一仁三"] == ("AMBIGUOUS", "山本一二三")
    assert got["石原徳"][0] == "NO_MATCH" and (got["石原徳"][1] == "黒田重徳" or score is _levenshtein)
    assert got["\u3000"] == got["東京"] == ("NO_MATCH", None)


def test_lexicon_in_blocks_and_shards_meets_every_pair_once(spark):
    lexicon = spark.createDataFrame([(f"e{i}", i) for i in range(30)], "entry string, ordinal int")
    readings = spark.createDataFrame([(f"r{i % 20}",) for i in range(40)], "reading string")
    pairs = M.lexicon_matches(readings, lexicon, _levenshtein, shard_size=7, block_size=3)
    assert pairs.count() == pairs.select("reading", "ordinal").distinct().count() == 600


def test_lexicon_suggest_lev_like_a_full_scan(spark):
    sql = """WITH l AS (SELECT p_name AS entry, min(p_partkey) AS ordinal FROM part GROUP BY p_name), r AS (SELECT DISTINCT substr(entry, 1, 3) || substr(entry, 5, 50) AS reading FROM l),
 m AS (SELECT reading, entry, 1 - levenshtein(reading, entry) / CAST(greatest(length(reading), length(entry)) AS DOUBLE) AS score, ordinal FROM r, l),
 k AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY score DESC, ordinal) AS place FROM m),
 t AS (SELECT reading, max(entry) FILTER (place = 1) AS best, max(score) FILTER (place = 1) AS b, max(score) FILTER (place = 2) AS u FROM k GROUP BY reading)
 SELECT reading, best, round(b, 4) AS best_score, round(b - coalesce(u, 0), 4) AS margin, CASE WHEN b >= 0.9 AND b - coalesce(u, 0) >= 0.15 THEN 'PROBABLE' WHEN b >= 0.6 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status FROM t"""
    assert differences(spark, SMALL, TP.lexicon_suggest_lev, sql) == ""


_CHANGES = """WITH e AS (SELECT edition_date, lead(edition_date) OVER (ORDER BY edition_date) AS following FROM (SELECT DISTINCT edition_date FROM source_volume WHERE series = 'retsuji' AND edition_date IS NOT NULL) d),
 l AS (SELECT person_id, as_of_date, rank_code FROM (SELECT *, row_number() OVER (PARTITION BY person_id, as_of_date ORDER BY created_at DESC, obs_id DESC) AS n FROM observation WHERE person_id IS NOT NULL) q WHERE n = 1),
 k AS (SELECT DISTINCT person_id, edition_date AS since, following AS until FROM l JOIN e ON as_of_date IN (edition_date, following) WHERE following IS NOT NULL)
 SELECT k.person_id, since, until, a.rank_code AS rank_code_old, b.rank_code AS rank_code_new, CASE WHEN a.person_id IS NULL THEN 'appeared' WHEN b.person_id IS NULL THEN 'disappeared' WHEN a.rank_code IS NOT DISTINCT FROM b.rank_code THEN 'same'
 WHEN rb.seniority_order > ra.seniority_order THEN 'promoted' WHEN rb.seniority_order < ra.seniority_order THEN 'demoted' ELSE 'changed' END AS change
 FROM k LEFT JOIN l a ON a.person_id = k.person_id AND a.as_of_date = since LEFT JOIN l b ON b.person_id = k.person_id AND b.as_of_date = until LEFT JOIN rank_vocab ra ON ra.rank_code = a.rank_code LEFT JOIN rank_vocab rb ON rb.rank_code = b.rank_code"""


def test_propagation_diff_of_every_step(spark, tmp_path):
    volumes = [("retsuji", "1911-10-01"), ("retsuji", "1912-10-01"), ("retsuji", "1913-06-15"), ("teinen", "1912-01-01")]
    readings = [(1, "p", "1911-10-01", "b"), (2, "p", "1912-10-01", "a"), (3, "q", "1912-10-01", "b"), (4, "q", "1913-06-15", "b"), (5, "r", "1911-10-01", "b"), (6, "r", "1913-06-15", "b")]
    spark.createDataFrame(volumes, "series string, edition_date string").write.parquet(f"{tmp_path}/source_volume.parquet")
    spark.createDataFrame([("a", 2), ("b", 1)], "rank_code string, seniority_order int").write.parquet(f"{tmp_path}/rank_vocab.parquet")
    spark.createDataFrame(readings, "obs_id bigint, person_id string, as_of_date string, rank_code string").withColumn("created_at", F.timestamp_seconds("obs_id")).write.parquet(f"{tmp_path}/observation.parquet")
    got = {(r.person_id, r.since, r.until): r.change for r in PP.propagation_diff(spark, str(tmp_path)).collect()}
    first, second = ("1911-10-01", "1912-10-01"), ("1912-10-01", "1913-06-15")
    assert got == {("p", *first): "promoted", ("p", *second): "disappeared", ("q", *first): "appeared", ("q", *second): "same", ("r", *first): "disappeared", ("r", *second): "appeared"}


def test_propagation_diff_like_sql_over_every_step(spark):
    assert differences(spark, SMALL, PP.propagation_diff, _CHANGES) == ""

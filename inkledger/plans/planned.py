"""Registered queries of the planned operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.operators import planned as P
from inkledger.operators import records as R
from inkledger.operators.history import edition_calendar
from inkledger.session import table


def _postings(spark, sf):
    """Stretches of a person in a unit, from first to last edition seen there."""
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL AND unit_id IS NOT NULL")
    day = F.unix_date(F.col("as_of_date").cast("date"))
    return rows.groupBy("unit_id", "person_id").agg(F.min(day).alias("since"), F.max(day).alias("until"))


def unit_overlap(spark, sf):
    return P.overlap_totals(_postings(spark, sf), "unit_id", "since", "until")


def linkage_bands(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("cb"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("sb"))
    same_nation = F.col("c_nationkey") == F.col("s_nationkey")
    near, ending = F.col("cb") == F.col("sb"), F.col("c_custkey") % 97 == F.col("s_suppkey") % 97
    both = c.join(s, same_nation & near).unionByName(c.join(s, same_nation & ending)).distinct()
    score = P.linkage_score([(near, 4.0, 1.0), (ending, 2.0, 0.5)])
    return both.groupBy("c_nationkey", P.linkage_band(score, 5.0, 1.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _snapshots(spark, sf):
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL").select("person_id", "as_of_date", "rank_code", "created_at", "obs_id")
    last = R.last_by(rows, ["person_id", "as_of_date"], ["created_at", "obs_id"])
    return last.join(table(spark, sf, "rank_vocab").select("rank_code", "seniority_order"), "rank_code", "left").select("person_id", F.col("as_of_date").alias("at"), F.col("seniority_order").alias("value"))


def event_reconcile(spark, sf):
    events = table(spark, sf, "observation").where("person_id IS NOT NULL AND commissioning_date IS NOT NULL").select("person_id", F.add_months(F.col("commissioning_date").cast("date"), 120).cast("string").alias("at")).distinct()
    return P.reconciled(events, _snapshots(spark, sf), "person_id").select("person_id", "at", "since", "until", "before", "after")


def rank_regressions(spark, sf):
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("person_id").orderBy("at"))
    return _snapshots(spark, sf).withColumn("before", before).where("value < before")


def propagation_diff(spark, sf):
    """Changes from every edition of the retsuji series to the next."""
    calendar = edition_calendar(table(spark, sf, "source_volume"), "retsuji")
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL").select("person_id", "as_of_date", "rank_code", "created_at", "obs_id")
    last = R.last_by(rows, ["person_id", "as_of_date"], ["created_at", "obs_id"]).join(F.broadcast(calendar), "as_of_date")
    older = last.withColumn("step", F.col("edition"))
    newer = last.withColumn("step", F.col("edition") - 1)
    since, until = calendar.select(F.col("edition").alias("step"), F.col("as_of_date").alias("since")), calendar.select((F.col("edition") - 1).alias("step"), F.col("as_of_date").alias("until"))
    order = table(spark, sf, "rank_vocab").select("rank_code", F.col("seniority_order").alias("place"))
    changes = P.edition_changes(older, newer, ["person_id", "step"], "rank_code", order)
    # the first edition has none before it and the last none after it
    return changes.join(F.broadcast(since.join(until, "step")), "step").select("person_id", "since", "until", "rank_code_old", "rank_code_new", "change")


def quality_metrics(spark, sf):
    return P.throughput(table(spark, sf, "observation"))


QUERIES = {f.__name__: f for f in (unit_overlap, linkage_bands, event_reconcile, rank_regressions, propagation_diff, quality_metrics)}

_P = "SELECT unit_id, person_id, min(CAST(as_of_date AS DATE)) - DATE '1970-01-01' AS s, max(CAST(as_of_date AS DATE)) - DATE '1970-01-01' AS e FROM observation WHERE person_id IS NOT NULL AND unit_id IS NOT NULL GROUP BY ALL"
_LAST = "SELECT * FROM (SELECT person_id, as_of_date, rank_code, row_number() OVER (PARTITION BY person_id, as_of_date ORDER BY created_at DESC, obs_id DESC) AS n FROM observation WHERE person_id IS NOT NULL) q WHERE n = 1"
_SNAP = f"SELECT person_id, as_of_date AS \"at\", seniority_order AS value FROM ({_LAST}) l LEFT JOIN rank_vocab r USING (rank_code)"
SQL = {
    "unit_overlap": f"""SELECT a.unit_id, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS days FROM ({_P}) a JOIN ({_P}) b ON a.unit_id = b.unit_id AND a.person_id < b.person_id AND a.s <= b.e AND b.s <= a.e GROUP BY a.unit_id""",
    "linkage_bands": """SELECT c_nationkey, CASE WHEN s >= 5 THEN 'link' WHEN s >= 1 THEN 'review' ELSE 'no_link' END AS band, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN floor(c_acctbal / 1000) = floor(s_acctbal / 1000) THEN 4.0 ELSE -1.0 END + CASE WHEN c_custkey % 97 = s_suppkey % 97 THEN 2.0 ELSE -0.5 END AS s
 FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (floor(c_acctbal / 1000) = floor(s_acctbal / 1000) OR c_custkey % 97 = s_suppkey % 97)) x GROUP BY ALL""",
    "event_reconcile": f"""SELECT e.person_id, e."at", since, until, before, after FROM (SELECT DISTINCT person_id, CAST(CAST(CAST(commissioning_date AS DATE) + INTERVAL 120 MONTH AS DATE) AS VARCHAR) AS "at" FROM observation WHERE person_id IS NOT NULL AND commissioning_date IS NOT NULL) e
 JOIN (SELECT person_id, "at" AS since, lead("at") OVER w AS until, value AS before, lead(value) OVER w AS after FROM ({_SNAP}) s WINDOW w AS (PARTITION BY person_id ORDER BY "at")) p ON e.person_id = p.person_id AND until IS NOT NULL AND e."at" > since AND e."at" <= until""",
    "rank_regressions": f"SELECT * FROM (SELECT person_id, \"at\", value, lag(value) OVER (PARTITION BY person_id ORDER BY \"at\") AS before FROM ({_SNAP}) s) x WHERE value < before",
    "propagation_diff": f"""WITH e AS (SELECT edition_date, lead(edition_date) OVER (ORDER BY edition_date) AS following FROM (SELECT DISTINCT edition_date FROM source_volume WHERE series = 'retsuji' AND edition_date IS NOT NULL) d), l AS ({_LAST}),
 k AS (SELECT DISTINCT person_id, edition_date AS since, following AS until FROM l JOIN e ON as_of_date IN (edition_date, following) WHERE following IS NOT NULL)
 SELECT k.person_id, since, until, a.rank_code AS rank_code_old, b.rank_code AS rank_code_new, CASE WHEN a.person_id IS NULL THEN 'appeared' WHEN b.person_id IS NULL THEN 'disappeared' WHEN a.rank_code IS NOT DISTINCT FROM b.rank_code THEN 'same'
 WHEN rb.seniority_order > ra.seniority_order THEN 'promoted' WHEN rb.seniority_order < ra.seniority_order THEN 'demoted' ELSE 'changed' END AS change
 FROM k LEFT JOIN l a ON a.person_id = k.person_id AND a.as_of_date = since LEFT JOIN l b ON b.person_id = k.person_id AND b.as_of_date = until LEFT JOIN rank_vocab ra ON ra.rank_code = a.rank_code LEFT JOIN rank_vocab rb ON rb.rank_code = b.rank_code""",
    "quality_metrics": """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS readings, count(DISTINCT author_user_id) AS readers, round(count(*) FILTER (status = 'flagged') / CAST(count(*) AS DOUBLE), 6) AS flag_rate,
 round(count(person_id) / CAST(count(*) AS DOUBLE), 6) AS link_rate, count(DISTINCT page_id) AS pages FROM observation GROUP BY 1""",
}

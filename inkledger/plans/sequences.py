"""Registered queries of the sequence operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.operators import records as R
from inkledger.operators import sequences as S
from inkledger.session import table


def pages(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row for each roster row of a page, the reading created last, with the named columns
    only: what is packed to pick the row cannot be pruned afterwards."""
    rows = R.cell_parts(table(spark, sf, "observation")).select("page_id", "row_index", *columns, "created_at", "obs_id")
    return R.last_by(rows, ["page_id", "row_index"], ["created_at", "obs_id"])


def sequence_breaks(spark, sf):
    return S.sequence_breaks(pages(spark, sf, "seniority_no"), ["page_id"], ["row_index"], "seniority_no").select("page_id", "row_index", "seniority_no", "previous")


def sequence_audit(spark, sf):
    return S.sequence_audit(pages(spark, sf, "seniority_no"), ["page_id"], ["row_index"], "seniority_no", 20)


def gap_clusters(spark, sf):
    return S.gap_clusters(pages(spark, sf, "seniority_no"), ["page_id"], "seniority_no", "row_index", 60, 5).groupBy("page_id").agg(F.max("cluster").alias("columns"), F.count(F.lit(1)).alias("boxes"))


def line_clusters(spark, sf):
    return S.cluster_positions(S.gap_clusters(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey", 1), ["p_brand"], "p_size")


def _order_days(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))


def longest_regular_run(spark, sf):
    return S.longest_regular_run(_order_days(spark, sf), ["o_custkey"], "day", "o_orderkey")


def gap_fill(spark, sf):
    return S.fill_gaps(pages(spark, sf, "seniority_no"), ["page_id"], "seniority_no", 12)


def truncated_repair(spark, sf):
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("sheet"), "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.substring(F.col("o_orderkey").cast("string"), 2, 20)).otherwise(F.col("o_orderkey").cast("string")).alias("reading"))
    return S.repaired_numbers(rows, ["sheet"], ["o_orderkey"], "reading", "o_orderkey")


def carry_forward(spark, sf):
    rows = pages(spark, sf, "rank_code", "branch_code").withColumn("rank_code", F.when(F.col("row_index") % 3 != 0, "").otherwise(F.col("rank_code"))).withColumn("branch_code", F.when(F.col("row_index") % 2 != 0, F.lit(None)).otherwise(F.col("branch_code")))
    return S.carried_forward(rows, ["page_id"], ["row_index"], ["rank_code", "branch_code"]).select("page_id", "row_index", "rank_code_carried", "branch_code_carried")


def next_unread(spark, sf):
    rows = table(spark, sf, "observation_in").select("volume_id", "frame_no")
    return S.next_unread(rows, ["volume_id"], "frame_no")


def page_number_model(spark, sf):
    anchors = pages(spark, sf, "volume_id", "frame_no", "seniority_no").where("seniority_no IS NOT NULL").groupBy("volume_id", "frame_no").agg(F.min("seniority_no").cast("double").alias("page"))
    return S.page_number_model(anchors, ["volume_id"], "frame_no", "page")


def longest_reading_days(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return S.gap_clusters(rows, ["user_id"], "at", "event_id", 3600).groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("seconds"))


QUERIES = {f.__name__: f for f in (sequence_breaks, sequence_audit, gap_clusters, line_clusters, longest_regular_run, gap_fill, truncated_repair, carry_forward, next_unread, page_number_model, longest_reading_days)}

_PAGES = """SELECT * FROM (SELECT page_id, CAST(split_part(cell_id, ':', 3) AS INTEGER) AS row_index, split_part(cell_id, ':', 1) AS volume_id, CAST(split_part(cell_id, ':', 2) AS INTEGER) AS frame_no,
 seniority_no, rank_code, branch_code, row_number() OVER (PARTITION BY page_id, CAST(split_part(cell_id, ':', 3) AS INTEGER) ORDER BY created_at DESC, obs_id DESC) AS n FROM observation) q WHERE n = 1"""
_BREAKS = f"SELECT *, last_value(seniority_no IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ({_PAGES}) p"

SQL = {
    "sequence_breaks": f"SELECT page_id, row_index, seniority_no, previous FROM ({_BREAKS}) b WHERE seniority_no <= previous",
    "sequence_audit": f"""SELECT page_id, count(*) AS n, count(seniority_no) AS n_with_value, coalesce(string_agg(b, ';' ORDER BY row_index), '') = '' AS monotone_ok, coalesce(string_agg(b, ';' ORDER BY row_index), '') AS breaks,
 CASE WHEN count(*) < 20 THEN 'missing_row' WHEN count(*) > 20 THEN 'extra_row' END AS row_check
 FROM (SELECT *, CASE WHEN seniority_no <= previous THEN previous || '>' || seniority_no END AS b FROM ({_BREAKS}) s) t GROUP BY page_id""",
    "gap_clusters": f"""SELECT page_id, CAST(sum(g) + 1 AS BIGINT) AS "columns", count(*) AS boxes FROM (SELECT page_id, CASE WHEN seniority_no - lag(seniority_no) OVER (PARTITION BY page_id ORDER BY seniority_no, row_index) > 60 THEN 1 ELSE 0 END AS g
 FROM ({_PAGES}) p WHERE seniority_no IS NOT NULL) s GROUP BY page_id HAVING count(*) >= 5""",
    "line_clusters": """SELECT p_brand, cluster, CAST(floor(avg(p_size)) AS BIGINT) AS position, count(*) AS n FROM (SELECT p_brand, p_size, CAST(sum(g) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS cluster
 FROM (SELECT *, CASE WHEN p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) > 1 THEN 1 ELSE 0 END AS g FROM part) a) b GROUP BY ALL""",
    "longest_regular_run": """WITH s AS (SELECT o_custkey, row_number() OVER w AS k, d - lag(d) OVER w AS step FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders) o WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)),
 p AS (SELECT o_custkey, median(step) AS pitch FROM s WHERE step IS NOT NULL GROUP BY o_custkey HAVING median(step) > 0),
 g AS (SELECT s.o_custkey, k, pitch, k - row_number() OVER (PARTITION BY s.o_custkey ORDER BY k) AS i FROM s JOIN p USING (o_custkey) WHERE step IS NOT NULL AND round(step / pitch) BETWEEN 1 AND 4 AND abs(step / pitch - round(step / pitch)) <= 0.2),
 r AS (SELECT o_custkey, pitch, i, min(k) AS first_k, max(k) AS last_k, count(*) AS n_steps FROM g GROUP BY ALL)
 SELECT o_custkey, first_k, last_k, n_steps, pitch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n_steps DESC, first_k) AS o FROM r) z WHERE o = 1""",
    "gap_fill": f"""SELECT page_id, CAST(unnest(range(seniority_no, CASE WHEN nx - seniority_no BETWEEN 2 AND 12 THEN nx ELSE seniority_no + 1 END)) AS INTEGER) AS seniority_no,
 unnest(range(0, CASE WHEN nx - seniority_no BETWEEN 2 AND 12 THEN nx - seniority_no ELSE 1 END)) > 0 AS interpolated FROM (SELECT page_id, seniority_no, lead(seniority_no) OVER (PARTITION BY page_id ORDER BY seniority_no) AS nx
 FROM (SELECT DISTINCT page_id, seniority_no FROM ({_PAGES}) p WHERE seniority_no IS NOT NULL) d) s""",
    "truncated_repair": """WITH r AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN substr(CAST(o_orderkey AS VARCHAR), 2) ELSE CAST(o_orderkey AS VARCHAR) END AS reading FROM orders),
 w AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY sheet ORDER BY o_orderkey) AS pv, lead(o_orderkey) OVER (PARTITION BY sheet ORDER BY o_orderkey) AS nx FROM r),
 c AS (SELECT w.o_orderkey, count(*) AS n, max(CAST(p.p || w.reading AS BIGINT)) AS v FROM w, (SELECT unnest(range(1, 100)) AS p) p WHERE pv IS NOT NULL AND nx IS NOT NULL AND nx - pv >= 2 AND regexp_matches(reading, '^[0-9]{1,9}$')
   AND NOT (CAST(reading AS BIGINT) > pv AND CAST(reading AS BIGINT) < nx) AND CAST(p.p || w.reading AS BIGINT) > pv AND CAST(p.p || w.reading AS BIGINT) < nx GROUP BY w.o_orderkey)
 SELECT w.sheet, w.o_orderkey, w.reading, CASE WHEN c.n = 1 THEN c.v END AS recovered FROM w LEFT JOIN c USING (o_orderkey)""",
    "carry_forward": f"""SELECT page_id, row_index, last_value(r IGNORE NULLS) OVER w AS rank_code_carried, last_value(b IGNORE NULLS) OVER w AS branch_code_carried
 FROM (SELECT page_id, row_index, CASE WHEN row_index % 3 = 0 THEN nullif(rank_code, '') END AS r, CASE WHEN row_index % 2 = 0 THEN nullif(branch_code, '') END AS b FROM ({_PAGES}) p) s
 WINDOW w AS (PARTITION BY page_id ORDER BY row_index ROWS UNBOUNDED PRECEDING)""",
    "next_unread": "SELECT volume_id, min(frame_no + 1) AS next_unread FROM (SELECT DISTINCT volume_id, frame_no FROM observation_in) a WHERE NOT EXISTS (SELECT 1 FROM observation_in b WHERE b.volume_id = a.volume_id AND b.frame_no = a.frame_no + 1) GROUP BY volume_id",
    "page_number_model": f"""WITH a AS (SELECT volume_id, frame_no, CAST(min(seniority_no) AS DOUBLE) AS page FROM ({_PAGES}) p WHERE seniority_no IS NOT NULL GROUP BY ALL),
 r AS (SELECT volume_id, list_sort(list(rate)) AS l FROM (SELECT volume_id, (page - lag(page) OVER w) / (frame_no - lag(frame_no) OVER w) AS rate FROM a WINDOW w AS (PARTITION BY volume_id ORDER BY frame_no)) s WHERE rate IS NOT NULL GROUP BY volume_id),
 m AS (SELECT volume_id, CASE WHEN abs(l[CAST(round_even((len(l) - 1) / 2.0, 0) AS INTEGER) + 1] - 1) < abs(l[CAST(round_even((len(l) - 1) / 2.0, 0) AS INTEGER) + 1] - 2) THEN 1 ELSE 2 END AS slope FROM r),
 o AS (SELECT a.volume_id, slope, list_sort(list(page - slope * frame_no)) AS l FROM a JOIN m USING (volume_id) GROUP BY ALL),
 f AS (SELECT volume_id, slope, l[CAST(round_even((len(l) - 1) / 2.0, 0) AS INTEGER) + 1] AS "offset" FROM o)
 SELECT volume_id, slope, "offset", max(abs(page - slope * frame_no - "offset")) AS deviation FROM a JOIN f USING (volume_id) GROUP BY ALL""",
    "longest_reading_days": """SELECT user_id, cluster, count(*) AS n, max(a) - min(a) AS seconds FROM (SELECT user_id, a, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS cluster
 FROM (SELECT user_id, event_id, a, CASE WHEN a - lag(a) OVER (PARTITION BY user_id ORDER BY a, event_id) > 3600 THEN 1 ELSE 0 END AS g FROM (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS a FROM events) e) x) y GROUP BY ALL""",
}

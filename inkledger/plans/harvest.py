"""Registered queries of the harvest operators with their SQL.

The semi-structured inputs are written by the queries from whole tables, then taken apart again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.operators import harvest as H
from inkledger.operators import records as R
from inkledger.session import table


def _frames(spark, sf):
    rows = R.cell_parts(table(spark, sf, "observation").select("cell_id"))
    return rows.select("volume_id", "frame_no").distinct()


def _manifests(spark, sf):
    base = F.concat(F.lit("https://iiif.example/"), F.col("volume_id"), F.lit("/"), F.col("frame_no").cast("string"))
    image = F.struct(F.struct(base.alias("@id"), F.struct(F.concat(base, F.lit("/s")).alias("@id")).alias("service")).alias("resource"))
    canvas = F.struct(F.col("frame_no").alias("n"), F.struct(F.lit("p").alias("label"), F.lit(4000).alias("width"), (F.col("frame_no") + 3000).alias("height"), F.when(F.col("frame_no") % 5 != 0, F.array(image)).alias("images")).alias("c"))
    pages = _frames(spark, sf).groupBy("volume_id").agg(F.transform(F.array_sort(F.collect_list(canvas)), lambda x: x.c).alias("canvases"))
    sections = F.array(F.struct(F.concat(F.lit("叙任及辞令 "), F.col("volume_id")).alias("label"), F.array(F.concat(F.lit("https://iiif.example/canvas/"), F.col("volume_id"))).alias("canvases")), F.struct(F.lit("目次").alias("label"), F.array(F.lit("x")).alias("canvases")))
    return pages.select("volume_id", F.to_json(F.struct(F.col("volume_id").alias("label"), F.array(F.struct("canvases")).alias("sequences"), sections.alias("structures"))).alias("json"))


def manifest_flatten(spark, sf):
    return H.manifest_frames(_manifests(spark, sf), "volume_id", "json").select("volume_id", "image_url", "service_id", "width", "height", "frame_no")


def manifest_sections(spark, sf):
    return H.manifest_sections(_manifests(spark, sf), "volume_id", "json", "[叙敍]任及[辞辭]令")


def volume_labels(spark, sf):
    even = F.col("pid").cast("int") % 2 == 0
    json = F.when(even, F.to_json(F.struct(F.struct(F.array("title").alias("ja")).alias("l")))).otherwise(F.concat(F.lit('"'), F.col("title"), F.lit('"')))
    json = F.when(even, F.regexp_extract(json, "^\\{\"l\":(.*)\\}$", 1)).otherwise(json)
    return table(spark, sf, "source_volume").select("volume_id", H.label_text(json).alias("label"))


def full_text(spark, sf):
    rows = table(spark, sf, "observation_in").select("obs_id", "name_raw", "post", "row_index").distinct()
    box = F.struct(F.col("row_index").alias("xmin"), (F.col("row_index") + 10).alias("xmax"), F.lit(0).alias("ymin"), F.lit(9).alias("ymax"), F.col("post").alias("contenttext"))
    coordinates = F.when(F.col("obs_id") % 3 == 0, F.lit("null")).when(F.col("obs_id") % 3 == 1, F.to_json(F.array(box))).otherwise(F.to_json(F.array(box, box)))
    return H.full_text_lines(rows.withColumn("coordjson", coordinates), ["obs_id"], "name_raw", "coordjson")


def feed_first_of_month(spark, sf):
    item = F.concat(F.lit("<dc:item><dc:title>"), F.col("o_orderpriority"), F.lit("</dc:title><dc:link>"), F.col("o_orderkey").cast("string"), F.lit("</dc:link><dc:date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</dc:date></dc:item>"))
    xml = F.concat(F.lit("<feed xmlns:dc='urn:d'>"), item, F.lit("</feed>"))
    items = H.feed_items(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), "o_orderkey", "xml")
    dated = items.select(F.substring("date", 1, 7).alias("month"), F.col("link").cast("bigint").alias("pid"), "date")
    return H.first_of_month(dated, "month", "pid", "date")


def issue_walk(spark, sf):
    landed = table(spark, sf, "events").where("event_id % 7 <> 0").select(F.col("event_id").alias("pid"), F.date_format("ts", "yyyy-MM-dd").alias("issue_month"))
    starts = landed.groupBy(F.col("issue_month").alias("month")).agg(F.min("pid").alias("pid"))
    return H.key_walk(starts, landed)


def contents_frames(spark, sf):
    rows = table(spark, sf, "observation").select("obs_id", F.concat(F.col("rank_code"), F.when(F.col("obs_id") % 2 == 0, F.concat(F.lit("/"), F.col("seniority_no").cast("string"))).otherwise(F.lit("")), F.lit(" ("), F.lpad((F.col("obs_id") % 9000).cast("string"), 4, "0"), F.when(F.col("obs_id") % 11 == 0, F.lit(".png)")).otherwise(F.lit(".jp2)"))).alias("entry")).where("entry IS NOT NULL").distinct()
    return H.contents_by_frame(rows, "entry").select("obs_id", "section", "page", "frame")


def block_split(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    blocks = H.text_blocks(rows, "doc_id", "text", "([0-9]+)\\r?$")
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"), F.sum("page_no").alias("numbers"))


def line_chunks(spark, sf):
    rows = table(spark, sf, "observation_in").select("volume_id", "obs_id", F.coalesce("post", F.lit("-")).alias("line")).distinct()
    return H.chunked(rows, ["volume_id"], ["obs_id"], "line").select("volume_id", "chunk", "lines", F.md5(F.col("body").cast("binary")).alias("digest"))


def section_survey(spark, sf):
    rows = table(spark, sf, "documents").where("fetched_at IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    return H.section_survey(rows.select(F.date_format("fetched_at", "yyyy-MM").alias("month"), (text.contains("WEBVTT") | text.contains("webvtt")).alias("extra"), text.contains("-->").alias("structured"), text.rlike("[0-9]{2}:[0-9]{2}:[0-9]{2}").alias("section")))


def catalogue_records(spark, sf):
    odd = F.col("pid").cast("int") % 2 == 1
    title = F.when(odd, F.concat(F.lit("&lt;dc:title&gt;"), F.col("title"), F.lit("&lt;/dc:title&gt;"))).otherwise(F.concat(F.lit("&lt;dc:alternative&gt;"), F.col("title"), F.lit("&lt;/dc:alternative&gt;")))
    address = F.when(odd, F.concat(F.lit("info:x/pid/"), F.col("pid"))).otherwise(F.concat(F.lit("https://x.example/show?pid="), F.col("pid")))
    xml = F.concat(F.lit("<records><recordData>"), title, F.lit("&lt;id&gt;"), address, F.lit("&lt;/id&gt;</recordData></records>"))
    return H.catalogue_records(table(spark, sf, "source_volume").select("volume_id", xml.alias("xml")), "volume_id", "xml").select("volume_id", "title", "pid")


QUERIES = {f.__name__: f for f in (manifest_flatten, manifest_sections, volume_labels, full_text, feed_first_of_month, issue_walk, contents_frames, block_split, line_chunks, section_survey)}

_F = "SELECT volume_id, frame_no, row_number() OVER (PARTITION BY volume_id ORDER BY frame_no) AS k FROM (SELECT DISTINCT split_part(cell_id, ':', 1) AS volume_id, CAST(split_part(cell_id, ':', 2) AS INTEGER) AS frame_no FROM observation) d"
SQL = {
    "manifest_flatten": f"SELECT volume_id, CASE WHEN frame_no % 5 <> 0 THEN 'https://iiif.example/' || volume_id || '/' || frame_no END AS image_url, CASE WHEN frame_no % 5 <> 0 THEN 'https://iiif.example/' || volume_id || '/' || frame_no || '/s' END AS service_id, 4000 AS width, frame_no + 3000 AS height, CAST(k AS INTEGER) AS frame_no FROM ({_F}) f",
    "manifest_sections": f"SELECT DISTINCT volume_id, '叙任及辞令 ' || volume_id AS label, volume_id AS canvas FROM ({_F}) f",
    "volume_labels": "SELECT volume_id, title AS label FROM source_volume",
    "full_text": """SELECT obs_id, CAST(line AS INTEGER) AS line, CASE WHEN obs_id % 3 = 0 THEN coalesce(nullif(trim(name_raw, ' '), ''), '(no text)') ELSE coalesce(post, nullif(trim(name_raw, ' '), ''), '(no text)') END AS text, CASE WHEN obs_id % 3 <> 0 THEN (row_index * 2 + 10) / 2.0::DOUBLE END AS x
 FROM (SELECT *, unnest(CASE WHEN obs_id % 3 = 2 THEN [0, 1] ELSE [0] END) AS line FROM (SELECT DISTINCT obs_id, name_raw, post, row_index FROM observation_in) d) s""",
    "feed_first_of_month": "SELECT month, pid, date FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS pid, strftime(o_orderdate, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS k FROM orders) x WHERE k = 1",
    "issue_walk": """WITH l AS (SELECT event_id AS pid, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_id % 7 <> 0), s AS (SELECT d AS month, min(pid) AS pid FROM l GROUP BY d), w AS (SELECT month, l.pid, l.d FROM s JOIN l ON l.pid BETWEEN s.pid AND s.pid + 39),
 t AS (SELECT month, min(pid) FILTER (d > month) AS stop FROM w GROUP BY month) SELECT w.month, w.pid FROM w JOIN t USING (month) WHERE (stop IS NULL OR pid < stop) AND d = month""",
    "contents_frames": "SELECT DISTINCT obs_id, rank_code AS section, CASE WHEN obs_id % 2 = 0 THEN CAST(seniority_no AS INTEGER) END AS page, CAST(obs_id % 9000 AS INTEGER) AS frame FROM observation WHERE obs_id % 11 <> 0 AND rank_code IS NOT NULL AND (obs_id % 2 <> 0 OR seniority_no IS NOT NULL)",
    "block_split": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS m FROM documents WHERE text IS NOT NULL),
 h AS (SELECT *, regexp_matches(line, '^[0-9]+\r?$') AS head FROM l), f AS (SELECT *, min(k) FILTER (head) OVER (PARTITION BY doc_id) AS first FROM h)
 SELECT doc_id, count(*) FILTER (head) AS blocks, CAST(sum(CASE WHEN head THEN 0 ELSE length(line) END + CASE WHEN k < m THEN 1 ELSE 0 END) AS BIGINT) AS chars, CAST(sum(try_cast(replace(line, chr(13), '') AS INTEGER)) FILTER (head) AS BIGINT) AS numbers FROM f WHERE k >= first GROUP BY doc_id""",
    "line_chunks": "SELECT volume_id, chunk, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY obs_id)) AS digest FROM (SELECT volume_id, obs_id, line, CAST(floor((row_number() OVER (PARTITION BY volume_id ORDER BY obs_id) - 1) / 15) AS BIGINT) AS chunk FROM (SELECT DISTINCT volume_id, obs_id, coalesce(post, '-') AS line FROM observation_in) d) s GROUP BY ALL",
    "section_survey": """SELECT strftime(fetched_at, '%Y-%m') AS month, count(*) AS issues, count(*) FILTER (e) AS extra, count(*) FILTER (s) AS structured, count(*) FILTER (c) AS section, count(*) FILTER (c AND e) AS extra_section
 FROM (SELECT fetched_at, contains(coalesce(text, ''), 'WEBVTT') OR contains(coalesce(text, ''), 'webvtt') AS e, contains(coalesce(text, ''), '-->') AS s, regexp_matches(coalesce(text, ''), '[0-9]{2}:[0-9]{2}:[0-9]{2}') AS c FROM documents WHERE fetched_at IS NOT NULL) x GROUP BY 1""",
}

for _query in (catalogue_records,):
    QUERIES[_query.__name__] = _query
SQL |= {
    "catalogue_records": """SELECT volume_id, title, pid FROM source_volume""",
}

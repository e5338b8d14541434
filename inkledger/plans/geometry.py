"""Registered queries of the geometry operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.functions.readings import region_url as url
from inkledger.operators import geometry as G
from inkledger.session import table

TEMPLATES = {"A": (0, 0.1, 0.2, 0.35, 0.5, 0.75, 1), "B": (0, 0.25, 0.5, 0.75, 1), "C": (0, 0.33, 0.66, 1)}
TOLERANCE = 0.015


def _bands(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("panel"), F.lit("h").alias("axis"), F.col("p_size").cast("double").alias("pos"))
    return G.band_fractions(rows)


def nearest_band(spark, sf):
    return G.nearest_bands(_bands(spark, sf), TEMPLATES, TOLERANCE)


def register_panels(spark, sf):
    return G.registrations(_bands(spark, sf), TEMPLATES, TOLERANCE)


def classify_template(spark, sf):
    gates = {t: (len(ns) - 1, 0.2) for t, ns in TEMPLATES.items()}
    bands = _bands(spark, sf)
    return G.classify(register_panels(spark, sf), bands.select("panel").distinct(), gates)


def _vertical(spark, sf):
    """Every order as a line of its customer group, its day moved to the grid of ten days."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 97).cast("string").alias("panel"), F.lit("v").alias("axis"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("pos"))
    return rows.withColumn("pos", F.floor(F.col("pos") / 10) * 10.0)


def column_edges(spark, sf):
    return G.column_grid(_vertical(spark, sf)).groupBy("panel").agg(F.count(F.lit(1)).alias("edges"), F.count_if("interpolated").alias("filled"), F.min("edge").alias("first"), F.max("edge").alias("last"))


def cell_geometry(spark, sf):
    edges = table(spark, sf, "part").select("p_brand", (F.col("p_size") * 10.0).alias("edge")).distinct().select(F.col("p_brand").alias("panel"), "edge", (F.col("edge") % 70 == 0).alias("interpolated"))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(a).alias("top"), F.lit(b).alias("bottom"), F.lit(u).alias("unmatched")) for n, a, b, u in (("first", 0.0, 0.1, False), ("middle", 0.2, 0.5, True), ("last", 0.75, 1.0, False))])
    return G.page_cells(edges, edges.select("panel").distinct().select("panel", F.inline(fields)))


def region_urls(spark, sf):
    n = lambda c: F.col(c).cast("int")
    rows = table(spark, sf, "part").select("p_partkey", (n("p_size") * 40 - 400).alias("x"), (F.col("p_partkey") % 900 - 100).cast("int").alias("y"), (n("p_size") * 7).alias("w"), F.lit(120).alias("h"))
    cut = rows.withColumn("r", G.clamped(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1200), F.lit(800)))
    return cut.select("p_partkey", F.when(F.col("r").isNotNull(), url(F.lit("https://iiif.example/s"), F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h"))).alias("url"))


def point_map(spark, sf):
    x, y = G.rotated(F.col("p_size") * 10.0, F.col("p_retailprice"), F.lit(400.0), F.lit(500.0), F.lit(1.2), F.lit(0.6))
    return table(spark, sf, "part").select("p_partkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def _boxes(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("panel"), F.round(F.col("embedding")[0].cast("double"), 4).alias("x"), F.round(F.col("embedding")[1].cast("double"), 4).alias("y"))


def box_binning(spark, sf):
    boxes = _boxes(spark, sf)
    anchors = boxes.where("vec_id % 25 = 0").select("panel", F.col("vec_id").alias("anchor"), F.col("x").alias("centre"))
    return G.boxes_in_columns(boxes, anchors, 0.05).groupBy("panel", "anchor").agg(F.count(F.lit(1)).alias("boxes"), F.sum(F.round(F.col("y") * 10000).cast("bigint")).alias("sum_y"))


def panel_boxes(spark, sf):
    boxes = _boxes(spark, sf).select("vec_id", F.col("panel").alias("page"), "x", "y")
    panels = boxes.select("page").distinct().select("page", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    panels = panels.select("page", "side", (-0.2 + 0.2 * F.col("side")).alias("x0"), (0.2 * F.col("side")).alias("x1"), F.lit(-0.15).alias("y0"), F.lit(0.15).alias("y1"))
    return G.boxes_in_panels(boxes, panels).groupBy("page", "side").agg(F.count(F.lit(1)).alias("boxes"))


def reading_order(spark, sf):
    return G.right_to_left(_boxes(spark, sf), "panel", "x", "vec_id").select("vec_id", "panel", F.col("column").alias("place"))


def page_payload(spark, sf):
    return G.page_payload(cell_geometry(spark, sf)).select("panel", "officer_count", "needs_review", F.size("officers").alias("listed"))


def seniority_columns(spark, sf):
    n = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("panel"), n.alias("box"), ((n * 37) % 1000).cast("double").alias("x"), ((n * 13) % 100 / 100.0).alias("y"), F.when(n % 7 == 0, (n % 9000).cast("string")).otherwise(F.col("p_name")).alias("text"), F.lit(1000.0).alias("panel_width"))
    return G.seniority_columns(rows).groupBy("panel", "anchor", "seniority").agg(F.count(F.lit(1)).alias("boxes"))


QUERIES = {f.__name__: f for f in (nearest_band, register_panels, classify_template, column_edges, cell_geometry, region_urls, point_map, box_binning, panel_boxes, reading_order)}

_T = "(VALUES " + ", ".join(f"('{t}', {i}, CAST({n} AS DOUBLE))" for t, ns in TEMPLATES.items() for i, n in enumerate(ns)) + ") t(template_id, band, nominal)"
_B = "SELECT panel, pos, round_even((pos - min(pos) OVER (PARTITION BY panel)) / (max(pos) OVER (PARTITION BY panel) - min(pos) OVER (PARTITION BY panel)), 4) AS fraction FROM (SELECT DISTINCT p_brand || '/' || p_type AS panel, CAST(p_size AS DOUBLE) AS pos FROM part) d QUALIFY max(pos) OVER (PARTITION BY panel) > min(pos) OVER (PARTITION BY panel)"
_N = f"""SELECT panel, template_id, band, nominal, coalesce(arg_min(fraction, {{'d': d, 'p': pos}}) FILTER (d <= {TOLERANCE}), nominal) AS place, min(d) FILTER (d <= {TOLERANCE}) AS residual, count(*) FILTER (d <= {TOLERANCE}) = 0 AS unmatched
 FROM (SELECT *, abs(fraction - nominal) AS d FROM ({_B}) b, {_T}) x GROUP BY panel, template_id, band, nominal"""
_R = f"""SELECT f.panel, f.template_id, matched, round(residual, 6) AS residual, round(explained, 6) AS explained FROM (SELECT panel, template_id, count(*) FILTER (NOT unmatched) AS matched, coalesce(avg(residual), 1.0) AS residual FROM ({_N}) n GROUP BY ALL) f
 JOIN (SELECT panel, template_id, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS explained FROM (SELECT panel, template_id, pos, bool_or(abs(fraction - nominal) <= {TOLERANCE}) AS hit FROM ({_B}) b, {_T} GROUP BY ALL) h GROUP BY ALL) e USING (panel, template_id)"""
_BOX = "SELECT vec_id, label AS panel, round(CAST(embedding[1] AS DOUBLE), 4) AS x, round(CAST(embedding[2] AS DOUBLE), 4) AS y FROM embeddings"

SQL = {
    "nearest_band": _N,
    "register_panels": _R,
    "classify_template": f"""SELECT p.panel, template_id, matched FROM (SELECT DISTINCT panel FROM ({_B}) b) p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY matched DESC, residual, template_id) AS k FROM ({_R}) r
 WHERE matched >= CASE template_id {" ".join(f"WHEN '{t}' THEN {len(n) - 1}" for t, n in TEMPLATES.items())} END AND explained >= 0.2) s WHERE k = 1) q ON p.panel = q.panel""",
    "cell_geometry": """WITH e AS (SELECT DISTINCT p_brand AS panel, p_size * 10.0::DOUBLE AS edge FROM part), s AS (SELECT panel, edge AS "left", lead(edge) OVER w AS "right", (CAST(edge AS BIGINT) % 70 = 0) OR (CAST(lead(edge) OVER w AS BIGINT) % 70 = 0) AS filled FROM e WINDOW w AS (PARTITION BY panel ORDER BY edge)),
 c AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY "left" DESC) - 1 AS "column" FROM s WHERE "right" IS NOT NULL)
 SELECT panel, "column", field, CAST("left" AS DOUBLE) AS "left", CAST("right" AS DOUBLE) AS "right", CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, filled OR unmatched AS suspect FROM c, (VALUES ('first', 0.0, 0.1, false), ('middle', 0.2, 0.5, true), ('last', 0.75, 1.0, false)) f(field, top, bottom, unmatched)""",
    "region_urls": """SELECT p_partkey, CASE WHEN r > l AND b > t THEN 'https://iiif.example/s/' || l || ',' || t || ',' || (r - l) || ',' || (b - t) || '/full/0/default.jpg' END AS url FROM (SELECT p_partkey, greatest(p_size * 40 - 400, 0) AS l, greatest(p_partkey % 900 - 100, 0) AS t,
 least(p_size * 40 - 400 + p_size * 7, 1200) AS r, least(p_partkey % 900 - 100 + 120, 800) AS b FROM part) x""",
    "point_map": """SELECT p_partkey, round((400 + (p_size * 10.0 - 400) * cos(radians(-1.2)) - (p_retailprice - 500) * sin(radians(-1.2))) / 0.6, 4) AS x, round((500 + (p_size * 10.0 - 400) * sin(radians(-1.2)) + (p_retailprice - 500) * cos(radians(-1.2))) / 0.6, 4) AS y FROM part""",
    "box_binning": f"SELECT b.panel, a.vec_id AS anchor, count(*) AS boxes, CAST(sum(CAST(round(b.y * 10000) AS BIGINT)) AS BIGINT) AS sum_y FROM ({_BOX}) b JOIN ({_BOX}) a ON a.panel = b.panel AND a.vec_id % 25 = 0 AND abs(b.x - a.x) <= 0.025 GROUP BY ALL",
    "panel_boxes": f"SELECT panel AS page, side, count(*) AS boxes FROM ({_BOX}) b, (VALUES (0), (1)) s(side) WHERE x >= -0.2 + 0.2 * side AND x < 0.2 * side AND y BETWEEN -0.15 AND 0.15 GROUP BY ALL",
    "reading_order": f"SELECT vec_id, panel, CAST(row_number() OVER (PARTITION BY panel ORDER BY x DESC, vec_id) - 1 AS INTEGER) AS place FROM ({_BOX}) b",
}

for _query in (page_payload, seniority_columns,):
    QUERIES[_query.__name__] = _query
SQL |= {
    "page_payload": """SELECT panel, n AS officer_count, true AS needs_review, CAST(n AS INTEGER) AS listed FROM (SELECT p_brand AS panel, count(DISTINCT p_size) - 1 AS n FROM part GROUP BY p_brand) x WHERE n > 0""",
    "seniority_columns": """WITH b AS (SELECT p_brand || '/' || p_type AS panel, p_partkey AS box, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS x, ((p_partkey * 13) % 100) / 100.0::DOUBLE AS y, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey % 9000 AS VARCHAR) ELSE p_name END AS text FROM part),
 a AS (SELECT panel, box AS anchor, x AS centre, CAST(text AS INTEGER) AS seniority FROM b WHERE regexp_matches(text, '^[0-9]{1,4}$') AND y BETWEEN 0.30 AND 0.55),
 p AS (SELECT panel, coalesce(median(step), 500.0) AS pitch FROM (SELECT panel, centre - lag(centre) OVER (PARTITION BY panel ORDER BY centre, anchor) AS step FROM a) s GROUP BY panel)
 SELECT a.panel, anchor, seniority, count(*) AS boxes FROM a JOIN p USING (panel) JOIN b ON b.panel = a.panel AND abs(b.x - a.centre) <= pitch / 2 GROUP BY ALL""",
}

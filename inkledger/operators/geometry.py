"""Page geometry from detected lines: grids, template registration, cells, boxes in columns.

Lines are rows ``(panel, axis, pos)``; a panel holds tens of lines, so arrays of a panel are
short.  Joins are by panel (and by bucket where a range is asked), never crossed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions.readings import region_url
from inkledger.operators.sequences import longest_regular_run, steps


def half_even(column: Column, digits: int = 0) -> Column:
    """Rounding half to even."""
    return F.bround(column, digits)


def band_fractions(lines: DataFrame) -> DataFrame:
    """Horizontal lines as fractions of their table's height; panels of one line have none."""
    rows = lines.where("axis = 'h'").select("panel", "pos").distinct()
    span = rows.groupBy("panel").agg(F.min("pos").alias("top"), F.max("pos").alias("bottom")).where("bottom > top")
    return rows.join(span, "panel").select("panel", "pos", half_even((F.col("pos") - F.col("top")) / (F.col("bottom") - F.col("top")), 4).alias("fraction"))


def nearest_bands(bands: DataFrame, templates: dict[str, Sequence[float]], tolerance: float) -> DataFrame:
    """For every panel and template band the nearest detected band within the tolerance.

    ``templates`` has the nominal bands of each template, a small library that goes into the
    plan.  The first of equally near bands counts; a band without one keeps its nominal place
    and is marked unmatched.
    """
    library = F.array(*[F.struct(F.lit(t).alias("template_id"), F.lit(i).alias("band"), F.lit(float(n)).alias("nominal")) for t, ns in templates.items() for i, n in enumerate(ns)])
    both = bands.select("panel", "pos", "fraction", F.explode(library).alias("t")).select("panel", "pos", "fraction", "t.*")
    distance = F.abs(F.col("fraction") - F.col("nominal"))
    near = F.when(distance <= tolerance, F.struct(distance.alias("distance"), "pos", "fraction"))
    best = both.groupBy("panel", "template_id", "band", "nominal").agg(F.min(near).alias("b"))
    return best.select("panel", "template_id", "band", "nominal", F.coalesce("b.fraction", "nominal").alias("place"), F.col("b.distance").alias("residual"), F.col("b").isNull().alias("unmatched"))


def registrations(bands: DataFrame, templates: dict[str, Sequence[float]], tolerance: float) -> DataFrame:
    """Per panel and template: matched bands, mean residual (1 if none), share of the detected
    bands that the template explains."""
    forward = nearest_bands(bands, templates, tolerance).groupBy("panel", "template_id").agg(F.count_if(~F.col("unmatched")).alias("matched"), F.coalesce(F.avg("residual"), F.lit(1.0)).alias("residual"))
    library = F.array(*[F.struct(F.lit(t).alias("template_id"), F.array(*[F.lit(float(n)) for n in ns]).alias("nominals")) for t, ns in templates.items()])
    near = F.exists("t.nominals", lambda n: F.abs(n - F.col("fraction")) <= tolerance)
    back = bands.select("panel", "fraction", F.explode(library).alias("t")).groupBy("panel", F.col("t.template_id").alias("template_id")).agg((F.count_if(near) / F.count(F.lit(1))).alias("explained"))
    return forward.join(back, ["panel", "template_id"]).select("panel", "template_id", "matched", F.round("residual", 6).alias("residual"), F.round("explained", 6).alias("explained"))


def classify(registered: DataFrame, panels: DataFrame, gates: dict[str, tuple[int, float] | tuple[int, float, int]]) -> DataFrame:
    """The template that passes its gates with most matches, then least residual, then first id;
    a panel that none fits is refused (null).  ``gates`` has the least number of matches, the least
    explained share and, if ``panels`` counts ``columns``, the least number of officer columns."""
    fits = F.lit(False)
    for template, (bands, explained, *columns) in gates.items():
        enough = F.col("columns") >= columns[0] if columns else F.lit(True)
        fits = fits | ((F.col("template_id") == template) & (F.col("matched") >= bands) & (F.col("explained") >= explained) & enough)
    passed = (registered.join(panels.select("panel", "columns"), "panel") if "columns" in panels.columns else registered).where(fits)
    best = passed.groupBy("panel").agg(F.min(F.struct((-F.col("matched")).alias("m"), "residual", "template_id")).alias("b"))
    return panels.join(best, "panel", "left").select("panel", F.col("b.template_id").alias("template_id"), (-F.col("b.m")).alias("matched"))


#: Shares of a panel's width between which a ruling can be the table's; pages' borders lie outside.
EDGES = (0.03, 0.95)
#: Multiples of the median step between which a step counts for the pitch.
USUAL_STEPS = (0.6, 1.4)


def inner_rulings(lines: DataFrame, panels: DataFrame) -> DataFrame:
    """Vertical lines that are no borders of page or film; ``panels`` has panel and width."""
    inside = (F.col("axis") != "v") | F.col("pos").between(EDGES[0] * F.col("width"), EDGES[1] * F.col("width"))
    return lines.join(panels.select("panel", "width"), "panel").where(inside).drop("width")


def grids(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Panels that have a grid: two horizontal and two vertical lines at least, and two edges of
    columns; with the numbers of each.  Other panels are refused, that is, missing here."""
    seen = lines.groupBy("panel").agg(F.count_if(F.col("axis") == "h").alias("bands"), F.count_if(F.col("axis") == "v").alias("rulings"))
    columns = edges.groupBy("panel").agg((F.count(F.lit(1)) - 1).alias("columns"))
    return seen.join(columns, "panel").where("bands >= 2 AND rulings >= 2 AND columns >= 1")


def largest_regions(regions: DataFrame, key: str, region: str) -> DataFrame:
    """The largest region of every key by area, of equals the first: key, region, area."""
    area = (F.col("w") * F.col("h")).cast("double")
    best = regions.groupBy(key).agg(F.min(F.struct((-area).alias("a"), region)).alias("b"))
    return best.select(key, F.col(f"b.{region}").alias(region), (-F.col("b.a")).alias("area"))


def column_grid(lines: DataFrame) -> DataFrame:
    """Officer columns from vertical lines: pitch, the regular run's edges and what was filled in.

    Between edges of the run a step of k pitches gets k-1 evenly spaced edges, marked.
    """
    rows = lines.where("axis = 'v'").select("panel", "pos").distinct().withColumn("tie", F.lit(0))
    run = longest_regular_run(rows, ["panel"], "pos", "tie", usual=USUAL_STEPS)
    placed = steps(rows, ["panel"], "pos", "tie").join(run, "panel").where(F.col("k").between(F.col("first_k") - 1, F.col("last_k")))
    following = F.lead("pos").over(Window.partitionBy("panel").orderBy("k"))
    gaps = placed.select("panel", "pos", "pitch", following.alias("next"))
    times = F.coalesce(F.round((F.col("next") - F.col("pos")) / F.col("pitch")).cast("int"), F.lit(1))
    edges = gaps.withColumn("times", times).select("panel", "pos", "next", "times", F.explode(F.sequence(F.lit(0), F.greatest(F.col("times"), F.lit(1)) - 1)).alias("i"))
    at = F.when(F.col("i") == 0, F.col("pos")).otherwise(half_even(F.col("pos") + F.col("i") * (F.col("next") - F.col("pos")) / F.col("times")))
    return edges.select("panel", at.cast("double").alias("edge"), (F.col("i") > 0).alias("interpolated"))


def right_to_left(df: DataFrame, panel: str, x: str, tie: str) -> DataFrame:
    """Reading order of columns: 0 is the rightmost."""
    return df.withColumn("column", F.row_number().over(Window.partitionBy(panel).orderBy(F.desc(x), tie)) - 1)


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column, scale: Column) -> tuple[Column, Column]:
    """A grid point on the original image: rotated back about the centre, then rescaled."""
    angle = F.radians(-degrees)
    dx, dy = x - cx, y - cy
    return (cx + dx * F.cos(angle) - dy * F.sin(angle)) / scale, (cy + dx * F.sin(angle) + dy * F.cos(angle)) / scale


def rect_around(points: list[tuple[Column, Column]]) -> Column:
    """Smallest whole-pixel rectangle around points, as a struct."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x, y = F.floor(F.least(*xs)), F.floor(F.least(*ys))
    return F.struct(x.alias("x"), y.alias("y"), (F.ceil(F.greatest(*xs)) - x).alias("w"), (F.ceil(F.greatest(*ys)) - y).alias("h"))


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A region cut to the page; null if nothing of it is left."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(x + w, width), F.least(y + h, height)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def page_cells(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """Every column crossed with every field of the panel's template: bounds and suspicion.

    A cell is suspect if an edge of its column was filled in or a band of its field unmatched.
    ``fields`` has panel, field, top, bottom, unmatched.
    """
    window = Window.partitionBy("panel").orderBy("edge")
    spans = edges.select("panel", F.col("edge").alias("left"), F.lead("edge").over(window).alias("right"), (F.col("interpolated") | F.lead("interpolated").over(window)).alias("filled")).where("right IS NOT NULL")
    columns = right_to_left(spans, "panel", "left", "right")
    return columns.join(fields, "panel").select("panel", "column", "field", "left", "right", "top", "bottom", (F.col("filled") | F.col("unmatched")).alias("suspect"))


def boxes_in_columns(boxes: DataFrame, anchors: DataFrame, pitch: float) -> DataFrame:
    """Boxes within half a pitch of an anchor's centre; a box may meet two anchors.

    A range join by buckets of one pitch: an anchor is in the buckets its range touches.
    """
    left = boxes.withColumn("bucket", F.floor(F.col("x") / pitch))
    touched = F.explode(F.sequence(F.floor((F.col("centre") - pitch / 2) / pitch), F.floor((F.col("centre") + pitch / 2) / pitch)))
    right = anchors.select("panel", "anchor", "centre", touched.alias("bucket"))
    return left.join(right, ["panel", "bucket"]).where(F.abs(F.col("x") - F.col("centre")) <= pitch / 2).drop("bucket")


def boxes_in_panels(boxes: DataFrame, panels: DataFrame) -> DataFrame:
    """Boxes inside their page's panels: x half-open, y closed."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return boxes.join(panels, "page").where(inside)


def with_urls(cells: DataFrame, service: Column, width: Column, height: Column) -> DataFrame:
    """Cells with the image region of the cell and of its officer's strip (all fields of the column), as
    URLs; null for what lies outside the page."""
    strip = Window.partitionBy("panel", "column")
    top, bottom = F.min("top").over(strip), F.max("bottom").over(strip)

    def url(y0: Column, y1: Column) -> Column:
        x, y = F.floor(F.col("left")), F.floor(y0)
        r = clamped(x, y, F.ceil(F.col("right")) - x, F.ceil(y1) - y, width, height)
        return F.when(r.isNotNull(), region_url(service, r.x, r.y, r.w, r.h))

    return cells.withColumn("cell_url", url(F.col("top"), F.col("bottom"))).withColumn("strip_url", url(top, bottom))


def field_errors(asked: DataFrame, fields: DataFrame, counts: DataFrame) -> DataFrame:
    """Asked cells (panel, column, field) that a panel does not have, with the reason: a column out of
    range, a field unknown to the template."""
    known = fields.select("panel", "field", F.lit(True).alias("_known")).distinct()
    both = asked.join(counts.select("panel", "columns"), "panel", "left").join(known, ["panel", "field"], "left")
    outside = F.col("columns").isNull() | (F.col("column") < 0) | (F.col("column") >= F.col("columns"))
    return both.withColumn("error", F.when(outside, "column out of range").when(F.col("_known").isNull(), "unknown field")).where("error IS NOT NULL").select("panel", "column", "field", "error")


def page_payload(cells: DataFrame) -> DataFrame:
    """Officers of a panel in reading order with their cells, and whether any needs review."""
    cell = F.struct("field", "left", "right", "top", "bottom", "suspect")
    officers = cells.groupBy("panel", "column").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.bool_or("suspect").alias("suspect"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("column", "cells"))), lambda o: o.cells)
    return officers.groupBy("panel").agg(F.count(F.lit(1)).alias("officer_count"), F.bool_or("suspect").alias("needs_review"), listed.alias("officers"))


def seniority_columns(boxes: DataFrame, top: float = 0.30, bottom: float = 0.55) -> DataFrame:
    """Boxes of a panel assigned to the officer columns that seniority numbers anchor.

    ``boxes`` has panel, box, x, y (as a share of the table's height), text, panel_width.  An
    anchor is a box of digits in the seniority band; the pitch is the median step between
    anchors, or half the panel for a single one; a box may belong to two columns.
    """
    anchors = boxes.where(F.col("text").rlike("^[0-9０-９]{1,4}$") & F.col("y").between(top, bottom)).select("panel", F.col("box").alias("anchor"), F.col("x").alias("centre"), F.translate("text", "０１２３４５６７８９", "0123456789").cast("int").alias("seniority"), "panel_width")
    stepped = anchors.withColumn("step", F.col("centre") - F.lag("centre").over(Window.partitionBy("panel").orderBy("centre", "anchor")))
    pitch = stepped.groupBy("panel").agg(F.coalesce(F.median("step"), F.max("panel_width") / 2).alias("pitch"))
    # By buckets of a panel's pitch, so a box meets the anchors near it and no others.
    touched = F.explode(F.array_distinct(F.array(*[F.floor((F.col("centre") + k * F.col("pitch") / 2) / F.col("pitch")) for k in (-1, 0, 1)])))
    near = anchors.drop("panel_width").join(pitch.where("pitch > 0"), "panel").withColumn("bucket", touched)
    placed = boxes.join(pitch.select("panel", F.col("pitch").alias("_p")), "panel").withColumn("bucket", F.floor(F.col("x") / F.col("_p"))).drop("_p")
    both = placed.join(near, ["panel", "bucket"])
    return both.where(F.abs(F.col("x") - F.col("centre")) <= F.col("pitch") / 2).select("panel", "anchor", "seniority", "box", "x", "y", "text")

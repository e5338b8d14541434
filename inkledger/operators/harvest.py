"""Semi-structured sources flattened: manifests, full text, feeds, contents, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.readings import contents_entry
from inkledger.operators.sequences import spread_numbers

MANIFEST = "struct<label:string, sequences:array<struct<canvases:array<struct<label:string, width:int, height:int, images:array<struct<resource:struct<`@id`:string, service:struct<`@id`:string>>>>>>>>, structures:array<struct<label:string, canvases:array<string>>>>"
BOXES = "array<struct<xmin:int, xmax:int, ymin:int, ymax:int, contenttext:string>>"


def manifest_frames(df: DataFrame, key: str, json: str) -> DataFrame:
    """One row for each canvas: frame numbers from 1 within each sequence; only its first image;
    absent parts are null, a manifest without canvases has no row."""
    parsed = df.select(key, F.from_json(json, MANIFEST).alias("m"))
    sequences = parsed.select(key, F.posexplode("m.sequences").alias("sequence", "s"))
    canvases = sequences.select(key, "sequence", F.posexplode("s.canvases").alias("at", "c"))
    image = F.get(F.col("c.images"), F.lit(0))
    return canvases.select(key, "sequence", (F.col("at") + 1).alias("frame_no"), image["resource"]["@id"].alias("image_url"), image["resource"]["service"]["@id"].alias("service_id"), F.col("c.width").alias("width"), F.col("c.height").alias("height"))


def manifest_sections(df: DataFrame, key: str, json: str, section: str) -> DataFrame:
    """Structures with a matching label: the label cut to 60 and the id of its first canvas."""
    parsed = df.select(key, F.explode(F.from_json(json, MANIFEST)["structures"]).alias("s")).where(F.col("s.label").rlike(section))
    return parsed.select(key, F.substring("s.label", 1, 60).alias("label"), F.substring_index(F.get(F.col("s.canvases"), F.lit(0)), "/", -1).alias("canvas"))


def label_text(json: Column) -> Column:
    """A label that is a string or a map of languages: the first value of the first language."""
    variant = F.try_parse_json(json)
    languages = F.try_variant_get(variant, "$", "map<string,array<string>>")
    return F.coalesce(F.get(F.get(F.map_values(languages), F.lit(0)), F.lit(0)), F.try_variant_get(variant, "$", "string"))


def full_text_lines(df: DataFrame, keys: list[str], contents: str, coordinates: str) -> DataFrame:
    """Boxes of a page out of JSON within JSON; a page without boxes gives its contents as one
    line, or a placeholder."""
    missing = F.coalesce(F.trim(coordinates), F.lit("")).isin("", "null")
    boxes = F.when(~missing, F.from_json(coordinates, BOXES))
    rows = df.withColumn("_b", boxes).select(*keys, contents, F.posexplode_outer("_b").alias("line", "b"))
    text = F.coalesce("b.contenttext", F.nullif(F.trim(F.col(contents)), F.lit("")), F.lit("(no text)"))
    return rows.select(*keys, F.coalesce("line", F.lit(0)).alias("line"), text.alias("text"), ((F.col("b.xmin") + F.col("b.xmax")) / 2).alias("x"))


def feed_items(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Items of a feed, whatever their namespace prefix: title, link, date."""
    part = lambda tag: F.xpath(xml, F.lit(f"//*[local-name()='item']/*[local-name()='{tag}']/text()"))
    items = df.select(key, F.posexplode(F.arrays_zip(part("title").alias("title"), part("link").alias("link"), part("date").alias("date"))).alias("item", "i"))
    return items.select(key, "item", "i.title", "i.link", "i.date")


def first_of_month(items: DataFrame, month: str, pid: str, date: str) -> DataFrame:
    """Earliest dated identifier of every month."""
    return items.groupBy(month).agg(F.min(F.struct(date, pid)).alias("f")).select(month, F.col(f"f.{pid}").alias(pid), F.col(f"f.{date}").alias(date))


def key_walk(starts: DataFrame, landed: DataFrame, most: int = 40) -> DataFrame:
    """Consecutive keys from a start, gaps skipped, until a landed issue passes the month.

    ``starts`` has month, pid; ``landed`` has pid, issue_month.
    """
    walked = starts.select("month", F.explode(F.sequence(F.col("pid"), F.col("pid") + most - 1)).alias("pid")).join(landed, "pid")
    stop = walked.groupBy("month").agg(F.min(F.when(F.col("issue_month") > F.col("month"), F.col("pid"))).alias("stop"))
    return walked.join(stop, "month").where(F.col("stop").isNull() | (F.col("pid") < F.col("stop"))).where("issue_month = month").select("month", "pid")


def contents_by_frame(df: DataFrame, entry: str) -> DataFrame:
    """Contents entries with their frame; entries of another shape are left out."""
    return df.withColumn("e", contents_entry(F.col(entry))).where("e.frame IS NOT NULL").select(*df.columns, "e.section", "e.page", "e.frame")


def text_blocks(df: DataFrame, key: str, text: str, header: str = "=== Image (\\d+)") -> DataFrame:
    """Blocks of a text that header lines part: (key, page_no, block).

    A header stands at the start of a line and has the page's number as its first group; its line is
    no part of the block.  What precedes the first header belongs to no page and is left out.
    """
    blocks = F.split(text, f"(?md)(?=^{header})")
    rows = df.select(key, F.explode(blocks).alias("_b"))
    number = F.regexp_extract("_b", f"(?md)^{header}", 1).try_cast("int")
    line = F.regexp_replace("_b", f"(?md)^{header}.*$", "")
    return rows.where(F.col("_b").rlike(f"(?md)\\A{header}")).select(key, number.alias("page_no"), line.alias("block"))


def extra_issue(title: Column) -> Column:
    """Whether a title is of an extra issue, in either spelling."""
    return title.contains("号外") | title.contains("號外")


def annotated_frames(frames: DataFrame, contents: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Every frame with the list of contents labels that begin on it, in order; empty for none."""
    listed = contents.groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias("labels"))
    return frames.join(listed, keys, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def chunked(df: DataFrame, keys: list[str], order: list[str], text: str, size: int = 15) -> DataFrame:
    """Lines joined to chunks of a fixed number, in order; keys may not be null."""
    numbered = spread_numbers(df, keys, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda s: s[text]), "\n")
    return numbered.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("lines"), joined.alias("body"))


def section_survey(issues: DataFrame) -> DataFrame:
    """Per month: issues, extra issues, with structures, with the section, extra with it."""
    return issues.groupBy("month").agg(F.count(F.lit(1)).alias("issues"), F.count_if("extra").alias("extra"), F.count_if("structured").alias("structured"), F.count_if("section").alias("section"), F.count_if(F.col("section") & F.col("extra")).alias("extra_section"))


def catalogue_records(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Records of a catalogue answer whose payload is escaped XML: title with a fallback field,
    and the identifier out of either shape of its address."""
    text = F.col(xml)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    records = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(?s)<recordData>(.*?)</recordData>"), F.lit(1))).alias("record", "body"))
    field = lambda tag: F.nullif(F.regexp_extract("body", f"(?s)<dc:{tag}>(.*?)</dc:{tag}>", 1), F.lit(""))
    pid = F.coalesce(*[F.nullif(F.regexp_extract("body", shape, 1), F.lit("")) for shape in ("[:/]pid/([0-9]+)", "[?&]pid=([0-9]+)")])
    return records.select(key, "record", F.coalesce(field("title"), field("alternative")).alias("title"), pid.alias("pid"))

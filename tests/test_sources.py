"""Scans, sinks, rasters and streams on small files."""

from __future__ import annotations

import json

import numpy as np
from conftest import SMALL

from inkledger.operators.geometry import band_fractions
from inkledger.sources import files, rasters, sinks
from inkledger.streaming.readings import breaks_stream, progress_stream, readings_stream, sessions_stream


def test_headered_scan_with_mark_and_missing_file(spark, tmp_path):
    path = tmp_path / "rank.csv"
    path.write_text("﻿rank_code,label_ja,valid_from,valid_to\njuni,准尉,1920-01-01,\nx,y,,bad\n", encoding="utf-8")
    assert [tuple(r) for r in files.headered(spark, str(path), ["rank_code", "note"]).collect()] == [("juni", None), ("x", None)]
    assert files.headered(spark, str(tmp_path / "no.csv"), ["a"]).count() == 0
    periods = {r.rank_code: (str(r.valid_from), r.valid_to) for r in files.vocabulary_periods(spark, str(path), "rank_code").collect()}
    assert periods == {"juni": ("1920-01-01", None), "x": ("None", None)}


def test_lexicon_counts_lines_from_two(spark, tmp_path):
    path = tmp_path / "lex.csv"
    path.write_text("fullname,cohort\n富永信政,21\n ,9\n牛島満,\n", encoding="utf-8")
    assert [tuple(r) for r in files.lexicon(spark, str(path), "fullname", ["cohort"]).orderBy("row_ref").collect()] == [(2, "富永信政", "21"), (4, "牛島満", None)]


def test_entry_vocabulary_and_templates(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("code,label_ja,label_en,seniority_order,variants\nb,乙,B,,x;y z|\na,甲,A,10,\n", encoding="utf-8")
    assert [(r.code, r.variants) for r in files.entry_vocabulary(spark, str(path), "code").collect()] == [("a", []), ("b", ["x", "y", "z"])]
    (tmp_path / "t.json").write_text(json.dumps({"template_id": "T", "bands": [0, 0.5, 1]}))
    row = files.templates(spark, str(tmp_path)).first()
    assert (row.tolerance, row.min_bands, row.min_explained, row.min_columns) == (0.015, 2, 0.8, 2)


def test_export_keeps_header_of_empty_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "猫"), (2, None)], "a int, b string")
    assert sinks.export_csv(df.where("a > 5"), str(tmp_path / "e.csv")) == 0
    assert (tmp_path / "e.csv").read_bytes() == b"\xef\xbb\xbfa,b\r\n"
    assert sinks.export_csv(df.orderBy("a"), str(tmp_path / "f.csv")) == 2
    assert (tmp_path / "f.csv").read_text("utf-8-sig").splitlines() == ["a,b", "1,猫", "2,"]


def test_markup(spark):
    df = spark.createDataFrame([("# a",), ("**b** <i> `c` *d*",), ("",), ("| x |",), ("- y",), ("---",)], "t string")
    got = [(r.k, r.h) for r in df.select(sinks.markup_line("t").alias("k"), sinks.inline_markup("t").alias("h")).collect()]
    assert [k for k, _ in got] == ["heading", "text", "blank", "table", "item", "rule"]
    assert got[1][1] == "<strong>b</strong> &lt;i&gt; <code>c</code> <em>d</em>"


def test_registration_and_blanks(spark):
    df = spark.createDataFrame([("a", "x", "holdout"), ("b", "x", "train"), ("c", None, "train")], "academy_id string, s string, use_flag string")
    out = json.loads(sinks.registration(df, "s").first()[0])
    assert (out["rows"], out["holdout"], out["strata"]["x"]) == (3, 1, {"n": 2, "h": 1})
    rows = spark.createDataFrame([(" a ", 1), (" ", None), (None, None)], "t string, n int")
    assert [tuple(r) for r in files.stripped_rows(rows).collect()] == [("a", "1")]


def test_raster_lines(spark, tmp_path):
    image = np.full((1000, 800), 230, dtype=np.uint8)
    bands = [0, 0.1, 0.2, 0.35, 0.5, 0.75, 1]
    for y in (50 + int(900 * b) for b in bands):
        image[y - 1 : y + 2, 100:741] = 20
    for x in range(100, 741, 80):
        image[50:951, x - 1 : x + 2] = 20
    (tmp_path / "page.pgm").write_bytes(rasters.encode_pgm(image))
    (tmp_path / "bad.pgm").write_bytes(b"P5\n10 10\n255\n1")
    (tmp_path / "blank.pgm").write_bytes(rasters.encode_pgm(np.full((50, 50), 200, dtype=np.uint8)))
    lines = rasters.detected_lines(spark, str(tmp_path)).where("path LIKE '%page.pgm'")
    assert sorted(r.pos for r in lines.where("axis = 'v'").collect()) == [float(x) for x in range(100, 741, 80)]
    fractions = sorted(r.fraction for r in band_fractions(lines).collect())
    assert np.allclose(fractions, bands, atol=0.002)
    assert lines.select("skew").distinct().collect()[0][0] == 0.0
    assert rasters.decode_pgm(b"") is None and rasters.decode_pgm(b"P5 # x") is None


def test_streams(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/observation.parquet")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    readings = readings_stream(spark, folder, source.schema)

    def run(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    n = source.select("obs_id").distinct().count()
    assert run(progress_stream(readings), "complete", "progress").agg({"readings": "sum"}).first()[0] == n
    assert run(sessions_stream(readings), "append", "sessions").columns
    assert run(breaks_stream(readings), "append", "breaks").where("seniority_no > previous").count() == 0


def test_folders_of_files(spark, tmp_path):
    chunks = spark.createDataFrame([("v1", 0, "a\nb"), ("v1", 1, "c"), ("v2", 0, "d")], "volume string, chunk int, body string")
    sinks.chunk_files(chunks, str(tmp_path / "t"), "volume", "chunk", "body")
    texts = files.whole_texts(spark, str(tmp_path / "t" / "volume=*" / "chunk=*"))
    assert sorted(r.text.strip() for r in texts.collect()) == ["a\nb", "c", "d"]
    sinks.export_json(chunks, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.export_folder(chunks, str(tmp_path / "c"), "volume")
    assert spark.read.option("header", True).csv(str(tmp_path / "c" / "volume=v2")).count() == 1
    html = spark.createDataFrame([("<a href='/x/y.PDF'>z</a>",), ("none",)], "html string")
    assert [r[0] for r in html.select(files.pdf_path("html")).collect()] == ["/x/y.PDF", None]

"""Consistent form of text."""

from __future__ import annotations

import pytest

from inkledger.functions.text import repair


@pytest.mark.parametrize(
    ("token", "form"),
    [
        ("\u041d\u0456\u0455hir\u043eT\u0430k\u0430\u043emi", "HishiroTakaomi"),
        ("\u041d\u0456\u0455hir\u043e", "Hishiro"),
        ("ニ坂", "二坂"),
        ("カツ二コ", "カツニコ"),
        ("abc", "abc"),
        ("", ""),
    ],
)
def test_script_of_a_mixed_token(token, form):
    assert repair(token) == form


def test_labels_entries_and_boxes(spark):
    from pyspark.sql import functions as F

    from inkledger.functions import readings as T

    rows = [("官報 1922年04月03日", "叙任/12 (0007.jp2)"), ("1922年13月03日", "目次 (0001.jp2)"), ("x", "目次 (1.png)"), (None, None)]
    df = spark.createDataFrame(rows, "label string, entry string")
    got = [(str(r.d) if r.d else None, tuple(r.e)) for r in df.select(T.label_date("label").alias("d"), T.contents_entry("entry").alias("e")).collect()]
    assert got == [("1922-04-03", ("叙任", 12, 7)), (None, ("目次", None, 1)), (None, (None, None, None)), (None, (None, None, None))]
    boxes = [
        ("540", 0.4, 10.0, "seniority"), ("540", 0.9, 10.0, "other"), ("５４", 0.9, 10.0, "cohort"), ("明三三、八、二", 0.5, 10.0, "date"), ("明一〇、", 0.7, 10.0, "birth"), ("勲四", 0.6, 10.0, "honours"), ("勲四", 0.5, 10.0, "other"),
        ("ヤマダ", 0.6, 10.0, "reading"), ("第一支所長", 0.5, 10.0, "post"), ("山田太郎", 0.7, 14.0, "name"), ("山田太郎", 0.7, 10.0, "other"), ("同山田", 0.7, 14.0, "other"), ("山、田", 0.7, 14.0, "other"), (" ", 0.7, 14.0, None), (None, 0.7, 14.0, None),
    ]
    df = spark.createDataFrame(boxes, "t string, y double, w double, k string")
    assert [r.x for r in df.select(T.box_field(F.col("t"), F.col("y"), F.col("w"), F.lit(10.0)).alias("x")).collect()] == [b[3] for b in boxes]
    numbers = spark.createDataFrame([("５４０", 540, None), ("54x", None, "not a plain number"), (None, None, "not a plain number")], "t string, v long, r string")
    assert all((r.p.value, r.p.reason) == (r.v, r.r) for r in numbers.select("v", "r", T.plain_number(F.col("t")).alias("p")).collect())
    marks = [("山(注)田[?]〓太郎A1", "山田太郎A1"), ("山（注）田 、", "山注田、"), ("〔?〕山〔田〕", "山〔田〕"), ("山(\n注)田", "山田"), ("", ""), (None, None)]
    df = spark.createDataFrame(marks, "t string, s string")
    assert [r.x for r in df.select(T.strip_marks("t").alias("x")).collect()] == [m[1] for m in marks]
    pairs = spark.createDataFrame([("沢田亀良", "澤田亀良", 1.0), (" ｻﾜﾀﾞ", "サワダ", 1.0), ("", "澤", 0.0), (None, "澤", 0.0), ("牛嶋満", "牛島満", 2 / 3)], "a string, b string, s double")
    score = T.folded_similarity({"沢": "澤"})
    assert all(abs(r.x - r.s) < 1e-9 for r in pairs.select("s", score(F.col("a"), F.col("b")).alias("x")).collect())
    fold = T.canonical({"沢": "澤", "澤": "x"})
    assert [r.x for r in pairs.select(fold(F.col("a")).alias("x")).collect()][:2] == ["澤田亀良", "サワダ"]

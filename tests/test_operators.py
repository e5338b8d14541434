"""Golden cases of the sequence, matching, validation, geometry and record operators."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkledger.functions import readings as T
from inkledger.operators import geometry as G
from inkledger.operators import history as H
from inkledger.operators import matching as M
from inkledger.operators import planned as P
from inkledger.operators import records as R
from inkledger.operators import sequences as S
from inkledger.operators import vocabularies as V


def _page(spark, values):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "page string, row int, v int")


def test_breaks(spark):
    breaks = lambda vs: [(r.previous, r.v) for r in S.sequence_breaks(_page(spark, vs), ["page"], ["row"], "v").orderBy("row").collect()]
    assert breaks([540, *range(1077, 1085)]) == []
    assert breaks([110, 11, 112, 113, 114, 117, 118, 119, 121, 123]) == [(110, 11)]
    assert breaks([540, 541, 541]) == [(541, 541)]
    assert breaks([540, None, 542]) == [] and breaks([]) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=12))
def test_breaks_like_a_scan(spark, values):
    want, last = [], None
    for i, v in enumerate(values):
        if v is not None:
            if last is not None and v <= last:
                want.append(i)
            last = v
    assert [r.row for r in S.sequence_breaks(_page(spark, values), ["page"], ["row"], "v").orderBy("row").collect()] == want


def test_recovered_numbers(spark):
    cases = [("12", 113, 111, 112), ("11", 112, 110, 111), ("112", 113, 111, None), ("11", 112, 111, None), ("5", 500, 400, None), ("12", None, 111, None), ("一二", 113, 111, None), ("", 113, 111, None), (None, 113, 111, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, r string, p bigint, f bigint")
    got = {r.i: r.x for r in df.select("i", S.recovered(F.col("r"), F.col("p"), F.col("f")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_carry_forward_and_gaps(spark):
    df = spark.createDataFrame([("p", 0, "a", None), ("p", 1, "", "x"), ("p", 2, None, ""), ("q", 0, None, None)], "page string, row int, r string, b string")
    got = [(r.r_carried, r.b_carried) for r in S.carried_forward(df, ["page"], ["row"], ["r", "b"]).orderBy("page", "row").collect()]
    assert got == [("a", None), ("a", "x"), ("a", "x"), (None, None)]
    filled = S.fill_gaps(_page(spark, [3, 6, 20, None]), ["page"], "v", 5).orderBy("v").collect()
    assert [(r.v, r.interpolated) for r in filled] == [(3, False), (4, True), (5, True), (6, False), (20, False)]


def test_numbers_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("IF(id % 10 = 0, 'cold', 'hot') AS k", "id * 7919 % 5003 AS v")
    got = S.spread_numbers(df, ["k"], ["v"], "n", parts=7)
    want = df.selectExpr("k", "v", "row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS n")
    assert got.select("k", "v", "n").exceptAll(want).isEmpty() and got.count() == 5000
    assert S.spread_numbers(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_margins(spark):
    cases = [(1.0, 0.75, "PROBABLE"), (0.95, 0.94, "AMBIGUOUS"), (0.444, None, "NO_MATCH"), (1.0, None, "PROBABLE"), (0.95, 0.80, "AMBIGUOUS")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b double, r double, s string")
    assert all(r.x == r.s for r in df.select("s", M.margin_status(F.col("b"), F.col("r")).alias("x")).collect())


def test_lexicon(spark):
    """Both sides are folded for the comparison; what is given back is the entry as it stands."""
    score = T.folded_similarity({"澤": "沢", "濱": "浜"})
    lexicon = spark.createDataFrame([(n, i) for i, n in enumerate(["富永信政", "富永政雄", "牛島満", "黒田重徳", "澤田亀良"])], "entry string, ordinal int")
    readings = spark.createDataFrame([("牛島満",), ("沢田亀良",), ("",), ("東京",), (None,), ("牛嶋満",)], "reading string")
    got = {r.reading: (r.status, r.best) for r in M.suggestions(M.lexicon_matches(readings, lexicon, score), readings).collect()}
    assert got["牛島満"] == ("PROBABLE", "牛島満") and got["沢田亀良"] == ("PROBABLE", "澤田亀良") and got["牛嶋満"] == ("AMBIGUOUS", "牛島満")
    assert got[""][0] == "NO_MATCH" and got["東京"] == ("NO_MATCH", None)
    pairs = spark.createDataFrame([("浜田", "浜田", 1.0), ("", "浜田", 0.0), ("abcd", "bcde", 0.75)], "a string, b string, s double")
    assert all(r.x == r.s for r in pairs.select("s", T.similarity("a", "b").alias("x")).collect())


def test_agreement(spark):
    rows = [("exact", "澤田亀良", "澤田亀良"), ("variant", "澤田亀良", "沢田亀良"), ("apart", "鎌田福市", "亀井眞清"), ("nohuman", None, "x"), ("blank", " ", "x"), ("nothing", "x", None), ("one", "x", "x"), ("one", "x", "y")]
    df = spark.createDataFrame(rows, "cell string, human string, value string")
    got = {r.cell: r.status for r in M.agreement(df, ["cell"], "human", "value", lambda c: F.translate(c, "澤", "沢")).collect()}
    assert got == {"exact": "agree", "variant": "variant_equal", "apart": "disagree", "nohuman": "no_human_value", "blank": "no_human_value", "nothing": "no_human_value", "one": "agree"}


def test_periods_and_bounds(spark):
    vocab = spark.createDataFrame([("kokuhei", "1925-05-01", None), ("hohei", None, None)], "branch_code string, valid_from string, valid_to string")
    rows = [("a", "p", "kokuhei", "1923-09-01", "1867-01-01"), ("b", "p", "kokuhei", "1926-09-01", "1921-12-01"), ("c", "p", "hohei", "1923-09-01", "1936-01-01"), ("d", "p", "homubu", "1923-09-01", None), ("e", "p", None, None, None)]
    df = spark.createDataFrame(rows, "cell_id string, page_id string, branch_code string, as_of_date string, commissioning_date string")
    assert [r.cell_id for r in V.out_of_period(df, "branch_code", "as_of_date", vocab, "f").collect()] == ["a"]
    assert sorted(r.cell_id for r in V.out_of_bounds(df, "commissioning_date", "as_of_date").collect()) == ["a", "c"]
    flags = spark.createDataFrame([("a", "p", "sequence_break", "x"), ("a", "p", "branch_out_of_period", "y"), ("b", "p", "branch_out_of_period", "z")], "cell_id string, page_id string, code string, detail string")
    assert {(r.code, r.audit_status) for r in V.validate([flags]).collect()} == {("sequence_break", "sequence_break"), ("branch_out_of_period", None)}
    assert [r.cell_id for r in V.review_queue(flags, flags.where("cell_id = 'b'")).collect()] == ["a"]


def test_hash_parts_equal_the_big_number(spark):
    import hashlib

    texts = ["", "a", "猫", "x" * 5000, "21|富永|歩兵|0"]
    got = {r.value: r.m for r in spark.createDataFrame(texts, "string").select("value", T.sha1_mod_100("value").alias("m")).collect()}
    assert got == {t: int(hashlib.sha1(t.encode()).hexdigest(), 16) % 100 for t in texts}


def _panel(spark, missing=None):
    bands = [0, 0.1, 0.2, 0.35, 0.5, 0.75, 1]
    rows = [("x", "h", 50 + 900 * b) for b in bands] + [("x", "v", 100.0 + 80 * k) for k in range(9) if k != missing]
    return spark.createDataFrame([(p, a, float(v)) for p, a, v in rows], "panel string, axis string, pos double"), bands


def test_registration(spark):
    lines, bands = _panel(spark)
    found = G.band_fractions(lines)
    templates = {"own": bands, "sparse": [0, 0.5, 1], "extra": [*bands, 0.62]}
    got = {r.template_id: r for r in G.registrations(found, templates, 0.015).collect()}
    assert (got["own"].matched, got["own"].explained) == (7, 1.0) and got["sparse"].matched == 3 and got["sparse"].explained < 0.8
    assert [r.band for r in G.nearest_bands(found, templates, 0.015).where("unmatched").collect()] == [7]
    panels = found.select("panel").distinct()
    registered = G.registrations(found, templates, 0.015)
    assert G.classify(registered, panels, {"own": (6, 0.8), "sparse": (2, 0.8)}).first().template_id == "own"
    assert G.classify(registered, panels, {"sparse": (2, 0.8)}).first().template_id is None


def test_columns_and_cells(spark):
    lines, _ = _panel(spark, missing=3)
    edges = G.column_grid(lines)
    assert [(r.edge, r.interpolated) for r in edges.orderBy("edge").collect()] == [(100.0 + 80 * k, k == 3) for k in range(9)]
    fields = spark.createDataFrame([("x", f, 0.0, 1.0, False) for f in ("a", "b")], "panel string, field string, top double, bottom double, unmatched boolean")
    cells = G.page_cells(edges, fields)
    assert cells.count() == 16 and cells.where("suspect").select("column").distinct().count() == 2
    payload = G.page_payload(cells).first()
    assert payload.officer_count == 8 and payload.needs_review and len(payload.officers[0]) == 2
    assert payload.officers[0][0]["left"] == 660.0  # the rightmost column comes first


def test_overlaps_like_a_loop(spark):
    rng = random.Random(4)
    make = lambda n: [(f"k{rng.randint(0, 2)}", s := rng.randint(0, 900), rng.choice([None, s + rng.randint(0, 300)])) for _ in range(n)]
    a, b = make(25), make(25)
    df = lambda rows: spark.createDataFrame(rows, "k string, s int, e int")
    got = P.overlapping(df(a), df(b), "k", "s", "e", 100).count()
    last = max(x[2] if x[2] is not None else x[1] for x in a + b)
    end = lambda x: last if x[2] is None else x[2]
    assert got == sum(x[0] == y[0] and x[1] <= end(y) and y[1] <= end(x) for x in a for y in b)


def test_refusals_and_marks(spark):
    from inkledger.functions.dates import era_date

    rows = [(1, "平岩〓一", "a", "b", None, "明五〇、一、一", None), (2, " ", None, None, None, None, None), (3, "x", "a", "b", "p", "明四三、一二、二六", None)]
    df = spark.createDataFrame(rows, "obs_id long, name_raw string, rank_code string, branch_code string, post string, commissioning_date string, context_era string")
    got = {r.obs_id: r for r in R.build_readings(df, era_date(F.col("commissioning_date"), F.col("context_era"))).collect()}
    assert got[1].needs_recheck == "name_raw" and got[1].flagged == "commissioning_date" and got[1].day is None
    assert got[2].is_blank and got[2].flagged == "" and str(got[3].day) == "1910-12-26" and got[3].reason is None


CAL = [f"19{y:02d}-10-01" for y in range(10, 18)]


def _history(spark, rows):
    schema = "obs_id long, person_id string, as_of_date string, rank_code string, post string, seniority_no int, created_at timestamp, valid_from string"
    obs = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    volumes = spark.createDataFrame([(f"v{i}", "retsuji", d) for i, d in enumerate(CAL)] + [("x", "other", "1909-01-01"), ("y", "retsuji", None), ("z", "retsuji", CAL[0])], "volume_id string, series string, edition_date string")
    variants = spark.createDataFrame([("渕", "淵", "n")], "variant_char string, canonical_char string, note string")
    return H.attribute_history(obs, volumes, variants)


def test_history_cases(spark):
    from datetime import datetime as d

    rows = [
        (1, "p", CAL[0], "a", "淵 部", 1, d(2024, 1, 1)), (2, "p", CAL[1], "a", "渕部", 1, d(2024, 1, 2)), (2, "p", CAL[1], "a", "渕部", 1, d(2024, 1, 2)),
        (3, "p", CAL[3], "a", "淵部", 1, d(2024, 1, 3)), (4, "p", CAL[4], "a", None, 1, d(2024, 1, 4)), (5, "p", CAL[4], "b", None, None, d(2024, 1, 5)), (6, "p", CAL[5], "b", None, None, d(2023, 1, 5)),
        (7, None, CAL[0], "a", "x", 1, d(2024, 1, 1)), (8, "q", "1910-10-02", "a", "x", 1, d(2024, 1, 1)), (9, "r", CAL[7], "a", "x" * 3000, 1, d(2024, 1, 1)),
    ]
    got = {(r.person_id, r.valid_from, r.valid_to) for r in _history(spark, rows).collect()}
    assert got == {("p", CAL[0], CAL[2]), ("p", CAL[3], CAL[4]), ("p", CAL[4], CAL[6]), ("r", CAL[7], "9999-12-31")}
    assert _history(spark, []).count() == 0


def test_history_like_a_loop(spark):
    from datetime import datetime as d

    rng = random.Random(9)
    rows, held = [], {}
    for k in range(60):
        for e, day in enumerate(CAL):
            if rng.random() < 0.7:
                state = (rng.choice("ab"), rng.choice(["x", None]), 1)
                rows.append((len(rows), f"p{k}", day, *state, d(2024, 1, 1)))
                held[f"p{k}", e] = state
    want = set()
    for k in range(60):
        start = None
        for e in range(len(CAL) + 1):
            now = held.get((f"p{k}", e))
            if start is not None and now != held[f"p{k}", start]:
                want.add((f"p{k}", CAL[start], CAL[e] if e < len(CAL) else "9999-12-31"))
                start = None
            if now and start is None:
                start = e
    assert {(r.person_id, r.valid_from, r.valid_to) for r in _history(spark, rows).collect()} == want


def test_times_of_odd_tables(spark):
    from inkledger.operators.normalise_times import normalise_times

    entered = spark.createDataFrame([(1, "大元、七、三〇", None, "u", "2024/01/01 00:00", "q"), (1, "大元、七、三〇", None, "u", "2024/01/01 00:00", "q"), (2, None, None, None, None, "q"), (3, "x" * 9000, "大", "nobody", "2024/01/01 00:00", "q")], "obs_id long, commissioning_date string, context_era string, author_user_id string, created_at string, normal string")
    officers = spark.createDataFrame([(1, ["同", "大二、一、一", None], "明一〇、一、一"), (2, None, ""), (3, [], None)], "officer_id long, dates array<string>, birth string")
    users = spark.createDataFrame([("u", "Asia/Tokyo"), ("u", "Asia/Tokyo"), ("v", "No/Where"), (None, "UTC")], "user_id string, time_zone string")
    got = {tuple(r) for r in normalise_times(entered, officers, users).collect()}
    assert got == {(1, "commissioning_date", 0, "1912-07-30"), (1, "created_at", 0, "2023-12-31T15:00:00Z"), (1, "birth", 0, "1877-01-01"), (1, "dates", 1, "1913-01-01")}
    assert normalise_times(entered.limit(0), officers.limit(0), users.limit(0)).count() == 0


def test_entries_are_guarded_and_created(spark):
    from inkledger.functions.dates import era_date
    from inkledger.operators import entries as E

    rows = [(1, "v1", 1, 0, "u1", "大五、一〇、一", "大", '{"name_raw":"low"}', " note "), (2, "v1", 1, 9, "u1", None, None, None, None), (3, "v1", 2, 0, "u1", None, None, None, None), (4, "v2", 1, 0, None, None, None, None, None), (5, "v1", 1, 1, "u2", "大五、一三、一", None, "nonsense", "")]
    entries = spark.createDataFrame(rows, "obs_id long, volume_id string, frame_no int, row_index int, author_user_id string, commissioning_date string, context_era string, field_confidence string, notes string")
    pages = spark.createDataFrame([("v1", 1, "v1:1", "1916-10-01"), ("v2", 1, "v2:1", " ")], "volume_id string, frame_no int, page_id string, edition_date string")
    cells = spark.createDataFrame([("v1:1", 0, "v1:1:0"), ("v1:1", 1, "v1:1:1"), ("v2:1", 0, "v2:1:0")], "page_id string, row_index int, cell_id string")
    seen = E.guarded(entries, pages, cells)
    assert {r.obs_id: r.reject_reason for r in seen.collect()} == {1: None, 2: E.NO_CELL, 3: E.NO_PAGE, 4: E.NO_EDITION, 5: None}
    drafts = E.created(seen.where("reject_reason IS NULL"), era_date(F.col("commissioning_date"), F.col("context_era")))
    flagged, recheck = E.marked_fields(F.col("confidence"))
    got = {r.obs_id: r for r in drafts.select("obs_id", "status", "as_of_date", "day", "confidence", flagged.alias("flagged"), recheck.alias("recheck")).collect()}
    assert str(got[1].day) == "1916-10-01" and got[1].confidence == {"name_raw": "low", "notes": "note"} and got[1].flagged == [] and got[1].status == "draft"
    assert got[5].day is None and got[5].flagged == ["commissioning_date"] and "month 13" in got[5].confidence["commissioning_date"] and got[5].recheck == []
    assert {(r.user_id, r.obs_id) for r in E.creation_log(drafts).collect()} == {("u1", 1), ("u2", 5)}
    nested = spark.createDataFrame([({"a": '{"unreadable":2}', "b": '{"unreadable":0}', "c": "x", "d": '{"refused":"r"}'},)], "confidence map<string,string>")
    assert [list(x) for x in nested.select(*E.marked_fields(F.col("confidence"))).first()] == [["d"], ["a"]]
    assert E.guarded(entries.limit(0), pages, cells).count() == 0


def test_grids_are_gated(spark):
    from inkledger.operators import geometry as G

    lines = [("p", "v", float(x)) for x in (1, 100, 200, 300, 410, 500, 990)] + [("p", "h", 0.0), ("p", "h", 50.0), ("q", "v", 100.0), ("q", "v", 300.0), ("q", "h", 5.0)]
    df = spark.createDataFrame(lines, "panel string, axis string, pos double")
    panels = spark.createDataFrame([("p", 1000.0), ("q", 1000.0)], "panel string, width double")
    inner = G.inner_rulings(df, panels)
    assert sorted(r.pos for r in inner.where("panel = 'p' AND axis = 'v'").collect()) == [100, 200, 300, 410, 500]
    edges = G.column_grid(inner)
    assert {r.panel: r.columns for r in G.grids(inner, edges).collect()} == {"p": 4}
    seen = spark.createDataFrame([("p", "t", 5, 0.1, 0.9), ("q", "t", 5, 0.1, 0.9)], "panel string, template_id string, matched int, residual double, explained double")
    counted = spark.createDataFrame([("p", 4), ("q", 1)], "panel string, columns int")
    assert {r.panel: r.template_id for r in G.classify(seen, counted, {"t": (4, 0.5, 2)}).collect()} == {"p": "t", "q": None}
    fields = spark.createDataFrame([("p", "name", 0.0, 20.0, False), ("p", "post", 20.0, 50.0, False)], "panel string, field string, top double, bottom double, unmatched boolean")
    cells = G.with_urls(G.page_cells(edges, fields), F.lit("s"), F.lit(450), F.lit(100))
    got = {(r.column, r.field): (r.cell_url, r.strip_url) for r in cells.collect()}
    assert got[3, "name"] == ("s/100,0,100,20/full/0/default.jpg", "s/100,0,100,50/full/0/default.jpg") and got[0, "post"][0].startswith("s/410,20,40,30/")
    asked = spark.createDataFrame([("p", 0, "name"), ("p", 4, "name"), ("p", 1, "rank"), ("z", 0, "name")], "panel string, column int, field string")
    errors = {(r.panel, r.column): r.error for r in G.field_errors(asked, fields, counted).collect()}
    assert errors == {("p", 4): "column out of range", ("p", 1): "unknown field", ("z", 0): "column out of range"}


def test_pages_of_two_engines(spark):
    a = spark.createDataFrame([("v", 1, "山田(注)太郎"), ("v", 2, "甲乙丙丁"), ("v", 3, "〓"), ("w", 1, None)], "k string, page int, text string")
    b = spark.createDataFrame([("v", 1, "山田太郎"), ("v", 3, "")], "k string, page int, text string")
    scores = M.page_agreement(a, b, "k", "page")
    assert {(r.k, r.page): r.score for r in scores.collect()} == {("v", 1): 1.0, ("v", 2): 0.0, ("v", 3): 1.0, ("w", 1): 1.0}
    assert {r.k: (r.pages, r.mean, r.low) for r in M.agreement_summary(scores, "k", "page").collect()} == {"v": (3, 0.666667, [2]), "w": (1, 1.0, [])}


def test_blocks_of_pages(spark):
    from inkledger.operators import harvest as H

    rows = spark.createDataFrame([("d", "preamble\n=== Image 3 ===\nline\n\nother\n=== Image 12\n"), ("e", "none"), ("f", None), ("g", "")], "doc string, text string")
    assert {(r.page_no, r.block) for r in H.text_blocks(rows, "doc", "text").collect()} == {(3, "\nline\n\nother\n"), (12, "\n")}


def test_tasks_are_queued_once(spark):
    from inkledger.operators import entries as E

    flags = spark.createDataFrame([(2, "c1", "missing_row", "19\n of 20", "missing_row"), (1, "c1", "b", "first", None), (1, "c2", "b", None, None), (1, "c3", "b", "x", None)], "check_order int, cell_id string, code string, detail string, audit_status string")
    tasks = E.tasks_of(flags, spark.createDataFrame([("c3",), ("c3",)], "cell_id string"))
    assert {tuple(r) for r in tasks.collect()} == {("c1", "b", "first", "missing_row"), ("c2", "b", "", None)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12), st.integers(0, 6)), max_size=12))
def test_overlap_totals_like_a_loop(spark, rows):
    from inkledger.operators import planned as P

    spans = [(k, s, s + n) for k, s, n in rows]
    got = {r.k: (r.pairs, r.days) for r in P.overlap_totals(spark.createDataFrame(spans, "k string, s long, e long"), "k", "s", "e").collect()}
    want = {}
    for i, (k, s, e) in enumerate(spans):
        for other, t, u in spans[i + 1 :]:
            if other == k and s <= u and t <= e:
                n, d = want.get(k, (0, 0))
                want[k] = (n + 1, d + min(e, u) - max(s, t))
    assert got == want


def test_checkpoints_need_a_shared_folder():
    from inkledger import session

    class Away:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        @staticmethod
        def getConf():
            return {}

    frame = type("D", (), {"sparkSession": type("X", (), {"sparkContext": Away})})
    with pytest.raises(RuntimeError):
        session.cut_lineage(frame)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 7), st.tuples(st.sampled_from("xy"), st.sampled_from(["p", None]), st.integers(0, 1)), max_size=8), min_size=2, max_size=4))
def test_appending_editions_gives_the_whole_history(spark, editions):
    """A history built edition by edition from stored trees equals the one built at once."""
    from inkledger.operators import history as H

    fields = "person_id string, rank_code string, post string, seniority_no int"
    frames = [spark.createDataFrame([(f"p{k}", *v) for k, v in rows.items()], fields) for rows in editions]
    days = [f"19{10 + i}-01-01" for i in range(len(editions))]
    calendar = spark.createDataFrame(list(zip(days, range(len(days)))), "as_of_date string, edition int")
    whole = [(f"p{k}", i, *v) for i, rows in enumerate(editions) for k, v in rows.items()]
    want = H.build_history(spark.createDataFrame(whole, "person_id string, edition int, rank_code string, post string, seniority_no int"), calendar)
    empty = spark.createDataFrame([], "person_id string, valid_from string, valid_to string, rank_code string, post string, seniority_no int")
    built, tree = empty, H.edition_tree(spark.createDataFrame([], fields), 1)
    for frame, day in zip(frames, days):
        built, tree = H.append_edition(built, tree, frame, day, 1)
        built = H.cut_lineage(built)
    assert sorted(map(tuple, built.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

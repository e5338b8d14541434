"""Character unification, canonical values and consensus."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from inkledger.functions.text import closed_variants, form_of
from inkledger.llm.canonical_values import BKTree, distance, map_free_values, nearest_in_shards, threshold
from inkledger.llm.consensus import annotators, consensus, krippendorff
from inkledger.llm.unify_characters import same_cell_pairs, unify

PAIRS = [("渕", "淵"), ("渊", "渕"), ("﻿營", "営"), ("郞", "\xa0郎"), ("龍", "竜"), ("龍", "竜"), ("甲", "乙"), ("乙", "甲"), ("丁", "丁"), (None, "x"), ("", "")]


def _variants(spark):
    return spark.createDataFrame([(a, b, None) for a, b in PAIRS], "variant_char string, canonical_char string, note string")


def test_closed_variants_follow_chains_and_rings():
    closed = closed_variants(PAIRS)
    assert closed["渊"] == "淵" and closed["營"] == "営" and "丁" not in closed
    assert len({closed.get("甲", "甲"), closed.get("乙", "乙")}) == 1


@pytest.mark.parametrize(("text", "form"), [("金越継ー", "金越継一"), ("ニ坂‌重 実", "二坂重実"), ("渊丸", "淵丸"), ("Ѕаsakata", "Sasakata"), ("カツヒコ", "カツヒコ"), ("カツ二コ", "カツニコ"), ("ﾊﾁ", "ハチ"), ("⿓郞", "竜郎"), ("  ", ""), ("齋", "齋"), ("Оrijо̄", "Orijō")])
def test_forms(text, form):
    assert form_of(text, str.maketrans(closed_variants(PAIRS))) == form


def test_unify_reports_its_evidence(spark):
    rows = spark.createDataFrame([(1, "二坂重実", "q"), (2, "ニ坂重実", "q"), (3, "ニ坂進", "q"), (4, "重ハ朗", "q"), (5, None, "q"), (6, " ", "q"), (7, "二坂", "q"), (7, "二坂", "q"), (8, "坂" * 3000 + "ニ", "q")], "id long, name string, form_x string")
    got = {r.id: (r.form, r.evidence) for r in unify(rows, "name", _variants(spark)).collect()}
    assert got[1] == ("二坂重実", "none") and got[2] == ("二坂重実", "word") and got[3] == ("二坂進", "pairs") and got[4] == ("重八朗", "script")
    assert got[5] == (None, None) and got[6] == ("", "none") and got[8][0].endswith("坂二")
    assert unify(rows, "name", _variants(spark)).count() == 9
    assert unify(rows.where("id > 99"), "name", _variants(spark)).count() == 0


def test_pairs_of_one_cell(spark):
    schema = "obs_id long, volume_id string, frame_no int, row_index int, name_raw string, form string"
    rows = [(1, "v", 1, 0, "二坂", ""), (2, "v", 1, 0, "ニ坂", ""), (2, "v", 1, 0, "ニ坂", ""), (3, "v", 1, 0, "二坂", ""), (4, "v", 1, 1, "ニ坂", ""), (5, "v", 1, 0, " ", ""), (6, "v", 1, 0, None, ""), (7, None, 1, 0, "二坂", ""), (8, None, 1, 0, "二 坂", "")]
    got = {tuple(r) for r in same_cell_pairs(spark.createDataFrame(rows, schema), _variants(spark)).collect()}
    assert got == {(1, 2), (2, 3)}


@settings(max_examples=300, deadline=None)
@given(*[st.text(alphabet="abc", max_size=6)] * 3)
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
    assert distance(a, c) <= distance(a, b) + distance(b, c)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="abcd", min_size=1, max_size=7), max_size=30), st.text(alphabet="abcd", max_size=7), st.integers(0, 3))
def test_tree_finds_all_within(words, word, most):
    assert BKTree(sorted(words)).within(word, most) == sorted((d, w) for w in words if (d := distance(word, w)) <= most)


def test_free_values(spark):
    sf = "/root/testdata/sf0.001"
    ranks, branches, variants = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("rank_vocab", "branch_vocab", "kanji_variant"))
    cases = {
        ("二等技師", "衛"): ("nito_gishi", "eisei"), (" Ⅱ等技師", "Rlys."): ("nito_gishi", "tetsudo"), ("secnod class  engineer", "測量部"): ("nito_gishi", "sokuryo"), ("任副監官", "accuonts"): ("fukukan", "kaikei"),
        ("IG", "works"): ("sokan", "eizen"), ("Insp.", "電​信班"): ("seikan", "denshin"), ("Sr. Insp.", "Obs."): ("joseki_kan", "kansoku"), ("２ｎｄ ｃｌ． Ｅｎｇｉｎｅｅｒ", "任鐵道科"): ("nito_gishi", "tetsudo"), ("技補", "SOKURYO"): ("gishuho", "sokuryo"),
        ("通訳官", "無所属"): ("unmatched", "unmatched"), ("〓等技師", "〓〓科"): ("unmatched", "unmatched"), ("???", "--"): ("unmatched", "unmatched"), ("x" * 5000, "科"): ("unmatched", "unmatched"),
    }
    rows = [(i, *k, "") for i, k in enumerate(cases)] + [(99, None, " ", ""), (0, *next(iter(cases)), "")]
    df = spark.createDataFrame(rows, "obs_id long, rank_code string, branch_code string, raw string")
    got = {(r.obs_id, r.field_name): r.mapped_code for r in map_free_values(df, ranks, branches, variants).collect()}
    want = {(i, f): v for i, pair in enumerate(cases.values()) for f, v in zip(("rank_code", "branch_code"), pair)}
    assert got == want
    assert map_free_values(df.where("obs_id > 100"), ranks, branches, variants).count() == 0


def test_shards_agree_with_one_tree(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9))) for _ in range(150)})
    entries = spark.createDataFrame([(w, w[:2], 1) for w in words], "spelling string, code string, value int")
    values = [w[:k] + rng.choice("xyz") + w[k + 1 :] for w in words for k in (1, 3)] + ["zzzzzz", "", None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r.value: (r.code, r.distance) for r in nearest_in_shards(df, entries, shard_size=40, block_size=60).collect()}
    for v in set(values) - {"", None}:
        found = [(d, w) for w in words if (d := distance(v, w)) <= threshold(v)]
        least = min(found, default=(None,))[0]
        codes = {w[:2] for d, w in found if d == least}
        assert got[v] == ((codes.pop(), least) if len(codes) == 1 else (None, None)), v


LABELS = "label_id long, cell_id string, user_id string, name_raw string, seniority_no int, commissioning_date string, value string"


def _made(seed, cells=300):
    rng = random.Random(seed)
    skill = {f"u{i}": a for i, a in enumerate((0.95, 0.9, 0.9, 0.5, 0.45, 0.4))}
    rows, truth, n = [], {}, 0
    for c in range(cells):
        truth[f"c{c}"] = rng.randint(100, 999)
        wrong = rng.randint(100, 999)
        for u in rng.sample(sorted(skill), 4):
            n += 1
            value = truth[f"c{c}"] if rng.random() < skill[u] else wrong if rng.random() < 0.4 else rng.randint(100, 999)
            rows.append((n, f"c{c}", u, None, value, None, "x"))
    return rows, truth, skill


def test_consensus_beats_the_majority(spark):
    rows, truth, skill = _made(1)
    df = spark.createDataFrame(rows + rows[:20], LABELS)
    got = {r.cell_id: r.consensus for r in consensus(df).where("field_name = 'seniority_no'").collect()}
    right = sum(int(got[c]) == v for c, v in truth.items())
    votes = collections.defaultdict(collections.Counter)
    for _, c, _, _, v, _, _ in rows:
        votes[c][v] += 1
    majority = sum(votes[c].most_common(1)[0][0] == v for c, v in truth.items())
    assert right > majority and right > 0.88 * len(truth)
    order = sorted(annotators(df).collect(), key=lambda r: -r.accuracy)
    assert {r.user_id for r in order[:3]} == {"u0", "u1", "u2"}


def test_consensus_of_hard_cells(spark):
    rows = [(1, "a", "u", None, None, None, ""), (2, "b", "u", "高口静嗣", 5, "昭二、一、一", ""), (3, "b", "v", "高口静", 50, None, ""), (4, "b", "w", "〓口静嗣", None, None, ""), (5, "c", "u", "x" * 4000, 1, "", "")]
    got = {(r.cell_id, r.field_name): r.consensus for r in consensus(spark.createDataFrame(rows, LABELS)).collect()}
    assert len(got) == 9 and got["a", "name_raw"] is None and got["b", "name_raw"] == "高口静嗣" and got["c", "name_raw"] == "x" * 4000
    assert got["b", "seniority_no"] == "50" and got["b", "commissioning_date"] == "昭二、一、一" and got["c", "commissioning_date"] == ""
    empty = spark.createDataFrame([], LABELS)
    assert consensus(empty).count() == 0 and annotators(empty).count() == 0 and krippendorff(empty).count() == 0


def test_alpha_against_pairs(spark):
    rows, _, _ = _made(2, 60)
    got = krippendorff(spark.createDataFrame(rows, LABELS)).where("field_name = 'seniority_no'").first()
    units = collections.defaultdict(list)
    for _, c, _, _, v, _, _ in rows:
        units[c].append(v)
    units = [u for u in units.values() if len(u) > 1]
    n = sum(map(len, units))
    observed = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units) / n
    every = [v for u in units for v in u]
    expected = sum(a != b for i, a in enumerate(every) for j, b in enumerate(every) if i != j) / (n * (n - 1))
    assert got.n_labels == n and abs(got.alpha - (1 - observed / expected)) < 1e-9


def test_long_lists_are_searched_in_shards(spark):
    """Every value of the smallest tables is mapped alike by one tree and by shards of three entries."""
    from inkledger.llm.canonical_values import map_sharded
    from inkledger.functions.text import variant_map

    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    args = [t(n) for n in ("observation_in", "rank_vocab", "branch_vocab", "kanji_variant")]
    whole = {tuple(r) for r in map_free_values(*args).collect()}
    assert whole and {tuple(r) for r in map_free_values(*args, small=5).collect()} == whole
    listed = args[2].selectExpr("branch_code AS code", "label_ja", "label_en", "variants")
    values = args[0].selectExpr("branch_code AS raw")
    cut = {tuple(r) for r in map_sharded(values, listed, variant_map(args[3]), shard_size=3, block_size=40).collect()}
    assert cut == {tuple(r) for r in map_sharded(values, listed, variant_map(args[3])).collect()}


def test_containers_do_not_depend_on_the_layout(spark):
    from inkledger.llm.containers import Limits, fill_containers
    from inkledger.llm.tokens import read_tokenizer

    rows = [(i % 40, "word " * (i % 9) + str(i % 3)) for i in range(120)] + [(7, "same text")] * 30 + [(None, "x"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pack = lambda d, **more: sorted(map(tuple, fill_containers(d, read_tokenizer(), Limits(40, 8, 30), 60, **more).collect()), key=str)
    want = pack(df)
    assert want == pack(df.repartition(5)) == pack(df.orderBy(F.desc("text")).coalesce(1)) and len(want) == len(rows)
    masked = pack(df, bears_loss=lambda piece: False)
    assert all(r[5] == 0 for r in masked) and any(r[5] for r in want)


def test_votes_of_unknown_readers_count(spark):
    from inkledger.llm.consensus import consensus, votes_of

    rows = [(1, "c", None, "甲"), (2, "c", None, "甲"), (2, "c", None, "甲"), (3, "c", "u", "乙"), (4, "d", None, "丙"), (5, "e", "u", "丁"), (6, "e", "w", "丁")]
    labels = spark.createDataFrame(rows, "label_id bigint, cell_id string, user_id string, name_raw string")
    assert votes_of(labels, ("name_raw",)).count() == 6
    got = {r.cell_id: (r.consensus, r.n_labels) for r in consensus(labels, ("name_raw",)).collect()}
    assert got["d"] == ("丙", 1) and got["e"] == ("丁", 2) and got["c"][1] == 3

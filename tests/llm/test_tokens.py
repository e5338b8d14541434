"""Encoding against the public library, containers and pieces against their limits."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkledger.llm.containers import Limits, fill_containers
from inkledger.llm.pieces import cut, split_oversized
from inkledger.llm.tokens import TOKENIZER_DIR, Vocabulary, encode_corpus, read_tokenizer

BLOB = read_tokenizer()
WORDS = Vocabulary(BLOB)
TEXTS = ["", None, "a", " ", "\n\n\n", "Hello there, it's me!  ", "日本語の字幕\r\n\r\n2\r\n00:00:01,000 --> 00:00:02,000\n<i>é́é</i>", "x" * 7000, "あ" * 5000, "😀👩‍👩‍👧 ​﻿", "a", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_same_ids_as_the_library(library):
    for text in TEXTS:
        assert WORDS.encode(text) == library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab the日本\n '!é12　😀ーst", max_size=40), st.text(alphabet="a日 \n1's", max_size=8), st.data())
def test_appends_and_edits_are_exact(text, more, data):
    import tiktoken

    from inkledger.llm.tokens import PIECES

    plain = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=WORDS.rank, special_tokens={})
    assert WORDS.encode(text) == plain.encode_ordinary(text)
    assert WORDS.append(WORDS.split(text), more) == WORDS.split(text + more)
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert WORDS.edit(WORDS.split(text), a, b, more)[0] == WORDS.split(text[:a] + more + text[b:])
    raw = text.encode()
    assert WORDS.last_tokens(raw, WORDS.last_tokens(raw[: len(raw) // 2])) == WORDS.last_tokens(raw)


def test_an_edit_splits_little_anew():
    text = "one two three four. " * 500
    pieces, anew = WORDS.edit(WORDS.split(text), 5000, 5003, "xyz")
    assert "".join(pieces) == text[:5000] + "xyz" + text[5003:] and anew < 10


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_encoded_corpus_keeps_every_row(spark):
    got = {r.doc_id: r.ids for r in encode_corpus(_documents(spark, TEXTS), BLOB).collect()}
    assert got == {i: WORDS.encode(t) for i, t in enumerate(TEXTS)}
    assert encode_corpus(_documents(spark, []), BLOB).count() == 0
    twice = _documents(spark, ["b"]).unionByName(_documents(spark, ["b"]))
    assert encode_corpus(twice, BLOB).count() == 2


def test_containers_hold_their_limits(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["word", "12", "--", "line\n"]) for _ in range(rng.randint(1, 120))) for _ in range(400)] + [None, "", "big " * 900, "7 " * 700, "same", "same"]
    limits = Limits(tokens=300, segments=12, loss_tokens=200)
    rows = fill_containers(_documents(spark, texts), BLOB, limits, block_items=250).toPandas()
    size = {i: len(WORDS.encode(t)) for i, t in enumerate(texts)}
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == size
    assert set(rows[rows.container_id.isna()].doc_id) == {i for i, n in size.items() if n == 0}
    full = rows.dropna(subset=["container_id"]).groupby("container_id").agg(t=("n_tokens", "sum"), l=("n_loss", "sum"), s=("doc_id", "size"))
    assert full.t.max() <= 300 and full.l.max() <= 200 and full.s.max() <= 12
    parts = rows[rows.doc_id.map(rows.doc_id.value_counts()) > 1]
    loss = rows.groupby("doc_id").n_loss.sum()
    assert all(size[d] > 300 or loss[d] > 200 for d in set(parts.doc_id))
    for _, own in parts.groupby("doc_id"):
        own = own.sort_values("part")
        assert (own.first_token.to_numpy()[1:] == (own.first_token + own.n_tokens).to_numpy()[:-1]).all()
    least = max(sum(size.values()) / 300, loss.sum() / 200)
    assert len(full) <= 1.12 * least + 3
    assert fill_containers(_documents(spark, []), BLOB, limits).count() == 0


def _cues(n, seed=0):
    rng = random.Random(seed)
    return "".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{' '.join(rng.choice(['so', 'it', 'was?', 'fine.']) for _ in range(rng.randint(3, 30)))}\n\n" for i in range(n))


@pytest.mark.parametrize("text", [_cues(200), "字" * 9000, "x" * 9000, "one. two? three! " * 900, "no boundary " * 900, "漢字テスト。" * 900, "\n" * 3000, _cues(3)])
def test_pieces_cover_the_text(text):
    limit, overlap = 300, 40
    found = cut(WORDS, text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for start, end, n in found:
        assert n == len(WORDS.encode(text[start:end])) <= limit
    for (a, b, _), (c, d, _) in zip(found, found[1:]):
        assert a < c <= b < d
        assert len(WORDS.encode(text[c:b])) <= overlap + 2


def test_cuts_are_at_cues_where_possible():
    text = _cues(300, 3)
    found = cut(WORDS, text, 300, 40)
    assert len(found) > 20 and all(text[:end].endswith("\n\n") for _, end, _ in found)


def test_split_table(spark):
    df = _documents(spark, [None, "", "short", _cues(100), "short"])
    rows = split_oversized(df, BLOB, 300, 40).toPandas()
    assert rows.groupby("doc_id").size().to_dict().keys() == {2, 3, 4}
    assert (rows[rows.doc_id == 2].text == "short").all()
    with pytest.raises(ValueError):
        split_oversized(df, BLOB, 300, 200)

"""Splitting oversized texts at natural boundaries, by pointer doubling.

A text's boundaries are the places between its pieces, graded: between cues (an empty line),
between lines or sentences, at white space, elsewhere.  Each boundary is joined to its farthest
legal successor: a cut ends at the farthest cue boundary within the limit, failing that at the
farthest line or sentence end, at white space, anywhere; the next cut begins at the earliest
boundary that keeps the overlap within its bound.  Squaring the table of successors again and
again gives all cuts of the greedy walk in a logarithmic number of steps, without walking.

Every piece holds at most ``limit`` tokens when encoded by itself; together the pieces cover the
whole text.  Texts within the limit are one piece; null and empty texts give none.  A run
without white space longer than the limit is cut between characters.  Repeated rows each give
their pieces.  The pass is narrow: a text is one row, and its tables are arrays of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkledger.llm.tokens import Remembered, Vocabulary, map_texts

LIMIT, OVERLAP = 1024, 96
#: Characters after which an output batch is handed on.
BATCH_CHARS = 4_000_000
#: Characters that end a sentence, and those that may follow before the cut.
_ENDS, _CLOSERS = ".?!。！？…｡", "\"'”’」』)）]"
#: Longest undivided unit, in characters, of a run without boundaries.
_UNIT = 64


def _codes(words: Vocabulary) -> Remembered:
    """Facts of a unit in one number: tokens, white space, sentence end, leading space, lines."""

    def code(unit: str) -> int:
        core = unit.rstrip(_CLOSERS)
        return len(words.pieces[unit]) | unit.isspace() << 20 | (core[-1:] in _ENDS and core != "") << 21 | unit[:1].isspace() << 22 | min(unit.count("\n"), 255) << 24

    if not hasattr(words, "unit_codes"):
        words.unit_codes = Remembered(code)
    return words.unit_codes


def units_of(words: Vocabulary, text: str) -> tuple[list[str], bool]:
    """The tokenizer's pieces, long ones divided, and whether any was."""
    pieces = words.split(text)
    if max(map(len, pieces), default=0) <= _UNIT:
        return pieces, False
    return [piece[i : i + _UNIT] for piece in pieces for i in range(0, len(piece), _UNIT)], True


def graded(codes: np.ndarray) -> np.ndarray:
    """Grade of the boundary behind each unit: 3 cue, 2 line or sentence, 1 white space, 0."""
    blank, ends, leading, lines = codes >> 20 & 1, codes >> 21 & 1, codes >> 22 & 1, codes >> 24
    before = np.concatenate([[0], (lines * blank)[:-1]])
    ahead = np.concatenate([blank[1:], [0]])
    spaced = np.concatenate([leading[1:], [1]])
    grade = np.where(ends == 1, 2, spaced)
    run = lines + before
    grade = np.where(blank == 1, np.where(run >= 2, 3, np.where(run == 1, 2, 1)), grade)
    return np.where(ahead == 1, np.minimum(grade, 1), grade)


def successors(total: np.ndarray, grade: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, next start) of the cut that begins at each boundary 0..n.

    ``total`` holds the tokens before each boundary, ``grade`` its grade.
    """
    n = len(total) - 1
    at = np.arange(n + 1)
    farthest = np.maximum(np.searchsorted(total, total + limit, side="right") - 1, np.minimum(at + 1, n))
    end = farthest.copy()
    for least in (1, 2, 3):
        nearest = np.maximum.accumulate(np.where(grade >= least, at, 0))[farthest]
        end = np.where((nearest > at) & (total[nearest] - total > overlap), nearest, end)
    end = np.where(farthest == n, n, end)
    earliest = np.searchsorted(total, total[end] - overlap, side="left")
    following = np.full(n + 2, n + 1)
    natural = np.minimum.accumulate(np.where(grade >= 2, at, n + 1)[::-1])[::-1]
    following[: n + 1] = natural
    start = following[np.minimum(earliest, n + 1)]
    start = np.where((start < end) & (total[end] - total[np.minimum(start, n)] >= overlap // 2), start, earliest)
    start = np.maximum(np.minimum(start, end), at + 1)
    return end, np.where(end == n, n, np.minimum(start, n))


def reached(following: np.ndarray) -> np.ndarray:
    """Boundaries at which the walk from the first one begins a cut, by doubling."""
    n = len(following) - 1
    seen = np.zeros(n + 1, dtype=bool)
    seen[0] = True
    jump = following.copy()
    count = 0
    while seen.sum() != count:
        count = seen.sum()
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return np.flatnonzero(seen[:n])


def cut(words: Vocabulary, text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of the pieces of a text."""
    units, divided = units_of(words, text)
    if not units:
        return []
    codes = np.fromiter(map(_codes(words).__getitem__, units), dtype=np.int64, count=len(units))
    sizes = codes & 0xFFFFF
    whole = int(sizes.sum())
    if whole <= limit and not divided:
        return [(0, len(text), whole)]
    total = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)))])
    blank = codes >> 20 & 1

    def tokens_of(start: int, stop: int) -> int:
        """Tokens of units start..stop encoded by themselves.

        Splitting looks ahead only over white space, so all but a last run of it keeps its
        pieces; where units are parts of a piece the text is encoded.
        """
        if divided:
            return len(words.encode(text[chars[start] : chars[stop]]))
        last = stop
        while last > start and blank[last - 1]:
            last -= 1
        tail = text[chars[last] : chars[stop]]
        return int(total[last] - total[start]) + (len(words.encode(tail)) if tail else 0)

    end, following = successors(total, np.concatenate([[3], graded(codes)]), limit, overlap)
    out, covered, last, shortened = [], 0, -1, False
    starts = [int(s) for s in reached(following)]
    while covered < len(units):
        start = min(starts.pop(0), covered) if starts else covered
        if shortened:  # the walk's next cut begins where this one was to end
            start = min(start, max(int(np.searchsorted(total, total[covered] - overlap)), last + 1))
        stop = planned = int(end[start])
        if stop <= covered and covered:
            continue
        while (tokens := tokens_of(start, stop)) > limit:
            if start < min(covered, stop - 1):
                start += 1  # gives up overlap before text
            else:
                stop -= 1
        if stop <= covered and covered:
            continue
        out.append((int(chars[start]), int(chars[stop]), tokens))
        covered, last, shortened = stop, start, stop < planned
    return out


def split_oversized(documents: DataFrame, blob: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, piece, first_char, end_char, n_tokens, text)`` of every text."""
    if not 0 <= 2 * overlap < limit or limit < 4 * _UNIT:
        raise ValueError("the overlap must be under half the limit, and the limit no smaller than 256")

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def filled(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "first_char", "end_char", "n_tokens", "text"])

    def split(words: Vocabulary, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text := x.as_py():
                out += [(doc_id, k, a, b, n, text[a:b]) for k, (a, b, n) in enumerate(cut(words, text, limit, overlap))]
                held += len(text)
            if held >= BATCH_CHARS:
                yield filled(out)
                out, held = [], 0
        yield filled(out)

    return map_texts(documents, ["doc_id", "text"], split, "doc_id long, piece int, first_char long, end_char long, n_tokens long, text string", blob)

"""Exact byte-pair encoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding.  The
table of these last tokens is filled left to right: of the tokens that end at a position (found
by an Aho-Corasick automaton, longest first) the valid one is that which is compatible with the
last token of the prefix before it.  Two tokens are compatible if byte-pair merging would leave
them apart; that is decided on the right edge of the first and the left edge of the second.
The encoding is read off backwards.  A table can be extended (exact appends), and a text can be
re-encoded around an edit only, up to where its pieces fall into step again.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level tokenizer splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest piece, in characters, and number of pieces that a worker remembers.
REMEMBERED_LENGTH, REMEMBERED = 64, 400_000
#: Ids after which an output batch is handed on, however many texts are left: texts differ a
#: thousandfold in length, so a number of rows bounds no memory.
BATCH_IDS = 500_000


class Remembered(dict):
    """A bounded memory of a function of short texts; ``[]`` computes what is missing."""

    def __init__(self, function: Callable[[str], object]):
        self.function = function

    def __missing__(self, text: str):
        value = self.function(text)
        if len(text) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = value
        return value


class Vocabulary:
    """Ranked byte tokens with the compatibility of pairs."""

    def __init__(self, blob: bytes):
        import ahocorasick

        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for text, r in self.rank.items():
            self.automaton.add_word(text.decode("latin-1"), (r, len(text)))
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._apart: dict[int, bool] = {}
        self._split = regex.compile(PIECES)
        self.pieces = Remembered(self.encode_piece)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        if token not in self._halves:
            text = self.token[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                ranks = [self.rank.get(parts[i] + parts[i + 1], len(self.rank)) for i in range(len(parts) - 1)]
                at = ranks.index(min(ranks))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int, store: dict[int, list]) -> list:
        """(text, rank at which it is merged away) of the tokens along one edge, outermost first."""
        if token not in store:
            edge, until, at = [], len(self.rank) + 1, token
            while True:
                edge.append((self.token[at], until))
                pair = self.halves(at)
                if pair is None:
                    break
                until, at = at, pair[side]
            store[token] = edge
        return store[token]

    def apart(self, first: int, second: int) -> bool:
        """Whether merging leaves the two tokens apart when they stand side by side.

        They are joined if a token on the right edge of the first and one on the left edge of
        the second merge while both are there.  Of equal ranks the left merge comes first.
        """
        key = first << 32 | second
        known = self._apart.get(key)
        if known is None:
            known = True
            rank = self.rank
            for a, a_until in self._edge(first, 1, self._right):
                for b, b_until in self._edge(second, 0, self._left):
                    merged = rank.get(a + b)
                    if merged is not None and merged < a_until and merged <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._apart) < 4 * REMEMBERED:
                self._apart[key] = known
        return known

    def last_tokens(self, piece: bytes, table: list[int] | None = None) -> list[int]:
        """Last token of every byte prefix; ``table`` is that of a shorter prefix to extend."""
        text = piece.decode("latin-1")
        last = list(table or [])
        done, apart = len(last), self.apart
        from_byte = max(0, done - 256)  # the longest token is shorter
        for end, (token, length) in self.automaton.iter(text, from_byte):
            if end < done or end < len(last):
                continue
            start = end + 1 - length
            if start < 0:
                continue
            if start == 0 or apart(last[start - 1], token):
                last.append(token)
        return last

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, read off its table backwards."""
        raw = piece.encode("utf-8")
        if raw in self.rank:
            return [self.rank[raw]]
        last, out, at = self.last_tokens(raw), [], len(raw)
        while at:
            out.append(last[at - 1])
            at -= len(self.token[last[at - 1]])
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        return self._split.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self._split.findall(text or ""))))

    def append(self, pieces: list[str], more: str) -> list[str]:
        """Pieces of a text that grows: only its last piece can change."""
        return pieces[:-1] + self.split((pieces[-1] if pieces else "") + more)

    def edit(self, pieces: list[str], start: int, end: int, new: str) -> tuple[list[str], int]:
        """Pieces after characters ``start:end`` became ``new``, and how many were split anew.

        Splitting starts one piece before the edit and ends where a new boundary meets an old
        one behind it: from there on nothing differs.
        """
        at, before = 0, 0
        while before < len(pieces) and at + len(pieces[before]) < start:
            at += len(pieces[before])
            before += 1
        if before:
            before -= 1
            at -= len(pieces[before])
        text = "".join(pieces[before:])
        changed = text[: start - at] + new + text[end - at :]
        old, pos = {}, at
        for k in range(before, len(pieces)):
            if pos >= end:
                old[pos + len(new) - (end - start)] = k
            pos += len(pieces[k])
        out, pos = [], at
        for match in self._split.finditer(changed):
            if pos in old and pos >= start + len(new):
                return pieces[:before] + out + pieces[old[pos] :], len(out)
            out.append(match[0])
            pos += len(match[0])
        return pieces[:before] + out, len(out)


@functools.lru_cache(maxsize=4)
def vocabulary(blob: bytes) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(blob)


def read_tokenizer(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> bytes:
    """The vocabulary file, read on the driver (under a megabyte) and sent with the tasks."""
    return (Path(folder) / name).read_bytes()


def map_texts(df: DataFrame, columns: list[str], function: Callable[[Vocabulary, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, blob: bytes) -> DataFrame:
    """Narrow Arrow pass over some columns with the vocabulary at hand."""
    shared = df.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            yield from function(words, batch)

    return df.select(*columns).mapInArrow(run, schema)


def encode_corpus(documents: DataFrame, blob: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row; null, empty and repeated texts each keep their row.

    Shuffle-free: each worker splits its texts and looks pieces up in a bounded memory, so only
    pieces not met before go through the dynamic program.
    """

    def encode(words: Vocabulary, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def filled(first: int, end: int) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.frombuffer(values, dtype=np.int32) if values else np.zeros(0, dtype=np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), ids], names=["doc_id", "ids"])

        first, offsets, values = 0, [0], array("i")
        for at, x in enumerate(batch.column(1)):
            values.extend(chain.from_iterable(map(words.pieces.__getitem__, words.split(x.as_py() or ""))))
            offsets.append(len(values))
            if len(values) >= BATCH_IDS:
                yield filled(first, at + 1)
                first, offsets, values = at + 1, [0], array("i")
        if len(offsets) > 1:
            yield filled(first, batch.num_rows)

    return map_texts(documents, [key, text], encode, "doc_id long, ids array<int>", blob)

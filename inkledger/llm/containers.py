"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item has three sizes: tokens, segments (one) and loss-bearing tokens (those of pieces for which
the caller's ``bears_loss`` holds; by default those with a letter, as cue numbers and times carry no
loss).  A container limits all three at once.  Of the
items that still fit, the one whose sizes point most in the direction of the room left (largest
dot product, weighted by scarcity) goes in; when none fits the container is closed.

Texts beyond a limit on their own are divided into parts that fill it, and only those.  Items
are spread by a hash of their key over blocks of bounded size, each a fair sample of all, so
blocks are packed independently; only the last containers of a block have room left, which is
little beside the hundreds before it.  Null and empty texts need no room: they are listed with
no container.  Rows of one id are items of their own; where items are equal, which of them is meant
makes no difference, so containers do not depend on how the input is laid out in files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.tokens import Remembered, Vocabulary, map_texts
from inkledger.session import cut_lineage


class Limits(NamedTuple):
    """What a container holds at most."""

    tokens: int = 8192
    segments: int = 64
    loss_tokens: int = 6144


#: Items of one block: bounds a task's memory and its work, quadratic in this number.
BLOCK_ITEMS = 6000


#: Equal items that one row stands for while they are spread.
COPIES = 10_000


def has_letter(piece: str) -> bool:
    return any(map(str.isalpha, piece))


def measured_items(documents: DataFrame, blob: bytes, limits: Limits, bears_loss: Callable[[str], bool] = has_letter) -> DataFrame:
    """``(doc_id, part, first_token, n_tokens, n_loss)``; several parts only beyond a limit."""

    def measure(words: Vocabulary, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(words, bears_loss)
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = words.split(text or "")
            packed_sizes = np.fromiter(map(sizes.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            each, bears = packed_sizes >> 1, packed_sizes & 1
            tokens, loss = int(each.sum()), int((each * bears).sum())
            if tokens <= limits.tokens and loss <= limits.loss_tokens:
                out.append((doc_id, 0, 0, tokens, loss))
            else:
                out += [(doc_id, k, *part) for k, part in enumerate(divided(each.tolist(), bears.tolist(), limits))]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())] + [pa.array(c, pa.int64()) for c in columns[2:]], names=["doc_id", "part", "first_token", "n_tokens", "n_loss"])

    return map_texts(documents, ["doc_id", "text"], measure, "doc_id long, part int, first_token long, n_tokens long, n_loss long", blob)


def _sizes(words: Vocabulary, bears_loss: Callable[[str], bool]) -> Remembered:
    """Twice the tokens of a piece, plus one if they bear loss."""
    if getattr(words, "loss_sizes", (None,))[0] is not bears_loss:
        words.loss_sizes = (bears_loss, Remembered(lambda piece: 2 * len(words.pieces[piece]) + bool(bears_loss(piece))))
    return words.loss_sizes[1]


def spread_items(items: DataFrame, blocks: int) -> DataFrame:
    """Items with their block, by hash of what they are and, among equal ones, of their number: the same
    for every order of the rows.  Equal items are counted first, so a hot one is a single row until
    it is spread."""
    fields = items.columns
    counted = items.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n"))
    some = counted.select(*fields, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))).alias("_c"))
    each = some.select(*fields, F.explode(F.sequence(F.col("_c") * COPIES, F.least(F.col("_n"), (F.col("_c") + 1) * COPIES) - 1)).alias("_k"))
    return each.withColumn("block", F.pmod(F.xxhash64(*fields, "_k"), F.lit(blocks))).drop("_k")


def divided(sizes: list[int], bears: list[int], limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(first token, tokens, loss tokens) of parts, each as full as the limits allow.

    ``sizes`` has the tokens of the pieces, ``bears`` whether they bear loss.
    """
    first = tokens = loss = 0
    for left, bearing in zip(sizes, bears):
        while left:
            room = limits.tokens - tokens
            if bearing:
                room = min(room, limits.loss_tokens - loss)
            take = min(left, room)
            tokens, loss, left = tokens + take, loss + take * bearing, left - take
            if left:
                yield first, tokens, loss
                first, tokens, loss = first + tokens, 0, 0
    if tokens:
        yield first, tokens, loss


def packed(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each item; ``sizes`` is (items, 3) and each item fits alone."""
    capacity = np.array(limits, dtype=np.float64)
    share = sizes / capacity
    weight = share.sum(axis=0) / max(share.sum(), 1e-12)
    order = np.lexsort((np.arange(len(sizes)), -(share * weight).sum(axis=1)))
    share, container = share[order], np.full(len(sizes), -1)
    left = np.arange(len(sizes))
    number = 0
    while len(left):
        room, fits = np.ones(3), left
        while len(fits):
            best = fits[np.argmax(share[fits] @ (weight * room))]
            container[best] = number
            room = room - share[best]
            fits = fits[container[fits] < 0]
            fits = fits[(share[fits] <= room + 1e-9).all(axis=1)]
        left = left[container[left] < 0]
        number += 1
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = container
    return out


def fill_containers(documents: DataFrame, blob: bytes, limits: Limits = Limits(), block_items: int = BLOCK_ITEMS, bears_loss: Callable[[str], bool] = has_letter) -> DataFrame:
    """``(container_id, doc_id, part, first_token, n_tokens, n_loss)`` of every text and part."""
    items = cut_lineage(measured_items(documents, blob, limits, bears_loss))
    full = items.where("n_tokens > 0")
    blocks = max(1, math.ceil(full.count() / block_items))
    placed = spread_items(full, blocks)

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "part", "first_token", "n_tokens", "n_loss"], kind="stable")
        sizes = np.stack([block.n_tokens.to_numpy(), np.ones(len(block)), block.n_loss.to_numpy()], axis=1).astype(float)
        block["container_id"] = block.block * (1 << 24) + packed(sizes, limits)
        return block[["container_id", "doc_id", "part", "first_token", "n_tokens", "n_loss"]]

    schema = "container_id long, doc_id long, part int, first_token long, n_tokens long, n_loss long"
    out = placed.repartition(blocks, "block").groupBy("block").applyInPandas(pack, schema)  # a set number, so small blocks are not joined in one task
    empty = items.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container_id"), "doc_id", "part", "first_token", "n_tokens", "n_loss")
    return out.unionByName(empty)

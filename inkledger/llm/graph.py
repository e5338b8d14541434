"""Blocking and components shared by the linkage operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.session import cut_lineage, phase


def edge_tokens(core: Column, least: int = 2, frame: bool = True) -> Column:
    """Suffixes of a name and of its reversal (its beginnings), from a least length on, and its
    frame of first and last character; wildcards may not be in them."""
    size = F.length(core)
    none = F.array().cast("array<string>")
    span = F.when(size >= least, F.sequence(F.lit(least), size))
    tails = F.transform(span, lambda n: F.substr(core, size - n + 1, n))
    heads = F.transform(span, lambda n: F.substr(core, F.lit(1), n))
    ends = F.when(size >= 4, F.array(F.concat(F.substring(core, 1, 1), F.lit("~"), F.substr(core, size, F.lit(1))))) if frame else none
    every = F.array_distinct(F.concat(*[F.coalesce(part, none) for part in (tails, heads, ends)]))
    return F.filter(every, lambda t: ~t.contains("〓"))


def spare_characters(core: Column, token: Column) -> Column:
    """What rows of a common token of names must share besides it to be alike: names of over three
    characters are alike only with three in common, so one more than the two of a token.  An empty array
    where a name may be alike without: it is short, has unreadable marks, or the token is longer."""
    size, n = F.length(core), F.length(token)
    left = F.when(core.endswith(token), F.substr(core, F.lit(1), size - n)).when(core.startswith(token), F.substr(core, n + 1, size)).otherwise(F.substr(core, F.lit(2), size - 2))
    enough = (size <= 3) | core.contains("〓") | ((n >= 3) & ~token.contains("~"))
    return F.when(enough, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.split(left, ""), lambda c: c != "")))


def refined_blocks(tokens: DataFrame, most: int, first: str, second: str, rest: str | None = None) -> DataFrame:
    """``tokens`` with ``block`` and ``side`` instead of token, ``first`` and ``second``, which are
    arrays of the values that a row may have in two further fields.  Tokens may come with a side,
    ``b`` or ``r``.

    ``rest`` is the exact way for rows of a common token that agree in neither field: an array of
    values of which two rows must share one to be alike.  Rows with an empty array meet all of the token;
    those with null meet only these.  Its blocks are marked ``last`` and compared whole.

    Tokens of at most ``most`` rows are blocks as they are.  A more common one is discarded only
    after refining: its rows meet where they agree in the first field or in the second, and where
    such a block is still as large, in both, compared whole.  A row that lacks what refining needs
    meets all rows of the token, so no row loses a token because a field is null.

    Sides: rows of side ``b`` meet each other and those of side ``r``, which do not meet each other.
    Among the rows of a refined token, those that lack what refines it are ``l`` (or ``k``, if they
    were ``r``) and the others ``s`` (or ``r``): ``l`` meets all, ``k`` only ``l`` and ``s``.
    """

    def sized(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy(F.col("block").alias("_sized")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        return cut_lineage(rows.join(sizes, F.col("block") == F.col("_sized"), "left").drop("_sized"))

    def refined(rows: DataFrame, known: Column, mark: str = "") -> tuple[DataFrame, DataFrame]:
        """Blocks of each known value, and those in which rows without any meet all."""
        entry = lambda block, side: F.struct(block.alias("b"), side.alias("s"))
        opened = lambda each: rows.select(*keep, F.explode(each).alias("e")).select(*keep, F.col("e.b").alias("block"), F.col("e.s").alias("side"))
        lacks, both = F.size(known) == 0, F.col("side") == "b"
        lacking = F.when(lacks & both, "l").when(lacks, "k").when(both, "s").otherwise("r")
        return opened(F.transform(known, lambda k: entry(F.concat_ws("|", "block", F.concat(F.lit(mark), k)), F.col("side")))), opened(F.array(entry(F.concat_ws("|", "block", F.lit(mark + "~")), lacking)))

    none = F.array().cast("array<string>")
    one, two = F.coalesce(F.col(first), none), F.coalesce(F.col(second), none)
    rows = tokens.withColumnRenamed("token", "block")
    rows = rows if "side" in rows.columns else rows.withColumn("side", F.lit("b"))
    keep = [c for c in rows.columns if c not in ("block", "side")]
    judged = sized(rows)
    rare = judged.where("_n IS NULL").drop("_n")
    either = F.concat(F.transform(one, lambda v: F.concat(F.lit("1:"), v)), F.transform(two, lambda v: F.concat(F.lit("2:"), v)))
    many = judged.where("_n IS NOT NULL").drop("_n")
    common, loose = refined(many, either)
    judged = sized(common)
    both = F.flatten(F.transform(one, lambda v: F.transform(two, lambda w: F.concat_ws("|", v, w))))
    still, looser = refined(judged.where("_n IS NOT NULL"), both)
    parts = [part.withColumn("last", F.lit(False)) for part in (rare, loose, judged.where("_n IS NULL").drop("_n"), still, looser)]
    if rest is not None:
        parts += [part.withColumn("last", F.lit(True)) for part in refined(many, F.col(rest), "3:")]
    return functools.reduce(DataFrame.unionByName, parts).drop(first, second, *([rest] if rest else []))


def block_pairs(blocks: DataFrame, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Distinct pairs ``(a, b)``, smaller id first, that share a block.

    ``may`` is a cheap condition on the ``v`` that the blocks then carry; pairs that fail it go no
    further than the join, and those that pass leave it as two ids.
    """
    blocks = cut_lineage(blocks)
    take = lambda s: [F.col("id").alias(s), F.col("side").alias(f"side_{s}"), *([F.col("v").alias(f"v{s}")] if may is not None else [])]
    left, right = blocks.where("side IN ('b', 'l', 'k')").select("block", *take("a")), blocks.select("block", *take("b"))
    # A pair of two sides comes once, from b, l or k; one of equal sides from the smaller id.
    one_side = "(side_a IN ('b', 'l') AND side_b = side_a AND a < b)"
    met = left.join(right, "block").where(f"a <> b AND ({one_side} OR (side_a IN ('b', 'l') AND side_b IN ('r', 's', 'k')) OR (side_a = 'k' AND side_b = 's'))")
    if may is not None:
        met = met.where(may(F.col("va"), F.col("vb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@phase
def met_pairs(tokens: DataFrame, most: int, first: str, second: str, may: Callable[[Column, Column], Column], rest: str | None = None) -> DataFrame:
    """The pairs of the refined blocks of ``tokens``."""
    return block_pairs(refined_blocks(tokens, most, first, second, rest), may)


@phase
def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every vertex with an edge; root is the smallest id it is linked with.

    Large-star, small-star contraction on checkpointed edges, until a round changes nothing: the
    number of rounds grows with the logarithm of the longest chain, and no vertex's neighbours are
    ever gathered.
    """
    current = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    current = cut_lineage(current)
    mark = None
    while True:
        both = current.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u")
        low = both.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m")).select("w", F.least("m", "w").alias("m"))
        down = both.join(low, F.col("v") == F.col("w")).where("u > v AND u <> m").select(F.col("u").alias("x"), F.col("m").alias("y")).distinct()
        low = down.groupBy(F.col("x").alias("w")).agg(F.min("y").alias("m"))
        small = down.join(low, F.col("x") == F.col("w")).select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("v"), F.col("m").alias("u"))
        current = cut_lineage(small.where("v <> u").distinct(), over=current)
        before, mark = mark, tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    return current.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "id")

"""What agreeing fields say of a pair of records, learnt from the data without labels.

Every candidate pair has a level of likeness of its names and two further fields (a date and a
code, say), each with a few levels of agreement.  Pairs of one person and pairs of two are two
classes.  How often the fields agree, together, in pairs of two persons is counted on random pairs
of rows; how often they agree, each by itself, in pairs of one person is
learnt, by expectation and maximisation, from pairs whose names are so alike that most are one
person; and what share of each level of names is one person follows in the same way.  The result is
the log-odds of every combination.  More data have more namesakes and more names alike by chance,
and the shares fall with them: no weight here is fitted to a size.

Counts are taken over all pairs and rows; only the table of counts, one row for each combination,
reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.session import small_rows

#: Combinations that may reach the driver; there are fewer.
COMBINATIONS = 20_000
STILL, ROUNDS = 1e-9, 20_000


def random_pairs(rows: DataFrame, columns: list[str], buckets: int = 512) -> DataFrame:
    """Each row with another taken at random: columns end in _a and _b.

    Rows are spread over buckets by hash of their id and put in another order by hash within, so a
    window is short and every row takes part.
    """
    spread = rows.select("id", *columns).withColumn("_at", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(buckets)))
    window = Window.partitionBy("_at").orderBy(F.xxhash64("id", F.lit(2)), "id")
    pairs = spread.select("id", *[F.col(c).alias(f"{c}_a") for c in columns], *[F.lead(c).over(window).alias(f"{c}_b") for c in columns], F.lead("id").over(window).alias("_other"))
    return pairs.where("_other IS NOT NULL")


def counted(pairs: DataFrame, *levels: Column) -> list:
    """Number of pairs of each combination of levels."""
    named = [level.alias(f"l{i}") for i, level in enumerate(levels)]
    return small_rows(pairs.select(*named).groupBy(*[f"l{i}" for i in range(len(levels))]).agg(F.count(F.lit(1)).alias("n")), COMBINATIONS)


def table_of(rows: list, *sizes: int) -> np.ndarray:
    out = np.zeros(sizes)
    for *at, n in rows:
        out[tuple(at)] += n
    return out


def _share(counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> float:
    """Share of the first class in a mixture of two known ones, with half a pair of either added."""
    share = 0.5
    for _ in range(ROUNDS):
        belongs = share * one / (share * one + (1 - share) * two)
        new = ((counts * belongs).sum() + 0.5) / (counts.sum() + 1)
        if abs(new - share) < STILL:
            return new
        share = new
    raise ArithmeticError("the shares of a mixture have not settled")


def log_odds(counts: np.ndarray, chance: np.ndarray, anchors: tuple[int, ...], usual: tuple[np.ndarray, np.ndarray], complete: np.ndarray, trust: float = 20.0) -> np.ndarray:
    """Log-odds of one person for each (level of names, level, level).

    ``chance`` counts random pairs by the levels of both fields; ``anchors`` are the levels of names
    to learn from; ``usual`` what is expected of pairs of one person before, worth ``trust`` pairs;
    ``complete`` marks combinations (for each level of names) of the two fields whose pairs are met
    whatever token they share, from which the shares are taken.
    """
    alone = [chance.sum(axis=1 - i) + 0.5 for i in range(2)]
    other = chance + trust * np.outer(*(c / c.sum() for c in alone))
    other /= other.sum()
    seen = counts[list(anchors)].sum(axis=0)
    one, share = [u / u.sum() for u in usual], 0.9
    for _ in range(ROUNDS):
        same = np.outer(*one)
        belongs = share * same / (share * same + (1 - share) * other)
        held = seen * belongs
        new = [(held.sum(axis=1 - i) + trust * u / u.sum()) / (held.sum() + trust) for i, u in enumerate(usual)]
        moved = max(np.abs(n - o).max() for n, o in zip(new, one))
        one, share = new, (held.sum() + 0.9) / (seen.sum() + 1)
        if moved < STILL:
            break
    else:
        raise ArithmeticError("the agreement of fields has not settled")
    same = np.outer(*one)
    out = np.empty(counts.shape)
    for level, n in enumerate(counts):
        in_same, in_other = same * complete[level], other * complete[level]
        s = _share(n * complete[level], np.maximum(in_same / in_same.sum(), 1e-300), np.maximum(in_other / in_other.sum(), 1e-300))
        out[level] = np.log(s / (1 - s)) + np.log(in_other.sum() / in_same.sum()) + np.log(same) - np.log(other)
    return out


def with_value(pairs: DataFrame, name: str, table: np.ndarray, *levels: str) -> DataFrame:
    """``pairs`` with the value of a table by their levels; the table has ``COMBINATIONS`` cells at most
    and is broadcast."""
    if table.size > COMBINATIONS:
        raise ValueError(f"over {COMBINATIONS} combinations")
    at = F.col(levels[0]).cast("int")
    for level, size in zip(levels[1:], table.shape[1:]):
        at = at * size + F.col(level).cast("int")
    cells = pairs.sparkSession.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(table.ravel())], f"_at int, {name} double")
    return pairs.withColumn("_at", at).join(F.broadcast(cells), "_at").drop("_at")

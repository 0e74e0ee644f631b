"""Seeded orders without a second sort: a keyed permutation of ranks.

A rank is written as a pair of digits in a rectangle that is hardly larger than the table, and goes through rounds in which one
digit is moved by a keyed hash of the other. Each round can be undone, so the whole is a permutation of the rectangle; the
few places beyond the table are walked through until one within it is reached, which makes it one of the ranks.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators.ranking import with_rank

ROUNDS = 4
#: Steps through places beyond the table. There are no more of them than the square root of the size and one, so that walks in tables of
#: up to 3,900 rows always end here; in larger ones the share that does not is less than size ** (-WALK / 2), and is an error.
WALK = 64


def sides(size: int) -> tuple[int, int]:
    """The rectangle of a table: height and width, whose product exceeds the size by less than the height."""
    height = max(1, isqrt(max(size - 1, 0)) + 1)
    return height, max(1, -(-size // height))


def _hashed(seed: int, turn: Column, digit: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), turn.cast("string"), digit.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permuted(rank: Column, size: int, seed: int) -> Column:
    """The place of each rank from 0 to ``size`` - 1 in an order that depends on the seed; a bijection for any size."""
    height, width = sides(size)

    def turned(pair: Column, turn: Column) -> Column:
        left = (pair["l"] + _hashed(seed, 2 * turn, pair["r"])) % height
        return let(left, lambda x: F.struct(x.alias("l"), ((pair["r"] + _hashed(seed, 2 * turn + 1, x)) % width).alias("r")))

    def once(place: Column) -> Column:
        pair = F.struct(F.floor(place / width).cast("long").alias("l"), (place % width).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turned, lambda p: p["l"] * width + p["r"])

    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(rank.cast("long")), lambda place, _: F.when(place < size, place).otherwise(once(place)))
    return F.when(inside < size, inside).otherwise(F.raise_error(F.lit("a rank did not come back into the table")).cast("long"))


def in_seeded_order(df: DataFrame, key: list[Column], seed: int, name: str = "place") -> DataFrame:
    """``df`` with each row's ``place``, from 0, in an order that depends on the seed and the rows' ranks by ``key`` only, however they are
    partitioned. Rows with equal keys are told apart by nothing. An empty table gives an empty one."""
    ranked = with_rank(df, [], key, "_rank")
    size = ranked.count()  # of a table that is written already
    return ranked.withColumn(name, permuted(F.col("_rank") - 1, size, seed)).drop("_rank")


def seeded_sample(df: DataFrame, key: list[Column], target: int, seed: int) -> DataFrame:
    """``target`` rows (all, if there are fewer) drawn without replacement, each with its ``place`` in the draw. One seed's samples are nested."""
    return in_seeded_order(df, key, seed).where(F.col("place") < target)

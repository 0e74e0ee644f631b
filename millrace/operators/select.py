"""Balancing, quotas, stratified selection, nested subsets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.ranking import round_robin, with_rank


def distribution(df: DataFrame, axes: list[str]) -> DataFrame:
    """``axis``, ``bucket``, ``n`` and ``share`` of the values of several axes, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("bucket")) for a in axes]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("axis", "bucket").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("axis")))


def cap_axis(df: DataFrame, axis: str, share: float, order: list[Column]) -> DataFrame:
    """The first rows of each bucket, at most ceil(share * rows) and at least one, by ``order``; null is a bucket."""
    total = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(share))).alias("cap"))  # one row
    return with_rank(df, [axis], order, "_nth").join(F.broadcast(total)).where("_nth <= cap").drop("_nth", "cap")


def largest_remainder(shares: DataFrame, key: str, total: int) -> DataFrame:
    """``key`` and ``quota``: ``total`` dealt by ``share``, the rest to the largest fractions (ties: least key)."""
    exact = F.col("share") * total
    parts = shares.select(key, F.floor(exact + 1e-12).alias("base"), (exact - F.floor(exact + 1e-12)).alias("rest"))
    left = Window.partitionBy(F.lit(1))
    ranked = parts.select(key, "base", (F.lit(total) - F.sum("base").over(left)).alias("left"), F.row_number().over(left.orderBy(F.desc("rest"), key)).alias("nth"))
    return ranked.select(key, (F.col("base") + (F.col("nth") <= F.col("left")).cast("int")).alias("quota"))


def select_balanced(df: DataFrame, stratum: str, category: str, quotas: DataFrame, order: list[Column]) -> DataFrame:
    """Up to ``quota`` rows of each stratum, its categories taking turns; a stratum that is short gives all it has."""
    turns = round_robin(df, [stratum], category, order, "_turn")
    return turns.join(quotas, stratum).where("_turn <= quota").drop("_turn", "quota")


def shortfalls(df: DataFrame, stratum: str, quotas: DataFrame) -> DataFrame:
    """The strata that have fewer rows than their quota: ``quota``, ``there`` and ``short``. What they lack is not made up from elsewhere."""
    there = df.groupBy(stratum).agg(F.count("*").alias("there"))
    rows = quotas.join(there, stratum, "left").withColumn("there", F.coalesce("there", F.lit(0).cast("long")))
    return rows.withColumn("short", F.col("quota") - F.col("there")).where("short > 0").select(stratum, "quota", "there", "short")


def nested(df: DataFrame, order: list[Column], sizes: list[int], strict: bool = False) -> DataFrame:
    """``df`` with its rank and the least of ``sizes`` whose prefix holds the row (null beyond all). ``strict``: a size above the number of rows is
    refused; sizes are positive and differ in any case."""
    if min(sizes) < 1 or len(set(sizes)) < len(sizes):
        raise ValueError("sizes of subsets are positive and differ")
    ranked = with_rank(df, [], order)
    if strict and (n := ranked.count()) < max(sizes):  # of a table that is written already
        raise ValueError(f"a subset of {max(sizes)} rows of {n}")
    return ranked.withColumn("subset", F.coalesce(*[F.when(F.col("rank") <= n, n) for n in sorted(sizes)]))


def split(df: DataFrame, order: list[Column], share: float = 0.1) -> DataFrame:
    """``df`` with ``split``: the first round(share * rows) rows by ``order`` validate, at least one and not all; the others train."""
    ranked = with_rank(df, [], order)
    size = df.agg(F.count("*").alias("n")).select(F.least(F.greatest(F.lit(1), F.bround(F.col("n") * share, 0)), F.col("n") - 1).alias("size"))  # one row
    return ranked.join(F.broadcast(size)).withColumn("split", F.when(F.col("rank") <= F.col("size"), "validation").otherwise("train")).drop("size")

"""Samples for people to grade: stratified, deterministic, with rare kinds of rows over-represented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import with_rank

# Shares of a review sheet by kind of row, and the kinds of pressure behind them.
SHARES = {"answer_seeking": 0.30, "solved": 0.20, "almost_correct": 0.20, "injection_authority": 0.15, "other": 0.15}
ANSWER_SEEKING = ("frustrated", "repeated_answer_request", "time_pressure")
INJECTION_AUTHORITY = ("prompt_injection", "authority_override")


def seeded(seed: int, key: Column) -> Column:
    """An order that looks random and depends on the seed and the key only."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def depth_first_sample(df: DataFrame, strata: list[str], target: int, seed: int, key: str) -> DataFrame:
    """``target`` rows: the first of each stratum in the order of strata, then the second of each, and so on.

    ``row_id`` numbers them from 1. Only rows that can be chosen (the first ``target`` of a stratum) are ranked together.
    """
    nth = with_rank(df, strata, [seeded(seed, F.col(key)), F.col(key)], "_nth").where(F.col("_nth") <= target)
    return with_rank(nth, [], [F.col("_nth"), *map(F.col, strata)], "row_id").where(F.col("row_id") <= target).drop("_nth")


def review_kind(solved: Column, pressure: Column) -> Column:
    """The part of the review sheet that a row belongs to."""
    return (
        F.when(solved, "solved").when(pressure == "almost_correct", "almost_correct")
        .when(pressure.isin(*ANSWER_SEEKING), "answer_seeking").when(pressure.isin(*INJECTION_AUTHORITY), "injection_authority").otherwise("other")
    )


def quota_sample(df: DataFrame, kind: Column, target: int, seed: int, key: str, shares: dict[str, float] = SHARES) -> DataFrame:
    """``target`` rows by shares of kinds; where kinds are short, other rows fill up. ``backfilled`` says which those are.

    Shares of the target are rounded, half to even.
    """
    quota = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(round(target * s))) for k, s in shares.items()], F.lit(0))
    order = [seeded(seed, F.col(key)), F.col(key)]
    ranked = with_rank(df.withColumn("_kind", kind), ["_kind"], order, "_nth").withColumn("_over", F.col("_nth") > quota)
    place = with_rank(ranked, [], [F.col("_over"), *order], "_place")  # rows over their quota come last
    return place.where(F.col("_place") <= target).withColumnRenamed("_over", "backfilled").drop("_kind", "_nth", "_place")


def blind_sheet(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a sheet to grade, with two empty ones for the grader."""
    return df.select(*columns, F.lit("").alias("human_pass"), F.lit("").alias("human_notes"))


def examples_by_stratum(df: DataFrame, strata: Column, each: int, order: str) -> DataFrame:
    """``stratum``, ``nth`` and the columns of ``df``: the first ``each`` rows of each stratum by ``order``; ``strata`` is an array,
    as a row may be in several."""
    rows = df.select(F.explode(strata).alias("stratum"), *df.columns)
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(order))  # Spark keeps the first rows of each before the shuffle
    return rows.withColumn("nth", nth).where(F.col("nth") <= each)

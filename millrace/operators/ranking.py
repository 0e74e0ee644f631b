"""Ranks over tables of any size, without a task that holds all rows or all rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed


def with_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the rank of each row, from 1, within its keys (in the whole table if there are none).

    Rows are sorted by range, and a row's rank is its place in its partition and the rows of the partitions before.
    """
    by = [*(F.col(k) for k in keys), *order]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(df.repartitionByRange(partitions, *by).sortWithinPartitions(*by))
    place = F.monotonically_increasing_id()  # partition in the upper, row in the lower 33 bits
    rows = rows.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)).withColumn("_in_part", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in_part") + F.col("_before") + 1).drop("_place", "_part", "_in_part", "_before")
    if not keys:
        return rows
    first = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(name).alias("_first"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(first, same).select(*df.columns, (F.col(name) - F.col("_first") + 1).alias(name))


def round_robin(df: DataFrame, strata: list[str], category: str, order: list[Column], name: str = "turn") -> DataFrame:
    """``df`` with the place of each row when the categories of its strata take turns, each in its own order."""
    nth = with_rank(df, [*strata, category], order, "_nth")
    return with_rank(nth, strata, [F.col("_nth"), F.col(category)], name).drop("_nth")

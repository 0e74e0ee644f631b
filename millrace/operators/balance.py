"""Greedy balancing on several axes at once, without a task that sees all rows.

In the order of rows, a row is kept unless a bucket that it is in, on any axis, already has its cap of kept rows. A bucket
that reaches its cap stays closed, so the verdicts follow from the place at which each bucket closes. At most 1 / share
buckets of an axis can ever close; they are found one after the other: rows are dealt by range once, kept rows are
counted by range and bucket, and only the range in which the next bucket closes is looked at row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

# Largest shares of a bucket by axis.
CAPS = {"language": 0.62, "bug_category": 0.14, "pressure_type": 0.28, "difficulty": 0.50}


def _open(closed: list[tuple[str, str | None, object]]) -> Column:
    """Whether none of a row's buckets is closed at its place."""
    ok = F.lit(True)
    for axis, bucket, at in closed:
        ok &= ~(F.col(f"`{axis}`").eqNullSafe(F.lit(bucket)) & (F.col("_at") > F.lit(at)))
    return ok


def greedy_balance(df: DataFrame, order: str, shares: dict[str, float]) -> DataFrame:
    """``df`` with ``kept``; ``shares`` are the largest shares of all input rows that a bucket of an axis may have (at least one row).

    ``order`` has to tell rows apart. Null is a bucket. An empty table gives an empty one.
    """
    axes = list(shares)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(F.col(order).alias("_at"), *[F.col(f"`{a}`").cast("string").alias(a) for a in axes])
    rows = checkpointed(narrow.repartitionByRange(parts, "_at").withColumn("_part", F.spark_partition_id()))
    total = rows.count()
    caps = {a: max(1, math.ceil(s * total)) for a, s in shares.items()}
    buckets = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"`{a}`").alias("bucket"), F.lit(caps[a]).alias("cap")) for a in axes]))
    closed: list[tuple[str, str | None, object]] = []
    shut: set[tuple[str, str | None]] = set()
    while total:
        each = rows.where(_open(closed)).select("_at", "_part", buckets.alias("b")).select("_at", "_part", "b.*")
        for axis, bucket in shut:
            each = each.where(~((F.col("axis") == axis) & F.col("bucket").eqNullSafe(F.lit(bucket))))
        before = Window.partitionBy("axis", "bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = each.groupBy("_part", "axis", "bucket", "cap").agg(F.count("*").alias("n")).withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0)))
        closing = counts.where("had < cap AND had + n >= cap").agg(F.min("_part")).first()[0]
        if closing is None:
            break
        here = counts.where(F.col("_part") == closing).where("had < cap AND had + n >= cap").select("axis", F.col("bucket").alias("of"), (F.col("cap") - F.col("had")).alias("need"))
        nth = F.row_number().over(Window.partitionBy("axis", "bucket").orderBy("_at"))
        range_rows = each.where(F.col("_part") == closing).withColumn("nth", nth)
        joined = range_rows.join(here.withColumnRenamed("axis", "of_axis"), (F.col("axis") == F.col("of_axis")) & F.col("bucket").eqNullSafe(F.col("of")))
        full = joined.where("nth = need").select("axis", "bucket", "_at").collect()  # one row for each bucket that may close in this range
        at = min(r["_at"] for r in full)
        for r in full:
            if r["_at"] == at:
                closed.append((r["axis"], r["bucket"], at))
                shut.add((r["axis"], r["bucket"]))
    verdict = df.withColumn("_at", F.col(order))
    for a in axes:
        verdict = verdict.withColumn(f"_axis_{a}", F.col(f"`{a}`").cast("string"))
    renamed = [(f"_axis_{a}", b, at) for a, b, at in closed]
    return verdict.withColumn("kept", _open(renamed)).drop("_at", *[f"_axis_{a}" for a in axes])

"""What is done and what is still owed, from an append-only log of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def last_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``, pre-aggregated before the shuffle; null keys are a key."""
    best = df.groupBy(*keys).agg(F.max_by(_whole(df), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    best = df.groupBy(*keys).agg(F.min_by(_whole(df), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def resume_index(log: DataFrame, keys: list[str], kind: Column, *order: Column) -> DataFrame:
    """One row per key: ``reusable`` (its last record that is no infrastructure failure, null if there is none) and ``retry``
    (an infrastructure failure came after it, or alone)."""
    fails = kind == "infrastructure"
    at = F.struct(*order)
    return log.groupBy(*keys).agg(
        F.max_by(F.when(~fails, _whole(log)), F.when(~fails, at)).alias("reusable"),
        F.coalesce(F.max(F.when(fails, at)) > F.max(F.when(~fails, at)), F.max(fails)).alias("retry"),
    )


def done(owed: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``owed`` whose key has a reusable record."""
    return owed.join(index.where("reusable IS NOT NULL").select(*keys), keys, "left_semi")


def todo(owed: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``owed`` whose key has none."""
    return owed.join(index.where("reusable IS NOT NULL").select(*keys), keys, "left_anti")


def pending(spark_range: DataFrame, seen: DataFrame, index: Column) -> DataFrame:
    """The numbers (column id) that no row of ``seen`` has as its index."""
    taken = seen.select(index.cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return spark_range.join(taken, "id", "left_anti")


def merge_fresh(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of two tables of the same columns, the fresh row where both have one."""
    return fresh.unionByName(old.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def with_cached(df: DataFrame, cache: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """``df`` with the cached value of its key, null on a miss; of repeated keys in the cache the first that is not null by
    ``order`` (else the least value) serves."""
    at = F.struct(*order) if order else F.col(value)
    held = cache.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, at).alias(value))
    return df.join(held, key, "left")


def in_order(df: DataFrame, owed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with the ordinal ``order`` of its key in ``owed``, by which merged rows come back in the order they were asked for;
    rows whose key is not owed have none (they sort last)."""
    return df.join(owed.select(*keys, order), keys, "left")


def resume_stats(log: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """One row: records, infrastructure failures, keys, keys with a reusable record, and keys to ask for again."""
    fails = kind == "infrastructure"
    each = log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(fails).alias("failed"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("failed"), F.lit(0)).alias("infrastructure"), F.count("*").alias("keys"),
        F.count_if(F.expr("failed < n")).alias("reusable"), F.count_if(F.expr("failed = n")).alias("to_retry"),
    )


def matrix(*tables: DataFrame) -> DataFrame:
    """Every combination of rows of small tables (models, strategies) and a last one that may be large."""
    out = tables[-1]
    for small in tables[:-1][::-1]:
        out = F.broadcast(small).crossJoin(out) if small.limit(1001).count() <= 1000 else _too_many()
    return out


def _too_many() -> DataFrame:
    raise ValueError("a matrix has at most 1000 models and strategies each")

"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.session import BROADCAST_ROWS, checkpointed, shared_folder

__all__ = ["SPACE", "checkpointed", "forget", "let", "remembered", "shared_folder", "squeezed", "table", "text_key", "without_rows", "words"]

#: White space of all word and normalisation rules, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"

Made = TypeVar("Made")
_REMEMBERED: list[Callable] = []


def remembered(make: Callable[[str], Made]) -> Callable[[str], Made]:
    """``make``, whose last result a Python worker keeps from task to task, until an operator that needs none of them calls ``forget``."""
    _REMEMBERED.append(lru_cache(maxsize=1)(make))
    return _REMEMBERED[-1]


def forget() -> None:
    """Let go of what tasks of other operators have left in this worker: it lives on, and its memory counts for the tasks that follow."""
    for made in _REMEMBERED:
        made.cache_clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text (runs of characters other than white space); null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def text_key(text: Column) -> Column:
    """A key of 128 bits by which equal texts meet; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text are not among those of ``gone`` (columns _id and _key, of ``text_key``), with
    their columns unchanged."""
    gone = checkpointed(gone.select(F.col("_id").alias("_gone_id"), F.col("_key").alias("_gone_key")).distinct())
    if gone.count() <= BROADCAST_ROWS:  # then texts stay where they are
        gone = F.broadcast(gone)
    return df.join(gone, df[id_col].eqNullSafe(gone["_gone_id"]) & (text_key(df[text_col]) == gone["_gone_key"]), "left_anti")

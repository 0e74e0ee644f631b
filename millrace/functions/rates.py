"""Rates and means that are 0 over nothing, as reports want them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, total: Column) -> Column:
    """hits / total, 0 if total is 0."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def share_where(condition: Column) -> Column:
    """The share of rows for which the condition holds; null counts as no."""
    return rate(F.count_if(condition), F.count("*"))


def mean(value: Column) -> Column:
    """The mean of the values that there are, 0 if there are none."""
    return F.coalesce(F.avg(value), F.lit(0.0))

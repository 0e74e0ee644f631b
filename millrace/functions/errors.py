"""Kinds of provider errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of errors that say nothing about a model's behaviour.
INFRASTRUCTURE = (
    "credit balance", "insufficient_quota", "exceeded your current quota", "rate_limit", "ratelimiterror", "429",
    "apiconnectionerror", "apitimeouterror", "connection reset", "connection error", "timed out", "overloaded", "503",
    "502", "internalservererror", "authenticationerror", "permissiondeniederror", "missingcredentials",
    "missingdependency", "inferenceerror", "out of memory", "outofmemoryerror", "cuda error", "cuda out of memory",
    "device-side assert", "no kernel image is available",
)


def error_kind(error: Column) -> Column:
    """``none`` for null and empty errors, else ``refusal``, ``infrastructure`` or ``unknown``, the first that applies."""
    low = F.lower(error)
    infrastructure = F.lit(False)
    for marker in INFRASTRUCTURE:
        infrastructure |= F.contains(low, F.lit(marker))
    kind = F.when(F.contains(low, F.lit("refusal")), "refusal").when(infrastructure, "infrastructure").otherwise("unknown")
    return F.when(F.coalesce(error, F.lit("")) == "", "none").otherwise(kind)


def is_measured(kind: Column) -> Column:
    """Whether a record says something about the model: all kinds do but infrastructure failures."""
    return F.coalesce(kind, F.lit("none")) != "infrastructure"

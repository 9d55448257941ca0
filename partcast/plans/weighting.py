"""Design-weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def weighted_mean(value: str, weight: str = "weight") -> Column:
    return F.sum(F.col(weight) * F.col(value)) / F.sum(weight)


def kish(weight: str = "weight") -> Column:
    """Effective sample size (sum w)^2 / sum w^2."""
    return F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))

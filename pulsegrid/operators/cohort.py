"""Ranking values within cohorts on a 0-100 scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEUTRAL = 50.0


def _flat(value: Column, cohort: list) -> Column:
    """A cohort of one, of equal values, or with a value that is not finite says nothing."""
    w = W.partitionBy(*cohort)
    odd = F.max((F.isnan(value) | (F.abs(value) == float("inf"))).cast("int")).over(w) == 1
    return odd | (F.min(value).over(w) == F.max(value).over(w))


def percentile(value: Column, cohort: list) -> Column:
    """Mid-rank: those below and half of the ties."""
    below = F.rank().over(W.partitionBy(*cohort).orderBy(value)) - 1
    ties = F.count(value).over(W.partitionBy(*cohort, value))
    n = F.count(value).over(W.partitionBy(*cohort))
    return F.when(value.isNotNull(), F.when(_flat(value, cohort), NEUTRAL).otherwise((below + ties * F.lit(0.5)).cast("double") * 100.0 / n))


def min_max(value: Column, cohort: list) -> Column:
    w = W.partitionBy(*cohort)
    return F.when(_flat(value, cohort), NEUTRAL).otherwise((value - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w)) * 100)


def winsor_min_max(value: Column, cohort: list, low: float = 0.05, high: float = 0.95) -> Column:
    """Clipped to two quantiles, then min-max."""
    w = W.partitionBy(*cohort)
    lo, hi = (F.percentile(value, F.lit(q)).over(w) for q in (low, high))
    return F.when(_flat(value, cohort) | (lo == hi), NEUTRAL).otherwise((F.least(F.greatest(value, lo), hi) - lo) / (hi - lo) * 100)


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))

"""Growth, velocity, consistency and anomalies over dense monthly series, for all entities in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 1.0


def sum_between(ago: str, value: str, first: int, last: int) -> Column:
    """Sum of ``value`` over months ``first`` to ``last`` ago, inclusive; 0 is the last month."""
    return F.coalesce(F.sum(F.when(F.col(ago).between(first, last), F.col(value))), F.lit(0.0))


def log_ratio(now: Column, before: Column) -> Column:
    return F.log((now + ALPHA) / (before + ALPHA))


def growth(series: DataFrame, keys: list[str], recent: int = 3, previous: int = 3, value: str = "v") -> DataFrame:
    """recent_sum, previous_sum, growth, percent, low_sample, direction for each entity."""
    g = series.groupBy(*keys).agg(sum_between("ago", value, 0, recent - 1).alias("recent_sum"), sum_between("ago", value, recent, recent + previous - 1).alias("previous_sum"))
    change = log_ratio(F.col("recent_sum"), F.col("previous_sum"))
    return g.select(
        *keys,
        "recent_sum",
        "previous_sum",
        change.alias("growth"),
        (100 * (F.col("recent_sum") - F.col("previous_sum")) / F.greatest("previous_sum", F.lit(1.0))).alias("percent"),
        (F.col("recent_sum") + F.col("previous_sum") < 10).alias("low_sample"),
        F.when(change > 0, "rising").when(change < 0, "falling").otherwise("flat").alias("direction"),
    )


def velocity(series: DataFrame, keys: list[str], window: int = 12, value: str = "v") -> DataFrame:
    """Least-squares slope of ln(1 + v) over the last months; null under six months; R² of a flat series is 1."""
    y, x = F.log1p(F.col(value)), (F.lit(window - 1) - F.col("ago")).cast("double")
    fit = series.where(F.col("ago") < window).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.min(y).alias("lo"), F.max(y).alias("hi"))
    enough = F.col("n") >= 6
    return fit.select(
        *keys,
        F.when(enough, F.col("slope")).alias("velocity"),
        F.when(enough, F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.least(F.greatest(F.col("r2"), F.lit(0.0)), F.lit(1.0)))).alias("r2"),
        F.when(enough, (F.exp("slope") - 1) * 100).alias("velocity_pct"),
    )


def consistency(series: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Share of rising months, volatility of the steps, largest month's share, and whether it is a single spike."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(F.col("ago").desc()))
    s = series.select(*keys, F.col(value).alias("v"), step.alias("step"))
    a = s.groupBy(*keys).agg(
        F.count("step").alias("steps"),
        F.avg(F.when(F.col("step").isNotNull(), F.when(F.col("step") > 0, 1.0).otherwise(0.0))).alias("consistency"),
        F.stddev_pop("step").alias("volatility"),
        (F.max("v") / F.nullif(F.sum("v"), F.lit(0.0))).alias("largest_share"),
    )
    known = F.col("steps") >= 2
    return a.select(*keys, *[F.when(known, F.col(c)).alias(c) for c in ("consistency", "volatility", "largest_share")], F.when(known, (F.coalesce("largest_share", F.lit(0.0)) >= 0.5) & (F.col("consistency") < 0.5)).alias("single_spike"))


def spread(values: Column, centre: Column) -> Column:
    """Robust spread of an array: MAD / 0.6745, else the standard deviation, else the root of the median (1 at least)."""
    away = F.array_sort(F.transform(values, lambda x: F.abs(x - centre)))
    mad = middle(away)
    n = F.nullif(F.size(values), F.lit(0))
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / n
    dev = F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / n)
    return F.when(mad > 0, mad / 0.6745).when(dev > 0, dev).otherwise(F.sqrt(F.greatest(centre, F.lit(1.0))))


def middle(ordered: Column) -> Column:
    """Median of a sorted array of doubles."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def rolling_z(series: DataFrame, keys: list[str], before: int = 12, least: int = 6, value: str = "v") -> DataFrame:
    """Robust z of every month against the months before it; 0 with fewer than ``least`` of them."""
    w = W.partitionBy(*keys).orderBy(F.col("ago").desc()).rowsBetween(-before, -1)
    s = series.select(*keys, "month", "ago", F.col(value).alias("v"), F.array_sort(F.collect_list(F.col(value)).over(w)).alias("past"))
    s = s.select("*", middle(F.col("past")).alias("centre"))
    s = s.select("*", spread(F.col("past"), F.col("centre")).alias("spread"))
    z = F.when(F.size("past") < least, 0.0).otherwise((F.col("v") - F.col("centre")) / F.col("spread"))
    return s.select(*keys, "month", "ago", "v", z.alias("z"), F.when(F.size("past") >= least, F.col("centre")).alias("centre"), F.when(F.size("past") >= least, F.col("spread")).alias("spread"))


def anomalies(series: DataFrame, keys: list[str], threshold: float = 3.5, quiet: DataFrame | None = None) -> DataFrame:
    """Unusual months with their band, class and confidence.

    Classes in order: a zero month when every source was quiet is a collection
    gap; a fall is a drop; a month like the same month of other years is
    seasonal; a rise in the last month is emerging, one that stays at least half
    way up is persistent, any other a spike.
    """
    z = rolling_z(series, keys)
    order = W.partitionBy(*keys).orderBy(F.col("ago").desc())
    slot = W.partitionBy(*keys, F.month("month"))
    z = z.select(
        "*",
        F.lead("v", 1).over(order).alias("next1"),
        F.lead("v", 2).over(order).alias("next2"),
        ((F.sum("v").over(slot) - F.col("v")) / F.nullif(F.count("*").over(slot) - 1, F.lit(0))).alias("usual"),
    )
    if quiet is not None:
        z = z.join(quiet.select("month", F.lit(True).alias("quiet")), "month", "left")
    else:
        z = z.withColumn("quiet", F.lit(False))
    half = F.col("centre") + (F.col("v") - F.col("centre")) / 2
    stays = F.coalesce(F.col("next1") >= half, F.lit(True)) & F.coalesce(F.col("next2") >= half, F.lit(True))
    kind = (
        F.when((F.col("v") == 0) & F.coalesce("quiet", F.lit(False)), "collection_gap")
        .when(F.col("z") < 0, "drop")
        .when(F.abs(F.col("v") - F.col("usual")) <= F.col("spread"), "seasonal")
        .when(F.col("ago") == 0, "emerging")
        .when(stays, "persistent")
        .otherwise("spike")
    )
    sure = F.least(F.lit(100.0), 100 * F.least(F.lit(1.0), F.abs("z") / 7)) * F.least(F.lit(1.0), F.greatest("v", "centre") / 10)
    hit = z.where((F.abs("z") >= threshold) & F.col("centre").isNotNull())
    return hit.select(*keys, "month", "v", "z", F.greatest(F.col("centre") - threshold * F.col("spread"), F.lit(0.0)).alias("lower"), (F.col("centre") + threshold * F.col("spread")).alias("upper"), kind.alias("anomaly_class"), sure.alias("confidence"))

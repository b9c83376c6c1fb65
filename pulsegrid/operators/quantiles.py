"""Exact quantiles of large groups, without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets that a group's range is cut into.
BUCKETS = 4096


def quantiles(df: DataFrame, key: str, value: str, asked: dict[str, float]) -> DataFrame:
    """One row for each key with the interpolated quantiles asked for, by name; null values do not count.

    Rows are counted by bucket of the key's range; running counts tell which
    buckets hold the ranks on both sides of each quantile, and only rows of those
    are ranked, one bucket to a task.
    """
    v = df.select(key, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    ends = v.groupBy(key).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    placed = v.join(ends, key).select(key, "__v", at.cast("int").alias("__b"))
    counts = placed.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    run = W.partitionBy(key).orderBy("__b")
    counts = counts.select(key, "__b", (F.sum("__n").over(run) - F.col("__n")).alias("__before"), F.sum("__n").over(run).alias("__to"), F.sum("__n").over(W.partitionBy(key)).alias("__all"))
    ranks = []
    for name, p in asked.items():
        place = F.lit(p) * (F.col("__all") - 1)
        ranks += [F.struct(F.lit(name).alias("name"), F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(place).alias("rank"), (place - F.floor(place)).alias("share"))]
    wanted = counts.select(key, "__b", "__before", "__to", F.explode(F.array(*ranks)).alias("r")).where("r.rank >= __before and r.rank < __to")
    wanted = wanted.groupBy(key, "__b", "__before").agg(F.collect_list("r").alias("__r"))
    near = placed.join(wanted, [key, "__b"])
    ranked = near.withColumn("__rank", F.row_number().over(W.partitionBy(key, "__b").orderBy("__v")) - 1 + F.col("__before"))
    hits = ranked.select(key, "__v", "__rank", F.explode("__r").alias("r")).where("r.rank = __rank")
    return hits.groupBy(key).agg(*[F.sum(F.when(F.col("r.name") == name, F.col("__v") * F.col("r.share"))).alias(name) for name in asked])

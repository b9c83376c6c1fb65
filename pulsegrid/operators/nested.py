"""Nested JSON as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that are opened; what lies deeper is kept as text.
DEPTH = 6


def flatten(df: DataFrame, column: str) -> DataFrame:
    """The other columns, and path and value of every scalar in a column of JSON objects; lists of scalars are joined by commas.

    Each level is one explode of the keys that are objects; scalars leave at once.
    """
    kept = [c for c in df.columns if c != column]
    level = df.select(*kept, F.lit("").alias("__at"), F.col(column).alias("__json"))
    out = None
    for depth in range(DEPTH):
        pairs = level.select(*kept, "__at", F.explode(F.from_json("__json", "map<string,string>")).alias("__key", "value"))
        pairs = pairs.select(*kept, F.concat("__at", "__key").alias("path"), "value")
        inner = F.trim(F.col("value")).startswith("{")
        plain = pairs if depth == DEPTH - 1 else pairs.where(~F.coalesce(inner, F.lit(False)))
        items = F.transform(F.from_json("value", "array<string>"), lambda x: x)
        plain = plain.withColumn("value", F.when(F.trim(F.col("value")).startswith("["), F.array_join(items, ", ")).otherwise(F.col("value")))
        out = plain if out is None else out.unionByName(plain)
        level = pairs.where(inner).select(*kept, F.concat("path", F.lit(".")).alias("__at"), F.col("value").alias("__json"))
    return out

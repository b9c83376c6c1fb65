"""Writing tables: keyed upserts as full outer joins, partition overwrite, safe CSV cells, a star schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by ``order``, or by all its columns, so that a rerun keeps the same one."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), F.xxhash64(*df.columns)))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """All rows after the upsert, with what was done: insert, update, unchanged or keep. A replay changes nothing; of a repeated key the last row by ``order`` counts."""
    mark = lambda df, p: df.select(*keys, *[F.col(v).alias(f"{p}_{v}") for v in values], F.xxhash64(*values).alias(f"{p}_hash"), F.lit(True).alias(f"{p}_has"))
    j = mark(stored, "s").join(mark(last_of(incoming, keys, order), "i"), keys, "full_outer")
    action = F.when(F.col("s_has").isNull(), "insert").when(F.col("i_has").isNull(), "keep").when(F.col("s_hash") != F.col("i_hash"), "update").otherwise("unchanged")
    return j.select(*keys, *[F.when(F.col("i_has").isNotNull(), F.col(f"i_{v}")).otherwise(F.col(f"s_{v}")).alias(v) for v in values], action.alias("action"))


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], scope: list[str]) -> DataFrame:
    """All rows after a run wrote ``incoming``: as an upsert, but rows of a scope the run has written that it no longer has are left over, and go."""
    u = upsert(stored, incoming, keys, values)
    ran = incoming.select(*scope).distinct()
    left = u.where("action = 'keep'").join(ran, scope, "left_semi").select(*keys, *values, F.lit("delete").alias("action"))
    return u.where("action <> 'keep'").unionByName(u.where("action = 'keep'").join(ran, scope, "left_anti")).unionByName(left)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def safe_cell(c: Column) -> Column:
    """Text for spreadsheets: no control characters, no formula at the start."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.when(clean.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def number_cell(c: Column) -> Column:
    """Rounded to six places; empty where not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, 6))


def write_star_schema(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each table, and the list of them last: its presence says that the export is complete."""
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        cells = [safe_cell(F.col(c)).alias(c) if k == "string" else number_cell(F.col(c)).alias(c) if k == "double" else F.col(c).cast("int").alias(c) if k == "boolean" else F.col(c) for c, k in kinds.items()]
        df.select(*cells).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({n: df.columns for n, df in tables.items()}),)], "tables string").coalesce(1).write.mode("overwrite").text(f"{path}/_complete")


def write_lines(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each source."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")

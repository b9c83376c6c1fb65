"""Tables between steps in the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that spark.checkpoint.dir names (a temporary one where all of Spark runs on this machine), so that what follows neither repeats nor loses it."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pulsegrid-"))
    path = f"{top.rstrip('/')}/pulsegrid/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """id, component of the ends of ``edges`` (a, b): the smallest id that each reaches.

    Each round points every node to its smallest neighbour, follows the pointers
    twice and keeps edges between what they lead to; the graph shrinks at least by
    half, so rounds are logarithmic.
    """
    left = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        to = written(to, "pointers")
        for _ in range(2):
            to = to.join(to.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        to = written(to, "pointers")
        end = lambda c: to.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        left = left.join(end("a"), "a").join(end("b"), "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        left = written(left.distinct(), "edges")
        found = to.select("id", F.col("up").alias("component")) if found is None else written(found.join(to.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
    return left.select(F.col("a").alias("id"), F.col("b").alias("component")) if found is None else found

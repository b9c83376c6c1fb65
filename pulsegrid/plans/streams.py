"""Event-time windows over the events table, as the stream and the batch both give them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.sources.tables import read
from pulsegrid.streaming import windows as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, sf):
    """The zone of the session is UTC for these windows: times without a zone are cast in it."""
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark, sf):
    return S.tumbling(_events(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('day', ts) - to_days(CAST(d AS INTEGER)) AS start, count(*) AS n FROM events CROSS JOIN range(7) r(d) GROUP BY ALL")
def st_sliding(spark, sf):
    return S.sliding(_events(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def st_sessions(spark, sf):
    return S.sessions(_events(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")

"""The engine's tables over the star schema: records, links to organizations and topics, calendars.

A record is an order; its type follows the order's priority. A line item links
its record to the supplier's nation (an organization) and to the part's type (a
topic), with one row for each record, entity and kind of link.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The month in progress, which no analysis counts.
AS_OF = dt.date(2001, 8, 1)
LAST_MONTH = dt.date(2001, 7, 1)
RECORD_TYPES = ("clinical_trial", "publication", "patent", "funding", "announcement")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_type(priority):
    found = F.lit(None).cast("string")
    for n, kind in enumerate(RECORD_TYPES, 1):
        found = F.when(F.substring(priority, 1, 1) == str(n), kind).otherwise(found)
    return found


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, published_at, month, record_type, status, amount of complete months."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(AS_OF))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("published_at"),
        F.trunc("o_orderdate", "MM").alias("month"),
        record_type(F.col("o_orderpriority")).alias("record_type"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def record_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, org_id, relationship, confidence: one row for each record, organization and relationship."""
    line, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.groupBy(F.col("l_orderkey").alias("record_id"), F.col("s_nationkey").alias("org_id"), F.col("l_returnflag").alias("relationship")).agg(F.max(1 - F.col("l_discount")).alias("confidence"))


def record_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, topic, method, confidence: one row for each record, topic and method."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    return joined.groupBy(F.col("l_orderkey").alias("record_id"), F.col("p_type").alias("topic"), F.col("l_linestatus").alias("method")).agg(F.max(1 - F.col("l_tax")).alias("confidence"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: record_id, org_id, relationship, c_org, topic, method, c_topic, of one scan."""
    line, supplier, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    j = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return j.select(
        F.col("l_orderkey").alias("record_id"), F.col("s_nationkey").alias("org_id"), F.col("l_returnflag").alias("relationship"), (1 - F.col("l_discount")).alias("c_org"),
        F.col("p_type").alias("topic"), F.col("l_linestatus").alias("method"), (1 - F.col("l_tax")).alias("c_topic"),
    )


def month_list(n: int, last: dt.date = LAST_MONTH) -> list[dt.date]:
    """The last ``n`` months, oldest first."""
    at = last.year * 12 + last.month - 1
    return [dt.date((at - i) // 12, (at - i) % 12 + 1, 1) for i in range(n - 1, -1, -1)]


def months(spark: SparkSession, n: int, last: dt.date = LAST_MONTH) -> DataFrame:
    """The last ``n`` months, oldest first, with their index from 0."""
    spine = spark.range(n).select(F.add_months(F.lit(last), (F.col("id") - (n - 1)).cast("int")).alias("month"), F.col("id").cast("int").alias("idx"))
    return spine


#: The same tables for DuckDB.
PRELUDE = """
WITH records AS (
  SELECT o_orderkey AS id, o_orderdate AS published_at, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'clinical_trial' WHEN '2' THEN 'publication' WHEN '3' THEN 'patent'
      WHEN '4' THEN 'funding' WHEN '5' THEN 'announcement' END AS record_type,
    o_orderstatus AS status, o_totalprice AS amount
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01'),
record_orgs AS (
  SELECT l_orderkey AS record_id, s_nationkey AS org_id, l_returnflag AS relationship, max(1 - l_discount) AS confidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
record_topics AS (
  SELECT l_orderkey AS record_id, p_type AS topic, l_linestatus AS method, max(1 - l_tax) AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
types AS (SELECT unnest(['clinical_trial', 'publication', 'patent', 'funding', 'announcement']) AS record_type),
months AS (SELECT CAST(DATE '2001-07-01' - to_months(CAST(i AS INTEGER)) AS DATE) AS month, i AS ago FROM range(80) r(i)),
topics AS (SELECT DISTINCT topic FROM record_topics),
topic_month AS (
  SELECT topic, record_type, month, count(DISTINCT id) AS n, sum(confidence) AS w
  FROM records JOIN record_topics ON id = record_id GROUP BY ALL),
topic_source AS (
  SELECT t.topic, y.record_type, m.month, m.ago, coalesce(c.n, 0) AS n, coalesce(c.w, 0.0) AS w
  FROM topics t CROSS JOIN types y CROSS JOIN months m
  LEFT JOIN topic_month c ON c.topic = t.topic AND c.record_type = y.record_type AND c.month = m.month),
topic_series AS (SELECT topic, month, ago, CAST(sum(n) AS DOUBLE) AS v FROM topic_source GROUP BY ALL)
"""

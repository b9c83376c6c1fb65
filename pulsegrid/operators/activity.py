"""Counting records: the four breakdowns, the cube over periods, dense monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overall(records: DataFrame) -> DataFrame:
    """(month, record_type): distinct records; the weighted activity is that count."""
    n = F.count_distinct("id")
    return records.groupBy("month", "record_type").agg(n.alias("records"), n.cast("double").alias("weighted"))


def by_org(records: DataFrame, orgs: DataFrame) -> DataFrame:
    """(month, record_type, org_id): distinct records and the sum of the links' confidence."""
    joined = records.join(orgs, records["id"] == orgs["record_id"])
    return joined.groupBy("month", "record_type", "org_id").agg(F.count_distinct("id").alias("records"), F.sum("confidence").alias("weighted"))


def by_topic(records: DataFrame, topics: DataFrame) -> DataFrame:
    joined = records.join(topics, records["id"] == topics["record_id"])
    return joined.groupBy("month", "record_type", "topic").agg(F.count_distinct("id").alias("records"), F.sum("confidence").alias("weighted"))


def by_both(records: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    """Links of both kinds meet on their record: each pair weighs the product of its confidences."""
    o = orgs.select("record_id", "org_id", F.col("confidence").alias("c_org"))
    t = topics.select("record_id", "topic", F.col("confidence").alias("c_topic"))
    joined = records.join(o, records["id"] == o["record_id"]).drop("record_id").join(t, F.col("id") == t["record_id"])
    return joined.groupBy("month", "record_type", "org_id", "topic").agg(F.count_distinct("id").alias("records"), F.sum(F.col("c_org") * F.col("c_topic")).alias("weighted"))


def record_links(lines: DataFrame) -> DataFrame:
    """record_id, orgs, topics: each record's organizations and topics with their summed confidence.

    ``lines`` has record_id, org_id, relationship, c_org, topic, method, c_topic. A
    link counts once for each relationship (or method), with its best confidence.
    A record has few lines, so its links are worked out within its own row: one
    shuffle by record serves all breakdowns.
    """
    per = lines.groupBy("record_id").agg(
        F.collect_list(F.struct(F.col("org_id").alias("key"), F.col("relationship").alias("by"), F.col("c_org").alias("c"))).alias("o"),
        F.collect_list(F.struct(F.col("topic").alias("key"), F.col("method").alias("by"), F.col("c_topic").alias("c"))).alias("t"),
    )

    def weighed(links: str, name: str) -> Column:
        best = lambda kind: F.array_max(F.transform(F.filter(links, lambda y: (y["key"] == kind["key"]) & (y["by"] == kind["by"])), lambda y: y["c"]))
        kinds = F.array_distinct(F.transform(links, lambda x: F.struct(x["key"].alias("key"), x["by"].alias("by"))))
        told = F.transform(kinds, lambda k: F.struct(k["key"].alias("key"), best(k).alias("c")))
        keys = F.array_distinct(F.transform(told, lambda x: x["key"]))
        return F.transform(keys, lambda key: F.struct(key.alias(name), F.aggregate(F.filter(told, lambda x: x["key"] == key), F.lit(0.0), lambda t, x: t + x["c"]).alias("w")))

    return per.select("record_id", weighed("o", "org_id").alias("orgs"), weighed("t", "topic").alias("topics"))


def monthly_cube(records: DataFrame, links: DataFrame) -> DataFrame:
    """All four breakdowns; a null organization or topic stands for all.

    Every record brings one row for each of its cells, so counts need no
    distinct: one scan, one shuffle by record, one by cell.
    """
    j = records.join(links, records["id"] == links["record_id"], "left")
    no_org, no_topic = F.lit(None).cast("int"), F.lit(None).cast("string")
    cell = lambda org, topic, w: F.struct(org.alias("org_id"), topic.alias("topic"), w.cast("double").alias("w"))
    orgs, topics = (F.coalesce(F.col(c), F.array()) for c in ("orgs", "topics"))
    cells = F.concat(
        F.array(cell(no_org, no_topic, F.lit(1.0))),
        F.transform(orgs, lambda o: cell(o["org_id"], no_topic, o["w"])),
        F.transform(topics, lambda t: cell(no_org, t["topic"], t["w"])),
        F.flatten(F.transform(orgs, lambda o: F.transform(topics, lambda t: cell(o["org_id"], t["topic"], o["w"] * t["w"])))),
    )
    rows = j.select("month", "record_type", F.explode(cells).alias("x")).select("month", "record_type", "x.org_id", "x.topic", "x.w")
    return rows.groupBy("month", "record_type", "org_id", "topic").agg(F.count("*").alias("records"), F.sum("w").alias("weighted"))


def roll_up(cube: DataFrame) -> DataFrame:
    """Months, quarters and years: both measures are sums of months. One shuffle, whatever the number of periods."""
    periods = F.array(*[F.struct(F.lit(name).alias("period_type"), F.trunc("month", unit).alias("period")) for name, unit in (("month", "MM"), ("quarter", "QUARTER"), ("year", "YEAR"))])
    keys = [c for c in cube.columns if c not in ("month", "records", "weighted")]
    long = cube.select("*", F.explode(periods).alias("p")).select(*keys, "p.period_type", "p.period", "records", "weighted")
    return long.groupBy(*keys, "period_type", "period").agg(F.sum("records").alias("records"), F.sum("weighted").alias("weighted"))


def dense(counts: DataFrame, keys: list[str], kind: str, kinds: tuple[str, ...], spine: list, values: list[str]) -> DataFrame:
    """Every entity of ``counts`` with every kind in every month of the spine (oldest first), absent ones 0; ``ago`` counts from the last.

    A count with a null month only says that its entity exists. An entity has
    kinds times months cells at most, so it is filled within its own row: the
    counts are read once, and nothing is joined.
    """
    cell = F.struct(F.struct(F.col(kind).alias("kind"), F.col("month").alias("month")).alias("key"), F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("value"))
    wide = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull() & F.col(kind).isNotNull() & F.col("month").between(F.lit(spine[0]), F.lit(spine[-1])), cell))).alias("cells"))
    grid = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("month"), F.lit(len(spine) - 1 - i).alias("ago")) for k in kinds for i, m in enumerate(spine)])
    long = wide.select(*keys, "cells", F.explode(grid).alias("g")).select(*keys, F.col("g.kind").alias(kind), "g.month", "g.ago", F.element_at("cells", F.struct(F.col("g.kind").alias("kind"), F.col("g.month").alias("month"))).alias("x"))
    return long.select(*keys, kind, "month", "ago", *[F.coalesce(F.col(f"x.{v}"), F.lit(0.0)).alias(v) for v in values])

"""Counting queries: filters, the activity cube, series, and the aggregates beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import activity as A
from pulsegrid.sources import tables as T
from pulsegrid.sources.tables import PRELUDE, read, record_orgs, record_topics, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


def r6(c, name=None):
    return F.round(c, 6).alias(name or (c if isinstance(c, str) else "v"))


def corr(a: str, b: str):
    """The correlation as SQL has it: NaN where either is constant. Spark's own divides by zero there, even within ``when``."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


@query("SELECT id, month, record_type FROM records WHERE published_at >= TIMESTAMP '2000-01-01'")
def flt_base_records(spark, sf):
    return records(spark, sf).where(F.col("published_at") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("id", "month", "record_type")


@query("SELECT DISTINCT month, month(month) AS m, CAST(date_trunc('quarter', month) AS DATE) AS quarter, CAST(date_trunc('year', month) AS DATE) AS year FROM records")
def prj_month(spark, sf):
    r = records(spark, sf).select("month").distinct()
    return r.select("month", F.month("month").cast("long").alias("m"), F.trunc("month", "QUARTER").alias("quarter"), F.trunc("month", "YEAR").alias("year"))


@query("SELECT month, record_type, count(DISTINCT id) AS records, CAST(count(DISTINCT id) AS DOUBLE) AS weighted FROM records GROUP BY ALL")
def agg_overall(spark, sf):
    return A.overall(records(spark, sf))


@query("SELECT month, record_type, org_id, count(DISTINCT id) AS records, round(sum(confidence), 6) AS weighted FROM records JOIN record_orgs ON id = record_id GROUP BY ALL")
def agg_by_org(spark, sf):
    return A.by_org(records(spark, sf), record_orgs(spark, sf)).withColumn("weighted", F.round("weighted", 6))


@query("SELECT month, record_type, topic, count(DISTINCT id) AS records, round(sum(confidence), 6) AS weighted FROM records JOIN record_topics ON id = record_id GROUP BY ALL")
def agg_by_topic(spark, sf):
    return A.by_topic(records(spark, sf), record_topics(spark, sf)).withColumn("weighted", F.round("weighted", 6))


@query("SELECT month, record_type, org_id, topic, count(DISTINCT id) AS records, round(sum(o.confidence * t.confidence), 6) AS weighted FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL")
def agg_by_both(spark, sf):
    return A.by_both(records(spark, sf), record_orgs(spark, sf), record_topics(spark, sf)).withColumn("weighted", F.round("weighted", 6))


CUBE = """, cube AS (
  SELECT month, record_type, CAST(NULL AS INTEGER) AS org_id, CAST(NULL AS VARCHAR) AS topic, count(DISTINCT id) AS records, CAST(count(DISTINCT id) AS DOUBLE) AS weighted FROM records GROUP BY ALL
  UNION ALL SELECT month, record_type, org_id, NULL, count(DISTINCT id), sum(confidence) FROM records JOIN record_orgs ON id = record_id GROUP BY ALL
  UNION ALL SELECT month, record_type, NULL, topic, count(DISTINCT id), sum(confidence) FROM records JOIN record_topics ON id = record_id GROUP BY ALL
  UNION ALL SELECT month, record_type, org_id, topic, count(DISTINCT id), sum(o.confidence * t.confidence) FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL)
"""


def cube(spark, sf):
    return A.monthly_cube(records(spark, sf), A.record_links(T.record_lines(spark, sf)))


@query(CUBE + "SELECT month, record_type, org_id, topic, records, round(weighted, 6) AS weighted FROM cube")
def agg_activity_cube(spark, sf):
    return cube(spark, sf).withColumn("weighted", F.round("weighted", 6))


@query(
    CUBE
    + """, long AS (SELECT record_type, org_id, topic, 'month' AS period_type, month AS period, records, weighted FROM cube
  UNION ALL SELECT record_type, org_id, topic, 'quarter', CAST(date_trunc('quarter', month) AS DATE), records, weighted FROM cube
  UNION ALL SELECT record_type, org_id, topic, 'year', CAST(date_trunc('year', month) AS DATE), records, weighted FROM cube)
SELECT record_type, org_id, topic, period_type, period, CAST(sum(records) AS BIGINT) AS records, round(sum(weighted), 6) AS weighted FROM long GROUP BY ALL"""
)
def agg_rollup_periods(spark, sf):
    return A.roll_up(cube(spark, sf)).withColumn("weighted", F.round("weighted", 6))


@query("SELECT count(DISTINCT id) AS n FROM records")
def agg_count_records(spark, sf):
    return records(spark, sf).agg(F.count_distinct("id").alias("n"))


def topic_source(spark, sf, n: int = 80, back: int = 0):
    """(topic, record_type, month, ago, n, w), dense, of one scan of the links; as things stood ``back`` months before the last."""
    r, t = records(spark, sf).select("id", "record_type", "month"), record_topics(spark, sf)
    counts = t.join(r, r["id"] == t["record_id"], "left").groupBy("month", "record_type", "topic").agg(F.count_distinct("id").alias("n"), F.sum("confidence").alias("w"))
    return A.dense(counts, ["topic"], "record_type", T.RECORD_TYPES, T.month_list(n + back)[:n], ["n", "w"])


def topic_series(spark, sf, n: int = 80):
    return topic_source(spark, sf, n).groupBy("topic", "month", "ago").agg(F.sum("n").alias("v"))


@query("SELECT topic, record_type, month, round(w, 6) AS w, CAST(n AS DOUBLE) AS n FROM topic_source WHERE ago < 14")
def agg_monthly_series(spark, sf):
    return topic_source(spark, sf, 14).select("topic", "record_type", "month", r6("w"), "n")


@query("SELECT topic, month, v FROM topic_series WHERE ago < 24")
def cross_entity_month_spine(spark, sf):
    return topic_series(spark, sf, 24).select("topic", "month", "v")


WEIGHTS = {"clinical_trial": 0.3, "publication": 0.15, "patent": 0.25, "funding": 0.15, "announcement": 0.15}
_CASE = "CASE record_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"


def composite(spark, sf, n: int = 14):
    """Weighted sum of the sources, with the weights shared out over those that have any activity."""
    s = topic_source(spark, sf, n)
    weight = F.lit(None).cast("double")
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("record_type") == k, v).otherwise(weight)
    # totals of a topic's sources and of its weights are windows over its own few rows
    from pyspark.sql import Window as W

    s = s.withColumn("live", F.when(F.sum("n").over(W.partitionBy("topic", "record_type")) > 0, weight))
    s = s.withColumn("all", F.sum("live").over(W.partitionBy("topic", "month")))
    return s.where("live is not null").groupBy("topic", "month", "ago").agg(F.sum(F.col("w") * F.col("live") / F.col("all")).alias("v"))


COMPOSITE = f""", live AS (SELECT topic, record_type, {_CASE} AS weight FROM topic_source WHERE ago < 14 GROUP BY ALL HAVING sum(n) > 0),
shares AS (SELECT topic, record_type, weight / sum(weight) OVER (PARTITION BY topic) AS share FROM live),
composite AS (SELECT topic, month, ago, sum(w * share) AS v FROM topic_source JOIN shares USING (topic, record_type) WHERE ago < 14 GROUP BY ALL)
"""


@query(COMPOSITE + "SELECT topic, month, round(v, 6) AS v FROM composite")
def agg_composite(spark, sf):
    return composite(spark, sf).select("topic", "month", r6("v"))


@query(
    """, act AS (SELECT topic, org_id, sum(o.confidence * t.confidence) AS w FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id
  WHERE month > DATE '2000-07-01' GROUP BY ALL HAVING sum(o.confidence * t.confidence) >= 1),
sh AS (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS share FROM act)
SELECT topic, count(*) AS orgs, round(sum(share * share), 6) AS hhi, round(1 / sum(share * share), 6) AS effective, round(100 * (1 - exp(-(1 / sum(share * share)) / 8)), 6) AS density, round(max(share), 6) AS leader_share FROM sh GROUP BY ALL"""
)
def agg_hhi_density(spark, sf):
    r = records(spark, sf).where(F.col("month") > F.lit("2000-07-01").cast("date"))
    act = A.by_both(r, record_orgs(spark, sf), record_topics(spark, sf)).groupBy("topic", "org_id").agg(F.sum("weighted").alias("w")).where("w >= 1")
    # the totals come from the same grouped rows, so the window is over few of them
    from pyspark.sql import Window as W

    sh = act.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("topic")))
    hhi = F.sum(F.col("share") * F.col("share"))
    return sh.groupBy("topic").agg(F.count("*").alias("orgs"), r6(hhi, "hhi"), r6(1 / hhi, "effective"), r6(100 * (1 - F.exp(-(1 / hhi) / 8)), "density"), r6(F.max("share"), "leader_share"))


@query("SELECT org_id, record_type, round(sum(confidence), 6) AS weighted, count(DISTINCT id) AS records FROM records JOIN record_orgs ON id = record_id WHERE published_at >= TIMESTAMP '2000-08-06' GROUP BY ALL")
def agg_discovery_activity(spark, sf):
    r = records(spark, sf).where(F.col("published_at") >= F.lit("2000-08-06").cast("timestamp_ntz"))
    o = record_orgs(spark, sf)
    return r.join(o, r["id"] == o["record_id"]).groupBy("org_id", "record_type").agg(r6(F.sum("confidence"), "weighted"), F.count_distinct("id").alias("records"))


@query(
    """SELECT org_id, topic, CAST(count(DISTINCT id) FILTER (WHERE month > DATE '2001-01-01') AS BIGINT) AS recent,
  CAST(count(DISTINCT id) FILTER (WHERE month <= DATE '2001-01-01' AND month > DATE '1999-07-01') AS BIGINT) AS before, CAST(count(DISTINCT id) FILTER (WHERE month <= DATE '1999-07-01') AS BIGINT) AS earlier, min(month) AS first_month
  FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL"""
)
def agg_entry_totals(spark, sf):
    r, o, t = records(spark, sf), record_orgs(spark, sf), record_topics(spark, sf)
    j = r.join(o.select("record_id", "org_id"), r["id"] == F.col("record_id")).drop("record_id").join(t.select("record_id", "topic"), F.col("id") == F.col("record_id"))
    month = lambda x: F.lit(x).cast("date")
    when = lambda c: F.count_distinct(F.when(c, F.col("id")))
    return j.groupBy("org_id", "topic").agg(
        when(F.col("month") > month("2001-01-01")).alias("recent"),
        when((F.col("month") <= month("2001-01-01")) & (F.col("month") > month("1999-07-01"))).alias("before"),
        when(F.col("month") <= month("1999-07-01")).alias("earlier"),
        F.min("month").alias("first_month"),
    )


@query("SELECT org_id, max(published_at) AS last_seen FROM records JOIN record_orgs ON id = record_id GROUP BY ALL")
def agg_last_fetched(spark, sf):
    r, o = records(spark, sf), record_orgs(spark, sf)
    return r.join(o, r["id"] == o["record_id"]).groupBy("org_id").agg(F.max("published_at").alias("last_seen"))


@query(
    """SELECT s_nationkey AS org_id, round(sum(CASE WHEN o_orderdate >= TIMESTAMP '2001-02-01' THEN l_quantity ELSE 0 END), 6) AS recent, round(sum(CASE WHEN o_orderdate < TIMESTAMP '2001-02-01' THEN l_quantity ELSE 0 END), 6) AS previous
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '2000-08-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL""",
    prelude=False,
)
def agg_sum_enrolment(spark, sf):
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    o = read(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderdate") >= stamp("2000-08-01")) & (F.col("o_orderdate") < stamp("2001-08-01")))
    j = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    recent = F.col("o_orderdate") >= stamp("2001-02-01")
    return j.groupBy(F.col("s_nationkey").alias("org_id")).agg(r6(F.sum(F.when(recent, F.col("l_quantity")).otherwise(0.0)), "recent"), r6(F.sum(F.when(~recent, F.col("l_quantity")).otherwise(0.0)), "previous"))


@query("SELECT topic, CAST(count(DISTINCT id) FILTER (WHERE month > DATE '2001-04-01') AS BIGINT) AS patents FROM records JOIN record_topics ON id = record_id WHERE record_type = 'patent' GROUP BY ALL")
def agg_sum_patents(spark, sf):
    r, t = records(spark, sf).where("record_type = 'patent'"), record_topics(spark, sf)
    return r.join(t, r["id"] == t["record_id"]).groupBy("topic").agg(F.count_distinct(F.when(F.col("month") > F.lit("2001-04-01").cast("date"), F.col("id"))).alias("patents"))


@query("SELECT org_id, arg_max(status, CASE status WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS furthest FROM records JOIN record_orgs ON id = record_id GROUP BY ALL")
def agg_max_phase(spark, sf):
    r, o = records(spark, sf), record_orgs(spark, sf)
    rank = F.when(F.col("status") == "P", 1).when(F.col("status") == "O", 2).otherwise(3)
    return r.join(o, r["id"] == o["record_id"]).groupBy("org_id").agg(F.max_by("status", rank).alias("furthest"))


@query("SELECT record_type, status, count(*) AS n FROM records GROUP BY ALL")
def agg_count_by_flag(spark, sf):
    return records(spark, sf).groupBy("record_type", "status").agg(F.count("*").alias("n"))


@query("SELECT record_type, count(*) AS n, min(published_at) AS first_at, max(published_at) AS last_at, string_agg(DISTINCT status, '; ' ORDER BY status) AS statuses FROM records GROUP BY ALL")
def agg_dim_source(spark, sf):
    return records(spark, sf).groupBy("record_type").agg(F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.array_join(F.sort_array(F.collect_set("status")), "; ").alias("statuses"))


@query("SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem), (SELECT min(ts) FROM events)) AS lo, greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem), (SELECT max(ts) FROM events)) AS hi", prelude=False)
def agg_date_bounds(spark, sf):
    parts = [read(spark, sf, t).select(F.col(c).alias("at")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    b = parts[0].agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    for p in parts[1:]:
        b = b.union(p.agg(F.min("at"), F.max("at")))
    return b.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("SELECT record_type, round(median(amount), 6) AS med, round(stddev_pop(amount), 4) AS dev, round(quantile_cont(amount, 0.05), 6) AS q05, round(quantile_cont(amount, 0.95), 6) AS q95, round(mad(amount), 6) AS mad FROM records GROUP BY ALL")
def agg_distribution(spark, sf):
    """Exact quantiles by rank: values are counted by bucket first, so a task ranks the rows of the few buckets that hold a quantile only."""
    from pulsegrid.operators.quantiles import quantiles

    r = records(spark, sf).select("record_type", "amount")
    q = quantiles(r, "record_type", "amount", {"q05": 0.05, "med": 0.5, "q95": 0.95})
    dev = r.groupBy("record_type").agg(F.round(F.stddev_pop("amount"), 4).alias("dev"))
    away = r.join(F.broadcast(q.select("record_type", "med")), "record_type").select("record_type", F.abs(F.col("amount") - F.col("med")).alias("away"))
    mad = quantiles(away, "record_type", "away", {"mad": 0.5})
    return q.join(dev, "record_type").join(mad, "record_type").select("record_type", r6("med"), "dev", r6("q05"), r6("q95"), r6("mad"))


@query("SELECT event_type AS source, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_run FROM events GROUP BY ALL", prelude=False)
def agg_source_stats(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_run"))


@query("SELECT user_id AS source, count(*) AS runs, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, CASE WHEN bool_and(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY ALL", prelude=False)
def agg_run_status(spark, sf):
    bad = F.col("event_type") == "error"
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("runs"), F.count_if(bad).alias("failed"), F.when(F.every(bad), "failed").when(F.some(bad), "partial").otherwise("success").alias("status"))

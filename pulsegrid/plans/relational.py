"""Joins, top-k, paging, set operations, data quality and read queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.plans.activity import r6, topic_series
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


def date(x):
    return F.lit(x).cast("date")


# joins


@query("SELECT id, org_id, relationship, round(confidence, 6) AS confidence FROM records JOIN record_orgs ON id = record_id")
def join_record_org(spark, sf):
    r, o = records(spark, sf), record_orgs(spark, sf)
    return r.join(o, r["id"] == o["record_id"]).select("id", "org_id", "relationship", r6("confidence"))


@query("SELECT id, topic, method FROM records JOIN record_topics ON id = record_id WHERE record_type = 'patent'")
def join_record_topic(spark, sf):
    r, t = records(spark, sf).where("record_type = 'patent'"), record_topics(spark, sf)
    return r.join(t, r["id"] == t["record_id"]).select("id", "topic", "method")


@query("SELECT id, org_id, topic, count(*) AS links FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL")
def join_record_org_topic(spark, sf):
    r, o, t = records(spark, sf), record_orgs(spark, sf), record_topics(spark, sf)
    j = r.join(o.select("record_id", "org_id"), r["id"] == F.col("record_id")).drop("record_id").join(t.select("record_id", "topic"), F.col("id") == F.col("record_id"))
    return j.groupBy("id", "org_id", "topic").agg(F.count("*").alias("links"))


@query("SELECT o_orderkey AS id, n_name AS org, r_name AS parent FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", prelude=False)
def join_trial_record_org(spark, sf):
    o, c, n, g = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("org"), F.col("r_name").alias("parent"))


@query("SELECT record_type, id, published_at FROM records r WHERE month = (SELECT max(month) FROM records x WHERE x.record_type = r.record_type)")
def join_latest_group(spark, sf):
    """The records of each type's last month: one small aggregate, broadcast to the records, none of which is shuffled."""
    r = records(spark, sf)
    last = r.groupBy("record_type").agg(F.max("month").alias("month"))
    return r.join(F.broadcast(last), ["record_type", "month"]).select("record_type", "id", "published_at")


@query("SELECT id, record_type FROM records WHERE NOT EXISTS (SELECT 1 FROM record_topics WHERE record_id = id)")
def anti_unmatched_records(spark, sf):
    r, t = records(spark, sf), record_topics(spark, sf)
    return r.join(t, r["id"] == t["record_id"], "left_anti").select("id", "record_type")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", prelude=False)
def anti_unextracted(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    """SELECT 'line without order' AS problem, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
  UNION ALL SELECT 'order without line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
  UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
  UNION ALL SELECT 'line without supplier', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)""",
    prelude=False,
)
def anti_orphans(spark, sf):
    line, o, p, s = (read(spark, sf, t) for t in ("lineitem", "orders", "part", "supplier"))
    checks = [
        ("line without order", line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("order without line", o.join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("line without part", line.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti")),
        ("line without supplier", line.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")),
    ]
    out = None
    for name, df in checks:
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = n if out is None else out.unionByName(n)
    return out


ENTRY = """, e AS (SELECT org_id, topic, count(DISTINCT id) FILTER (WHERE month > DATE '2001-01-01') AS recent, count(DISTINCT id) FILTER (WHERE month <= DATE '2001-01-01' AND month > DATE '1999-07-01') AS before,
  count(DISTINCT id) FILTER (WHERE month <= DATE '1999-07-01') AS earlier FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL)
"""


@query(ENTRY + "SELECT org_id, topic, recent, earlier > 0 AS had_earlier_history FROM e WHERE recent >= 1 AND before = 0")
def entry_detect(spark, sf):
    """New entries: records in the last six months, none in the 18 before."""
    from pulsegrid.plans.activity import agg_entry_totals

    e = agg_entry_totals(spark, sf).where("recent >= 1 and before = 0")
    return e.select("org_id", "topic", "recent", (F.col("earlier") > 0).alias("had_earlier_history"))


@query("SELECT DISTINCT org_id FROM records JOIN record_orgs ON id = record_id WHERE month > DATE '2001-06-01' AND org_id NOT IN (SELECT org_id FROM records JOIN record_orgs ON id = record_id WHERE month = DATE '2001-06-01')")
def anti_quiet_before(spark, sf):
    r, o = records(spark, sf), record_orgs(spark, sf)
    j = r.join(o, r["id"] == o["record_id"]).select("org_id", "month")
    return j.where(F.col("month") > date("2001-06-01")).select("org_id").distinct().join(j.where(F.col("month") == date("2001-06-01")), "org_id", "left_anti")


@query(
    """, a AS (SELECT record_type, max(month) AS last FROM records WHERE status = 'F' GROUP BY ALL), b AS (SELECT record_type, count(*) AS runs FROM records WHERE status = 'P' GROUP BY ALL)
SELECT coalesce(a.record_type, b.record_type) AS source, last, runs FROM a FULL JOIN b ON a.record_type = b.record_type"""
)
def outer_checkpoint_run(spark, sf):
    r = records(spark, sf)
    a = r.where("status = 'F'").groupBy("record_type").agg(F.max("month").alias("last"))
    b = r.where("status = 'P'").groupBy("record_type").agg(F.count("*").alias("runs"))
    return a.join(b, "record_type", "full_outer").select(F.col("record_type").alias("source"), "last", "runs")


@query("SELECT s_suppkey AS id, coalesce(n_name, 'organization ' || s_nationkey) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = s_nationkey", prelude=False)
def left_dim_lookup(spark, sf):
    n = read(spark, sf, "nation").where("n_regionkey <> 2")
    return read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.coalesce("n_name", F.concat(F.lit("organization "), "s_nationkey")).alias("name"))


@query("SELECT s_name AS topic, n_name AS area, r_name AS parent FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey", prelude=False)
def left_area_parent(spark, sf):
    s, n, g = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("s_name").alias("topic"), F.col("n_name").alias("area"), F.col("r_name").alias("parent"))


@query("SELECT s_nationkey AS org_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 AS area, count(DISTINCT l_orderkey) AS records FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 10", prelude=False)
def cross_competitor_area(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    area = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 5
    return j.groupBy(F.col("s_nationkey").alias("org_id"), area.alias("area")).agg(F.count_distinct("l_orderkey").alias("records")).where("records >= 10")


@query("SELECT record_type, max(month) FILTER (WHERE month <= DATE '2000-02-15') AS known FROM records GROUP BY ALL")
def asof_last_known_date(spark, sf):
    return records(spark, sf).groupBy("record_type").agg(F.max(F.when(F.col("month") <= date("2000-02-15"), F.col("month"))).alias("known"))


@query(
    """, w(name, lo, hi) AS (VALUES ('early', DATE '1995-01-01', DATE '1996-06-01'), ('late', DATE '2000-03-01', DATE '2001-02-01'))
SELECT name, month, count(*) AS n FROM records JOIN w ON month BETWEEN lo AND hi GROUP BY ALL"""
)
def range_window_benchmark(spark, sf):
    w = spark.createDataFrame([("early", "1995-01-01", "1996-06-01"), ("late", "2000-03-01", "2001-02-01")], "name string, lo string, hi string").selectExpr("name", "date(lo) as lo", "date(hi) as hi")
    # counted by month first: the range join meets months, not records
    by_month = records(spark, sf).groupBy("month").agg(F.count("*").alias("c"))
    return by_month.join(F.broadcast(w), F.col("month").between(F.col("lo"), F.col("hi"))).groupBy("name", "month").agg(F.sum("c").alias("n"))


# sorts, top-k, paging


@query("SELECT org_id, id, rn FROM (SELECT org_id, id, row_number() OVER (PARTITION BY org_id ORDER BY published_at DESC, id) AS rn FROM (SELECT DISTINCT org_id, id, published_at FROM records JOIN record_orgs ON id = record_id)) WHERE rn <= 5")
def topk_evidence_per_org(spark, sf):
    r, o = records(spark, sf), record_orgs(spark, sf)
    j = r.join(o, r["id"] == o["record_id"]).select("org_id", "id", "published_at").distinct()
    rn = F.row_number().over(W.partitionBy("org_id").orderBy(F.desc("published_at"), "id"))
    return j.withColumn("rn", rn.cast("long")).where("rn <= 5").select("org_id", "id", "rn")


@query("SELECT topic, id FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY published_at DESC, id) AS rn FROM (SELECT DISTINCT topic, id, published_at FROM records JOIN record_topics ON id = record_id WHERE record_type = 'patent')) WHERE rn <= 10")
def topk_records_for_entity(spark, sf):
    r, t = records(spark, sf).where("record_type = 'patent'"), record_topics(spark, sf)
    j = r.join(t, r["id"] == t["record_id"]).select("topic", "id", "published_at").distinct()
    return j.withColumn("rn", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("published_at"), "id"))).where("rn <= 10").select("topic", "id")


@query("SELECT id, published_at, record_type FROM records ORDER BY published_at DESC, id LIMIT 15")
def topk_evidence_records(spark, sf):
    return records(spark, sf).orderBy(F.desc("published_at"), "id").limit(15).select("id", "published_at", "record_type")


@query("SELECT c_custkey AS id, c_acctbal AS score, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 50", prelude=False)
def sort_scores_desc(spark, sf):
    top = read(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    return top.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@query("SELECT event_id, event_type, (SELECT count(*) FROM events) AS total FROM events ORDER BY event_type, event_id LIMIT 20 OFFSET 40", prelude=False)
def page_review_queue(spark, sf):
    e = read(spark, sf, "events")
    page = e.orderBy("event_type", "event_id").offset(40).limit(20).select("event_id", "event_type")
    return page.crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))


@query(
    """, s AS (SELECT topic, sum(v) FILTER (WHERE ago BETWEEN 3 AND 8) AS score, sum(v) FILTER (WHERE ago < 3) AS gain FROM topic_series GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, topic) AS pos, row_number() OVER (ORDER BY gain DESC, topic) AS ideal, gain >= (SELECT median(gain) FROM s) AS relevant FROM s)
SELECT round(avg(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos <= 3), 6) AS precision_3, round(coalesce(count(*) FILTER (WHERE relevant AND pos <= 3) / nullif(count(*) FILTER (WHERE relevant), 0), 1.0), 6) AS recall_3,
  round(sum(gain / log2(pos + 1)) FILTER (WHERE pos <= 3) / nullif(sum(gain / log2(ideal + 1)) FILTER (WHERE ideal <= 3), 0), 6) AS ndcg_3 FROM r"""
)
def topk_metrics(spark, sf):
    s = topic_series(spark, sf).groupBy("topic").agg(F.sum(F.when(F.col("ago").between(3, 8), F.col("v"))).alias("score"), F.sum(F.when(F.col("ago") < 3, F.col("v"))).alias("gain")).withColumn("c", F.lit(1))
    r = s.select("gain", F.row_number().over(W.partitionBy("c").orderBy(F.desc("score"), "topic")).alias("pos"), F.row_number().over(W.partitionBy("c").orderBy(F.desc("gain"), "topic")).alias("ideal"), (F.col("gain") >= F.median("gain").over(W.partitionBy("c"))).alias("relevant"))
    top = F.col("pos") <= 3
    return r.agg(
        r6(F.avg(F.when(top, F.when(F.col("relevant"), 1.0).otherwise(0.0))), "precision_3"),
        r6(F.coalesce(F.count_if(F.col("relevant") & top) / F.nullif(F.count_if("relevant"), F.lit(0)), F.lit(1.0)), "recall_3"),
        r6(F.sum(F.when(top, F.col("gain") / F.log2(F.col("pos") + 1))) / F.nullif(F.sum(F.when(F.col("ideal") <= 3, F.col("gain") / F.log2(F.col("ideal") + 1))), F.lit(0.0)), "ndcg_3"),
    )


# sets


@query("SELECT s_nationkey AS org_id FROM supplier UNION SELECT c_nationkey FROM customer", prelude=False)
def set_union_sources(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_nationkey").alias("org_id")).union(read(spark, sf, "customer").select("c_nationkey")).distinct()


@query("SELECT count(*) / 20.0 AS overlap FROM (SELECT l_partkey FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL ORDER BY q DESC, l_partkey LIMIT 20) INTERSECT SELECT l_partkey FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey LIMIT 20))".replace("count(*) / 20.0", "CAST(count(*) AS DOUBLE) / 20"), prelude=False)
def set_intersect_topk(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    a = g.orderBy(F.desc("q"), "l_partkey").limit(20).select("l_partkey")
    b = g.orderBy(F.desc("n"), "l_partkey").limit(20).select("l_partkey")
    return a.intersect(b).agg((F.count("*").cast("double") / 20).alias("overlap"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'", prelude=False)
def set_difference(spark, sf):
    o, cut = read(spark, sf, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut).select(F.col("o_custkey").alias("id")).subtract(o.where(F.col("o_orderdate") >= cut).select("o_custkey"))


@query("SELECT DISTINCT event_type FROM events", prelude=False)
def distinct_types(spark, sf):
    return read(spark, sf, "events").select("event_type").distinct()


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL", prelude=False)
def distinct_in_run(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


# data quality


@query(
    """SELECT 'required' AS check_name, count(*) FILTER (WHERE text IS NULL OR text = '') AS problems, count(*) AS rows FROM documents
  UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT text), count(*) FROM documents
  UNION ALL SELECT 'date', count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-02-01' OR o_orderdate >= TIMESTAMP '2001-08-01'), count(*) FROM orders
  UNION ALL SELECT 'range', count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.05), count(*) FROM lineitem
  UNION ALL SELECT 'ingest', count(*) FILTER (WHERE event_type = 'error'), count(*) FROM events""",
    prelude=False,
)
def agg_quality_checks(spark, sf):
    d, o, line, e = (read(spark, sf, t) for t in ("documents", "orders", "lineitem", "events"))
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    found = [
        ("required", d, F.count_if(F.col("text").isNull() | (F.col("text") == ""))),
        ("duplicate", d, F.count("*") - F.count_distinct(F.md5("text"))),
        ("date", o, F.count_if((F.col("o_orderdate") < stamp("1995-02-01")) | (F.col("o_orderdate") >= stamp("2001-08-01")))),
        ("range", line, F.count_if(~F.col("l_discount").between(0, 0.05))),
        ("ingest", e, F.count_if(F.col("event_type") == "error")),
    ]
    out = None
    for name, df, problem in found:
        n = df.agg(problem.alias("problems"), F.count("*").alias("rows")).select(F.lit(name).alias("check_name"), "problems", "rows")
        out = n if out is None else out.unionByName(n)
    return out






# read queries and the star schema


@query("SELECT (SELECT count(*) FROM records) AS n_records, (SELECT count(*) FROM supplier) AS n_orgs, (SELECT count(DISTINCT p_type) FROM part) AS n_topics, (SELECT max(published_at) FROM records) AS last_at")
def q_overview(spark, sf):
    parts = [
        records(spark, sf).agg(F.count("*").alias("n_records"), F.max("published_at").alias("last_at")),
        read(spark, sf, "supplier").agg(F.count("*").alias("n_orgs")),
        read(spark, sf, "part").agg(F.count_distinct("p_type").alias("n_topics")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query("SELECT m.month, y.record_type, count(r.id) AS n FROM months m CROSS JOIN types y LEFT JOIN records r ON r.month = m.month AND r.record_type = y.record_type WHERE m.ago < 24 GROUP BY ALL")
def q_monthly_activity(spark, sf):
    from pulsegrid.sources.tables import RECORD_TYPES, months

    grid = months(spark, 24).crossJoin(spark.createDataFrame([(k,) for k in RECORD_TYPES], "record_type string"))
    c = records(spark, sf).groupBy("month", "record_type").agg(F.count("*").alias("c"))
    return grid.join(c, ["month", "record_type"], "left").select("month", "record_type", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT CAST(d AS DATE) AS date, CAST(year(d) AS BIGINT) AS year, CAST(quarter(d) AS BIGINT) AS quarter, CAST(month(d) AS BIGINT) AS month, CAST(isodow(d) AS BIGINT) AS weekday FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT last_day(max(o_orderdate)) FROM orders), INTERVAL 1 DAY)) AS d)", prelude=False)
def dim_date(spark, sf):
    b = read(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate"), "MM").alias("lo"), F.last_day(F.max("o_orderdate")).alias("hi"))
    d = b.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return d.select("date", F.year("date").cast("long").alias("year"), F.quarter("date").cast("long").alias("quarter"), F.month("date").cast("long").alias("month"), (F.weekday("date") + 1).cast("long").alias("weekday"))


@query("SELECT n_nationkey AS organization_id, n_name AS name, r_name AS parent FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", prelude=False)
def dim_organization(spark, sf):
    return read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


@query("SELECT p_type AS topic, count(*) AS parts, count(DISTINCT p_brand) AS brands FROM part GROUP BY ALL", prelude=False)
def dim_topic(spark, sf):
    return read(spark, sf, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT record_type, round(sum(amount) FILTER (WHERE month > DATE '2001-04-01'), 2) AS recent, round(sum(amount) FILTER (WHERE month <= DATE '2001-04-01' AND month > DATE '2001-01-01'), 2) AS previous, round(100 * (sum(amount) FILTER (WHERE month > DATE '2001-04-01') / nullif(sum(amount) FILTER (WHERE month <= DATE '2001-04-01' AND month > DATE '2001-01-01'), 0) - 1), 6) AS percent FROM records GROUP BY ALL")
def dax_momentum_pct(spark, sf):
    now = F.sum(F.when(F.col("month") > date("2001-04-01"), F.col("amount")))
    before = F.sum(F.when((F.col("month") <= date("2001-04-01")) & (F.col("month") > date("2001-01-01")), F.col("amount")))
    g = records(spark, sf).groupBy("record_type").agg(now.alias("a"), before.alias("b"))
    return g.select("record_type", F.round("a", 2).alias("recent"), F.round("b", 2).alias("previous"), r6(100 * (F.col("a") / F.nullif("b", F.lit(0.0)) - 1), "percent"))


@query("SELECT round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate FROM events", prelude=False)
def dax_health(spark, sf):
    return read(spark, sf, "events").agg(r6(F.count_if(F.col("event_type") != "error") * 100.0 / F.count("*"), "success_rate"))


# ingestion state


@query("SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS TIMESTAMP) AS slice, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", prelude=False)
def st_slices(spark, sf):
    e = read(spark, sf, "events")
    days = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(days / 7) * 7).cast("int")).cast("timestamp_ntz")
    return e.groupBy(start.alias("slice"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id AS source, count(*) AS failures FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'error' AND (x.ts, x.event_id) > (e.ts, e.event_id)) GROUP BY ALL", prelude=False)
def st_consecutive_failures(spark, sf):
    """Failures since a source's last success: one window, no self-join."""
    e = read(spark, sf, "events")
    last = F.max(F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))).over(W.partitionBy("user_id"))
    return e.withColumn("last", last).where((F.col("event_type") == "error") & (F.col("last").isNull() | (F.struct("ts", "event_id") > F.col("last")))).groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("failures"))


@query(
    """, s AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
r AS (SELECT user_id, grp, count(*) FILTER (WHERE bad) AS run FROM s GROUP BY ALL)
SELECT user_id AS source, count(*) FILTER (WHERE run >= 3) AS opened, max(run) AS longest FROM r GROUP BY ALL""",
)
def st_circuit_breaker(spark, sf):
    """How often three failures in a row open the breaker, and the longest run (gaps and islands)."""
    e = read(spark, sf, "events")
    grp = F.count_if(F.col("event_type") != "error").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    r = e.withColumn("grp", grp).groupBy("user_id", "grp").agg(F.count_if(F.col("event_type") == "error").alias("run"))
    return r.groupBy(F.col("user_id").alias("source")).agg(F.count_if(F.col("run") >= 3).alias("opened"), F.max("run").alias("longest"))


@query("SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-08-01') AS in_progress, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-08-01') AS complete FROM orders", prelude=False)
def st_late_month(spark, sf):
    late = F.col("o_orderdate") >= F.lit("2001-08-01").cast("timestamp_ntz")
    return read(spark, sf, "orders").agg(F.count_if(late).alias("in_progress"), F.count_if(~late).alias("complete"))




# sinks, as what they would write


UPSERT = """stored AS (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
incoming AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0)
"""


def _upsert(spark, sf):
    from pulsegrid.sources.sinks import upsert

    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    stored = o.where("id % 3 <> 0")
    incoming = o.where("id % 2 = 0").withColumn("amount", F.when(F.col("id") % 5 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return upsert(stored, incoming, ["id"], ["amount", "status"])


@query("WITH " + UPSERT + "SELECT coalesce(i.id, s.id) AS id, coalesce(i.amount, s.amount) AS amount, coalesce(i.status, s.status) AS status, CASE WHEN s.id IS NULL THEN 'insert' WHEN i.id IS NULL THEN 'keep' WHEN i.amount <> s.amount OR i.status <> s.status THEN 'update' ELSE 'unchanged' END AS action FROM stored s FULL JOIN incoming i ON s.id = i.id", prelude=False)
def sink_upsert_records(spark, sf):
    return _upsert(spark, sf)


@query("WITH " + UPSERT + "SELECT count(*) FILTER (WHERE s.id IS NULL) AS inserted, count(*) FILTER (WHERE s.id IS NOT NULL AND (i.amount <> s.amount OR i.status <> s.status)) AS updated, count(*) FILTER (WHERE s.id IS NOT NULL AND i.amount = s.amount AND i.status = s.status) AS unchanged FROM incoming i LEFT JOIN stored s ON s.id = i.id", prelude=False)
def sink_preview_upsert(spark, sf):
    u = _upsert(spark, sf)
    is_ = lambda x: F.count_if(F.col("action") == x)
    return u.agg(is_("insert").alias("inserted"), is_("update").alias("updated"), is_("unchanged").alias("unchanged"))

"""Queries over dense monthly series: growth, velocity, consistency, anomalies, ranks and cohort scales."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import cohort as C
from pulsegrid.operators import series as S
from pulsegrid.plans.activity import r6, topic_series, topic_source
from pulsegrid.sources.tables import PRELUDE, RECORD_TYPES, months, record_orgs, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PRELUDE + sql
        return f

    return add


GROWTH = """, g AS (SELECT topic, sum(v) FILTER (WHERE ago BETWEEN 0 AND 2) AS recent_sum, sum(v) FILTER (WHERE ago BETWEEN 3 AND 5) AS previous_sum FROM topic_series WHERE ago < 14 GROUP BY ALL),
gr AS (SELECT *, ln((recent_sum + 1) / (previous_sum + 1)) AS growth FROM g)
"""


@query(GROWTH + "SELECT topic, recent_sum, previous_sum FROM g")
def win_split(spark, sf):
    return S.growth(topic_series(spark, sf, 14), ["topic"]).select("topic", "recent_sum", "previous_sum")


@query(
    GROWTH
    + "SELECT topic, round(growth, 6) AS growth, round(100 * (recent_sum - previous_sum) / greatest(previous_sum, 1), 6) AS percent, recent_sum + previous_sum < 10 AS low_sample, CASE WHEN growth > 0 THEN 'rising' WHEN growth < 0 THEN 'falling' ELSE 'flat' END AS direction FROM gr"
)
def win_growth(spark, sf):
    return S.growth(topic_series(spark, sf, 14), ["topic"]).select("topic", r6("growth"), r6("percent"), "low_sample", "direction")


@query(
    """SELECT topic, record_type, round(ln((coalesce(sum(n) FILTER (WHERE ago <= 2), 0) + 1.0) / (coalesce(sum(n) FILTER (WHERE ago BETWEEN 3 AND 5), 0) + 1.0)), 6) AS surge FROM topic_source WHERE ago < 6 GROUP BY ALL"""
)
def win_surge(spark, sf):
    return S.growth(topic_source(spark, sf, 6), ["topic", "record_type"], value="n").select("topic", "record_type", r6("growth", "surge"))


@query("""SELECT topic, round(ln((sum(v) FILTER (WHERE ago <= 5) + 1) / (sum(v) FILTER (WHERE ago BETWEEN 6 AND 11) + 1)), 6) AS momentum FROM topic_series WHERE ago < 12 GROUP BY ALL""")
def win_momentum(spark, sf):
    return S.growth(topic_series(spark, sf, 12), ["topic"], 6, 6).select("topic", r6("growth", "momentum"))


FIT = """, fit AS (SELECT topic, regr_slope(ln(1 + v), 11.0 - ago) AS slope, regr_r2(ln(1 + v), 11.0 - ago) AS r2, min(v) AS lo, max(v) AS hi, count(*) AS n FROM topic_series WHERE ago < 12 GROUP BY ALL)
"""


@query(FIT + "SELECT topic, round(CASE WHEN n >= 6 THEN slope END, 6) AS velocity, round(CASE WHEN lo = hi THEN 1.0 ELSE least(greatest(r2, 0), 1) END, 6) AS r2 FROM fit")
def win_velocity(spark, sf):
    return S.velocity(topic_series(spark, sf, 14), ["topic"]).select("topic", r6("velocity"), r6("r2"))


@query(FIT + "SELECT topic, round((exp(slope) - 1) * 100, 6) AS velocity_pct FROM fit")
def win_velocity_pct(spark, sf):
    return S.velocity(topic_series(spark, sf, 14), ["topic"]).select("topic", r6("velocity_pct"))


STEPS = """, st AS (SELECT topic, record_type, ago, CAST(n AS DOUBLE) AS v, CAST(n - lag(n) OVER (PARTITION BY topic, record_type ORDER BY ago DESC) AS DOUBLE) AS step FROM topic_source WHERE ago < 14),
co AS (SELECT topic, record_type, count(step) AS steps, avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS consistency, stddev_pop(step) AS volatility, max(v) / nullif(sum(v), 0) AS largest_share FROM st GROUP BY ALL)
"""


@query(STEPS + "SELECT topic, record_type, round(consistency, 6) AS consistency, round(volatility, 6) AS volatility, round(largest_share, 6) AS largest_share FROM co WHERE steps >= 2")
def win_consistency(spark, sf):
    return S.consistency(topic_source(spark, sf, 14), ["topic", "record_type"], "n").select("topic", "record_type", r6("consistency"), r6("volatility"), r6("largest_share"))


@query(STEPS + "SELECT topic, record_type, coalesce(largest_share, 0) >= 0.5 AND consistency < 0.5 AS single_spike FROM co")
def win_single_spike(spark, sf):
    return S.consistency(topic_source(spark, sf, 14), ["topic", "record_type"], "n").select("topic", "record_type", "single_spike")


def quiet_months(spark, sf, n: int = 80):
    """Months in which every source counted nothing, if any source counts at all."""
    s = topic_source(spark, sf, n).groupBy("month").agg(F.max("n").alias("top"))
    return s.where("top = 0").select("month")


@query("SELECT month, max(n) = 0 AS quiet FROM topic_source GROUP BY ALL")
def win_quiet_months(spark, sf):
    return topic_source(spark, sf).groupBy("month").agg((F.max("n") == 0).alias("quiet"))


ROLL = """, past AS (SELECT topic, month, ago, v, list(v) OVER (PARTITION BY topic ORDER BY ago DESC ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS p FROM topic_series),
c1 AS (SELECT *, list_median(p) AS centre FROM past),
c2 AS (SELECT *, list_median(list_transform(p, lambda x: abs(x - centre))) AS mad, list_stddev_pop(p) AS dev FROM c1),
c3 AS (SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745 WHEN dev > 0 THEN dev ELSE sqrt(greatest(centre, 1)) END AS spread FROM c2),
z AS (SELECT *, CASE WHEN coalesce(len(p), 0) < 6 THEN 0.0 ELSE (v - centre) / spread END AS z FROM c3)
"""


@query(ROLL + "SELECT topic, month, round(z, 9) AS z FROM z")
def win_rolling_robust_z(spark, sf):
    return S.rolling_z(topic_series(spark, sf), ["topic"]).select("topic", "month", F.round("z", 9).alias("z"))


@query(
    """, m AS (SELECT topic, median(v) AS med, mad(v) AS mad, stddev_pop(v) AS dev FROM topic_series GROUP BY ALL)
SELECT topic, month, round((v - med) / CASE WHEN mad > 0 THEN mad / 0.6745 WHEN dev > 0 THEN dev ELSE sqrt(greatest(med, 1)) END, 6) AS z FROM topic_series JOIN m USING (topic)"""
)
def win_robust_z_global(spark, sf):
    s = topic_series(spark, sf)
    w = W.partitionBy("topic")
    s = s.select("*", F.median("v").over(w).alias("med"))
    s = s.select("*", F.median(F.abs(F.col("v") - F.col("med"))).over(w).alias("mad"), F.stddev_pop("v").over(w).alias("dev"))
    spread = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).when(F.col("dev") > 0, F.col("dev")).otherwise(F.sqrt(F.greatest("med", F.lit(1.0))))
    return s.select("topic", "month", r6((F.col("v") - F.col("med")) / spread, "z"))


@query("SELECT topic, month, round(v - (sum(v) OVER s - v) / nullif(count(*) OVER s - 1, 0), 6) AS residual FROM topic_series WINDOW s AS (PARTITION BY topic, month(month))")
def win_seasonal_residual(spark, sf):
    w = W.partitionBy("topic", F.month("month"))
    usual = (F.sum("v").over(w) - F.col("v")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return topic_series(spark, sf).select("topic", "month", r6(F.col("v") - usual, "residual"))


ANOMALY = (
    ROLL
    + """, q AS (SELECT month, max(n) = 0 AS quiet FROM topic_source GROUP BY ALL),
x AS (SELECT z.*, quiet, lead(v, 1) OVER o AS next1, lead(v, 2) OVER o AS next2, (sum(v) OVER s - v) / nullif(count(*) OVER s - 1, 0) AS usual FROM z JOIN q USING (month)
  WINDOW o AS (PARTITION BY topic ORDER BY ago DESC), s AS (PARTITION BY topic, month(month))),
an AS (SELECT topic, month, v, z, greatest(centre - 3.5 * spread, 0) AS lower, centre + 3.5 * spread AS upper,
  CASE WHEN v = 0 AND quiet THEN 'collection_gap' WHEN z < 0 THEN 'drop' WHEN abs(v - usual) <= spread THEN 'seasonal' WHEN ago = 0 THEN 'emerging'
    WHEN coalesce(next1 >= centre + (v - centre) / 2, true) AND coalesce(next2 >= centre + (v - centre) / 2, true) THEN 'persistent' ELSE 'spike' END AS anomaly_class,
  least(100, 100 * least(1, abs(z) / 7)) * least(1, greatest(v, centre) / 10) AS confidence FROM x WHERE abs(z) >= 3.5)
"""
)


@query(ANOMALY + "SELECT topic, month, v, round(z, 6) AS z, round(lower, 6) AS lower, round(upper, 6) AS upper, round(confidence, 6) AS confidence FROM an")
def win_anomalies(spark, sf):
    a = S.anomalies(topic_series(spark, sf), ["topic"], quiet=quiet_months(spark, sf))
    return a.select("topic", "month", "v", r6("z"), r6("lower"), r6("upper"), r6("confidence"))


@query(ANOMALY + "SELECT topic, month, anomaly_class FROM an")
def win_anomaly_classify(spark, sf):
    return S.anomalies(topic_series(spark, sf), ["topic"], quiet=quiet_months(spark, sf)).select("topic", "month", "anomaly_class")


ORG = """, om AS (SELECT org_id, record_type, month, count(DISTINCT id) AS n FROM records JOIN record_orgs ON id = record_id WHERE month > DATE '2000-05-01' GROUP BY ALL),
org AS (SELECT org_id, CAST(sum(n) AS DOUBLE) AS activity, ln((coalesce(sum(n) FILTER (WHERE month > DATE '2001-04-01'), 0) + 1.0) / (coalesce(sum(n) FILTER (WHERE month <= DATE '2001-04-01' AND month > DATE '2001-01-01'), 0) + 1.0)) AS growth FROM om GROUP BY ALL)
"""


def org_features(spark, sf):
    """(org_id, activity, growth) over the last 14 months."""
    from pulsegrid.operators.activity import by_org

    r = records(spark, sf).where(F.col("month") > F.lit("2000-05-01").cast("date"))
    month = lambda x: F.lit(x).cast("date")
    c = by_org(r, record_orgs(spark, sf))
    now = F.coalesce(F.sum(F.when(F.col("month") > month("2001-04-01"), F.col("records"))), F.lit(0))
    before = F.coalesce(F.sum(F.when((F.col("month") <= month("2001-04-01")) & (F.col("month") > month("2001-01-01")), F.col("records"))), F.lit(0))
    return c.groupBy("org_id").agg(F.sum("records").cast("double").alias("activity"), F.log((now + 1.0) / (before + 1.0)).alias("growth"))


@query(ORG + "SELECT org_id, rank() OVER (ORDER BY activity DESC) AS rank FROM org")
def win_rank_ties(spark, sf):
    return org_features(spark, sf).select("org_id", F.rank().over(W.orderBy(F.desc("activity"))).cast("long").alias("rank"))


@query(ORG + "SELECT org_id, round(CASE WHEN min(activity) OVER () = max(activity) OVER () THEN 50.0 ELSE (rank() OVER (ORDER BY activity) - 1 + 0.5 * count(*) OVER (PARTITION BY activity)) * 100.0 / count(*) OVER () END, 6) AS percentile FROM org")
def win_percentile(spark, sf):
    return org_features(spark, sf).withColumn("c", F.lit(1)).select("org_id", r6(C.percentile(F.col("activity"), ["c"]), "percentile"))


@query(ORG + "SELECT org_id, round(CASE WHEN min(activity) OVER () = max(activity) OVER () THEN 50.0 ELSE (activity - min(activity) OVER ()) / (max(activity) OVER () - min(activity) OVER ()) * 100 END, 6) AS scaled FROM org")
def win_minmax(spark, sf):
    return org_features(spark, sf).withColumn("c", F.lit(1)).select("org_id", r6(C.min_max(F.col("activity"), ["c"]), "scaled"))


@query(
    ORG
    + """, q AS (SELECT quantile_cont(activity, 0.05) AS lo, quantile_cont(activity, 0.95) AS hi FROM org)
SELECT org_id, round(CASE WHEN lo = hi THEN 50.0 ELSE (least(greatest(activity, lo), hi) - lo) / (hi - lo) * 100 END, 6) AS scaled FROM org CROSS JOIN q"""
)
def win_winsor_minmax(spark, sf):
    return org_features(spark, sf).withColumn("c", F.lit(1)).select("org_id", r6(C.winsor_min_max(F.col("activity"), ["c"]), "scaled"))


@query(
    ORG
    + """, q AS (SELECT median(activity) AS med, mad(activity) AS mad FROM org)
SELECT org_id, round(CASE WHEN mad = 0 THEN 50.0 ELSE least(greatest(50 + 50 * (0.6745 * (activity - med) / mad) / 2, 0), 100) END, 6) AS scaled FROM org CROSS JOIN q"""
)
def win_robust_norm(spark, sf):
    w = W.partitionBy("c")
    o = org_features(spark, sf).withColumn("c", F.lit(1)).withColumn("med", F.median("activity").over(w))
    o = o.withColumn("mad", F.median(F.abs(F.col("activity") - F.col("med"))).over(w))
    return o.select("org_id", r6(F.when(F.col("mad") == 0, 50.0).otherwise(C.clamp(50 + 50 * (0.6745 * (F.col("activity") - F.col("med")) / F.col("mad")) / 2)), "scaled"))


@query("SELECT topic, round(ln((sum(v) FILTER (WHERE ago BETWEEN 0 AND 2) + 1) / (sum(v) FILTER (WHERE ago BETWEEN 3 AND 5) + 1)), 6) AS realized FROM topic_series WHERE ago <= 5 GROUP BY ALL")
def win_realized_growth(spark, sf):
    """Growth after a cutoff (three months ago) against as long before it; the cutoff's month is in the after."""
    return S.growth(topic_series(spark, sf, 6), ["topic"]).select("topic", r6("growth", "realized"))


@query(
    ANOMALY
    + """, base AS (SELECT a.topic, a.month, greatest((SELECT avg(v) FROM topic_series s WHERE s.topic = a.topic AND s.month BETWEEN CAST(a.month - INTERVAL 2 MONTH AS DATE) AND a.month), 1) AS level FROM an a)
SELECT topic, month, CAST(date_diff('day', month, (SELECT min(s.month) FROM topic_series s WHERE s.topic = b.topic AND s.month > b.month AND s.month <= CAST(b.month + INTERVAL 6 MONTH AS DATE) AND s.v >= 1.5 * level)) AS BIGINT) AS lead_days FROM base b"""
)
def win_lead_time(spark, sf):
    """Days from an alert to the first month within six that reaches half as much again as the three months up to it."""
    s = topic_series(spark, sf)
    alerts = S.anomalies(s, ["topic"], quiet=quiet_months(spark, sf)).select("topic", F.col("month").alias("alert"))
    j = alerts.join(s.select("topic", "month", "v"), "topic").where((F.col("month") >= F.add_months("alert", -2)) & (F.col("month") <= F.add_months("alert", 6)))
    level = F.greatest(F.avg(F.when(F.col("month") <= F.col("alert"), F.col("v"))), F.lit(1.0))
    a = j.groupBy("topic", "alert").agg(level.alias("level"), F.collect_list(F.when(F.col("month") > F.col("alert"), F.struct("month", "v"))).alias("after"))
    first = F.array_min(F.transform(F.filter("after", lambda x: x["v"] >= 1.5 * F.col("level")), lambda x: x["month"]))
    return a.select("topic", F.col("alert").alias("month"), F.date_diff(first, "alert").cast("long").alias("lead_days"))




# the flagship, and scores

FEATURES = """, f0 AS (SELECT topic, sum(v) AS total, ln((sum(v) FILTER (WHERE ago <= 2) + 1) / (sum(v) FILTER (WHERE ago BETWEEN 3 AND 5) + 1)) AS momentum, regr_slope(ln(1 + v), -ago) FILTER (WHERE ago < 12) AS velocity FROM topic_series WHERE ago < 14 GROUP BY ALL),
f1 AS (SELECT topic, ln((coalesce(sum(n) FILTER (WHERE record_type = 'patent' AND ago <= 2), 0) + 1.0) / (coalesce(sum(n) FILTER (WHERE record_type = 'patent' AND ago BETWEEN 3 AND 5), 0) + 1.0)) AS patent_growth,
  ln((coalesce(sum(n) FILTER (WHERE record_type = 'funding' AND ago <= 2), 0) + 1.0) / (coalesce(sum(n) FILTER (WHERE record_type = 'funding' AND ago BETWEEN 3 AND 5), 0) + 1.0)) AS funding_growth FROM topic_source WHERE ago < 14 GROUP BY ALL),
d AS (SELECT topic, v - lag(v) OVER (PARTITION BY topic ORDER BY ago DESC) AS step, v FROM topic_series WHERE ago < 14),
f2 AS (SELECT topic, avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS consistency, max(v) / nullif(sum(v), 0) AS largest_share FROM d GROUP BY ALL),
g3 AS (SELECT topic, record_type, ln((sum(n) FILTER (WHERE ago <= 2) + 1.0) / (sum(n) FILTER (WHERE ago BETWEEN 3 AND 5) + 1.0)) AS growth, sum(n) AS total FROM topic_source WHERE ago < 14 GROUP BY ALL),
f3 AS (SELECT topic, count(*) FILTER (WHERE growth > 0 AND total > 0) AS supporting, count(*) FILTER (WHERE total > 0) AS available FROM g3 GROUP BY ALL),
f AS (SELECT * FROM f0 JOIN f1 USING (topic) JOIN f2 USING (topic) JOIN f3 USING (topic)),
p AS (SELECT *, """ + ", ".join(
    f"CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 50.0 ELSE (rank() OVER (ORDER BY {c}) - 1 + 0.5 * count(*) OVER (PARTITION BY {c})) * 100.0 / count(*) OVER () END AS p_{c}" for c in ("velocity", "momentum", "patent_growth", "funding_growth", "consistency")
) + """ FROM f),
trend AS (SELECT *, 0.30 * p_velocity + 0.25 * p_momentum + 0.20 * p_patent_growth + 0.15 * p_funding_growth + 0.10 * p_consistency AS trend FROM p),
sc AS (SELECT *, 1 - exp(-total / 25) AS sample, supporting / nullif(available, 0) AS agreement, available / 5.0 AS completeness FROM trend),
conf AS (SELECT *, 100 * (0.35 * sample + 0.25 * agreement + 0.20 * completeness + 0.10 * 1.0 + 0.10 * 1.0) AS confidence FROM sc)
"""


def topic_features(spark, sf, back: int = 0, without: str | None = None, window: int = 12, scale=C.percentile):
    """One row for each topic: features, their cohort percentiles, trend and confidence.

    ``back`` months before the last; ``without`` a source; with another velocity ``window`` or cohort ``scale``.
    """
    # one row for each topic and month, then one for each topic: the links are read once
    of = lambda k: F.sum(F.when(F.col("record_type") == k, F.col("n")))
    m = topic_source(spark, sf, max(14, window), back).where(F.col("record_type") != F.lit(without) if without else F.lit(True)).groupBy("topic", "month", "ago").agg(F.sum("n").alias("v"), *[F.coalesce(of(k), F.lit(0.0)).alias(k) for k in RECORD_TYPES])
    m = m.withColumn("step", F.col("v") - F.lag("v").over(W.partitionBy("topic").orderBy(F.col("ago").desc())))
    change = lambda c: S.log_ratio(S.sum_between("ago", c, 0, 2), S.sum_between("ago", c, 3, 5))
    last = F.col("ago") < window
    f = m.groupBy("topic").agg(
        F.sum("v").alias("total"),
        change("v").alias("momentum"),
        F.regr_slope(F.when(last, F.log1p("v")), F.when(last, -F.col("ago").cast("double"))).alias("velocity"),
        F.avg(F.when(F.col("step").isNotNull(), F.when(F.col("step") > 0, 1.0).otherwise(0.0))).alias("consistency"),
        (F.max("v") / F.nullif(F.sum("v"), F.lit(0.0))).alias("largest_share"),
        *[change(k).alias(f"{k}_growth") for k in RECORD_TYPES],
        *[F.sum(k).alias(f"{k}_total") for k in RECORD_TYPES],
    )
    count = lambda test: sum((F.when(test(k), 1).otherwise(0) for k in RECORD_TYPES), F.lit(0))
    f = f.withColumns({
        "supporting": count(lambda k: (F.col(f"{k}_growth") > 0) & (F.col(f"{k}_total") > 0)).cast("long"),
        "available": count(lambda k: F.col(f"{k}_total") > 0).cast("long"),
        "single_spike": (F.coalesce("largest_share", F.lit(0.0)) >= 0.5) & (F.col("consistency") < 0.5),
        "c": F.lit(1),
    })
    names = ("velocity", "momentum", "patent_growth", "funding_growth", "consistency")
    f = f.select("*", *[scale(F.col(n), ["c"]).alias(f"p_{n}") for n in names])
    trend = sum((F.lit(w) * F.col(f"p_{n}") for n, w in zip(names, (0.30, 0.25, 0.20, 0.15, 0.10), strict=True)), F.lit(0.0))
    f = f.select("*", trend.alias("trend"), (1 - F.exp(-F.col("total") / 25)).alias("sample"), (F.col("supporting") / F.nullif(F.col("available"), F.lit(0))).alias("agreement"), (F.col("available") / 5).alias("completeness"))
    confidence = 100 * (0.35 * F.col("sample") + 0.25 * F.col("agreement") + 0.20 * F.col("completeness") + 0.10 + 0.10)
    return f.select("*", confidence.alias("confidence"))


@query(FEATURES + "SELECT topic, round(momentum, 6) AS momentum, round(p_momentum, 6) AS percentile, rank() OVER (ORDER BY momentum DESC) AS rank FROM p")
def flagship_topic_momentum(spark, sf):
    f = topic_features(spark, sf)
    return f.select("topic", r6("momentum"), r6("p_momentum", "percentile"), F.rank().over(W.orderBy(F.desc("momentum"))).cast("long").alias("rank"))


@query(FEATURES + "SELECT topic, round(trend, 6) AS trend FROM trend")
def score_trend(spark, sf):
    return topic_features(spark, sf).select("topic", r6("trend"))


@query(FEATURES + "SELECT topic, round(confidence, 6) AS confidence FROM conf")
def score_confidence(spark, sf):
    return topic_features(spark, sf).select("topic", r6("confidence"))


GATES = ("score", "confidence", "sample", "sources", "steady")


@query(
    FEATURES
    + """SELECT topic, trend >= 60 AS score, confidence >= 60 AS confidence, total >= 10 AS sample, supporting >= 2 AS sources, NOT (coalesce(largest_share, 0) >= 0.5 AND consistency < 0.5) AS steady,
  trend >= 60 AND confidence >= 60 AND total >= 10 AND supporting >= 2 AND NOT (coalesce(largest_share, 0) >= 0.5 AND consistency < 0.5) AS qualified FROM conf"""
)
def score_trend_gates(spark, sf):
    f = topic_features(spark, sf)
    g = f.select("topic", F.array(F.col("trend") >= 60, F.col("confidence") >= 60, F.col("total") >= 10, F.col("supporting") >= 2, ~F.col("single_spike")).alias("gates"))
    return g.select("topic", *[F.get("gates", F.lit(i)).alias(n) for i, n in enumerate(GATES)], F.forall("gates", lambda x: x).alias("qualified"))




@query(
    FEATURES
    + """, parts AS (SELECT topic, unnest([{'name': 'consistency', 'c': 0.10 * p_consistency}, {'name': 'funding_growth', 'c': 0.15 * p_funding_growth}, {'name': 'momentum', 'c': 0.25 * p_momentum}, {'name': 'patent_growth', 'c': 0.20 * p_patent_growth}, {'name': 'velocity', 'c': 0.30 * p_velocity}]) AS x FROM p)
SELECT topic, 'led by ' || string_agg(name, ', ' ORDER BY rn) AS explanation FROM (SELECT topic, x.name AS name, row_number() OVER (PARTITION BY topic ORDER BY round(x.c, 9) DESC, x.name) AS rn FROM parts) WHERE rn <= 3 GROUP BY ALL"""
)
def score_explain(spark, sf):
    """The three largest contributions, named."""
    w = {"velocity": 0.30, "momentum": 0.25, "patent_growth": 0.20, "funding_growth": 0.15, "consistency": 0.10}
    parts = F.array(*[F.struct((-F.round(F.lit(x) * F.col(f"p_{n}"), 9)).alias("c"), F.lit(n).alias("name")) for n, x in w.items()])
    top = F.slice(F.array_sort(parts), 1, 3)
    return topic_features(spark, sf).select("topic", F.concat(F.lit("led by "), F.array_join(F.transform(top, lambda x: x["name"]), ", ")).alias("explanation"))


@query(
    FEATURES
    + """SELECT topic, CASE WHEN trend >= 80 AND trend <= 100 THEN 'strong' WHEN trend >= 60 AND trend <= 79 THEN 'rising' WHEN trend >= 40 AND trend <= 59 THEN 'steady' WHEN trend >= 0 AND trend <= 39 THEN 'weak' ELSE '' END AS band FROM trend"""
)
def fn_classify_band(spark, sf):
    """Bands have whole edges: a score between two of them has none."""
    t = F.col("trend")
    return topic_features(spark, sf).select("topic", F.when(t.between(80, 100), "strong").when(t.between(60, 79), "rising").when(t.between(40, 59), "steady").when(t.between(0, 39), "weak").otherwise("").alias("band"))


INNOVATION = {"patent": 0.40, "clinical_trial": 0.30, "publication": 0.20, "funding": 0.10}


@query(
    """, a AS (SELECT org_id, """
    + ", ".join(f"count(DISTINCT id) FILTER (WHERE record_type = '{k}') AS {k}" for k in INNOVATION)
    + """ FROM records JOIN record_orgs ON id = record_id WHERE month > DATE '2000-05-01' GROUP BY ALL),
p AS (SELECT org_id, """
    + ", ".join(f"CASE WHEN max({k}) OVER () = 0 THEN NULL WHEN min({k}) OVER () = max({k}) OVER () THEN 50.0 ELSE (rank() OVER (ORDER BY {k}) - 1 + 0.5 * count(*) OVER (PARTITION BY {k})) * 100.0 / count(*) OVER () END AS {k}" for k in INNOVATION)
    + " FROM a) SELECT org_id, round(("
    + " + ".join(f"coalesce({w} * {k}, 0)" for k, w in INNOVATION.items())
    + ") / ("
    + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in INNOVATION.items())
    + "), 6) AS innovation FROM p"
)
def score_innovation(spark, sf):
    """Percentiles of activity levels; a source that no organization has shares its weight out."""
    r, o = records(spark, sf).where(F.col("month") > F.lit("2000-05-01").cast("date")), record_orgs(spark, sf)
    a = r.join(o, r["id"] == o["record_id"]).groupBy("org_id").agg(*[F.count_distinct(F.when(F.col("record_type") == k, F.col("id"))).alias(k) for k in INNOVATION]).withColumn("c", F.lit(1))
    top = W.partitionBy("c")
    p = a.select("org_id", *[F.when(F.max(k).over(top) > 0, C.percentile(F.col(k).cast("double"), ["c"])).alias(k) for k in INNOVATION])
    have = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in INNOVATION.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in INNOVATION.items()), F.lit(0.0))
    return p.select("org_id", r6(got / have, "innovation"))


THREAT = {"clinical_trial": 0.50, "patent": 0.30, "publication": 0.20}


@query(
    """, g AS (SELECT org_id, record_type, ln((count(DISTINCT id) FILTER (WHERE month > DATE '2001-04-01') + 1.0) / (count(DISTINCT id) FILTER (WHERE month <= DATE '2001-04-01' AND month > DATE '2001-01-01') + 1.0)) AS growth FROM records JOIN record_orgs ON id = record_id WHERE month > DATE '2000-05-01' GROUP BY ALL),
p AS (SELECT *, CASE WHEN min(growth) OVER c = max(growth) OVER c THEN 50.0 ELSE (rank() OVER (PARTITION BY record_type ORDER BY growth) - 1 + 0.5 * count(*) OVER (PARTITION BY record_type, growth)) * 100.0 / count(*) OVER c END AS pct FROM g WINDOW c AS (PARTITION BY record_type)),
w AS (SELECT *, CASE record_type WHEN 'clinical_trial' THEN 0.5 WHEN 'patent' THEN 0.3 WHEN 'publication' THEN 0.2 END AS weight FROM p)
SELECT org_id, round(sum(pct * weight) / sum(weight), 6) AS threat FROM w WHERE weight IS NOT NULL GROUP BY ALL"""
)
def score_threat(spark, sf):
    r, o = records(spark, sf).where(F.col("month") > F.lit("2000-05-01").cast("date")), record_orgs(spark, sf)
    month = lambda x: F.lit(x).cast("date")
    now = F.count_distinct(F.when(F.col("month") > month("2001-04-01"), F.col("id")))
    before = F.count_distinct(F.when((F.col("month") <= month("2001-04-01")) & (F.col("month") > month("2001-01-01")), F.col("id")))
    g = r.join(o, r["id"] == o["record_id"]).groupBy("org_id", "record_type").agg(F.log((now + 1.0) / (before + 1.0)).alias("growth"))
    p = g.select("org_id", "record_type", C.percentile(F.col("growth"), ["record_type"]).alias("pct"))
    weight = F.lit(None).cast("double")
    for k, v in THREAT.items():
        weight = F.when(F.col("record_type") == k, v).otherwise(weight)
    p = p.select("*", weight.alias("weight")).where("weight is not null")
    return p.groupBy("org_id").agg(r6(F.sum(F.col("pct") * F.col("weight")) / F.sum("weight"), "threat"))


@query(
    ORG
    + """, t AS (SELECT org_id, record_type, sum(n) AS n FROM om GROUP BY ALL),
p AS (SELECT *, CASE WHEN min(n) OVER c = max(n) OVER c THEN 50.0 ELSE (rank() OVER (PARTITION BY record_type ORDER BY n) - 1 + 0.5 * count(*) OVER (PARTITION BY record_type, n)) * 100.0 / count(*) OVER c END AS pct FROM t WINDOW c AS (PARTITION BY record_type)),
s AS (SELECT org_id, sum(pct * 0.2) AS score, CAST(sum(n) AS BIGINT) AS evidence FROM p GROUP BY ALL HAVING sum(n) >= 5)
SELECT org_id, round(score, 6) AS score, evidence, row_number() OVER (ORDER BY round(score, 6) DESC, org_id) AS slot FROM s"""
)
def score_discovery(spark, sf):
    """Competitors by the sum of their percentiles in every source, at least five records, best first."""
    from pulsegrid.operators.activity import by_org

    r = records(spark, sf).where(F.col("month") > F.lit("2000-05-01").cast("date"))
    t = by_org(r, record_orgs(spark, sf)).groupBy("org_id", "record_type").agg(F.sum("records").alias("n"))
    p = t.select("org_id", "n", C.percentile(F.col("n").cast("double"), ["record_type"]).alias("pct"))
    s = p.groupBy("org_id").agg(r6(F.sum(F.col("pct") * 0.2), "score"), F.sum("n").alias("evidence")).where("evidence >= 5")
    return s.select("org_id", "score", "evidence", F.row_number().over(W.orderBy(F.desc("score"), "org_id")).cast("long").alias("slot"))

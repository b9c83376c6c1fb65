"""Forecasts, their backtests and error measures, rank agreement and ranking backtests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import forecast as P
from pulsegrid.plans.activity import corr, r6, topic_series
from pulsegrid.sources.tables import PRELUDE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["topic"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PRELUDE + sql
        return f

    return add


def history(spark, sf, n: int = 30):
    return topic_series(spark, sf, n)


@query("SELECT topic, CAST(month + to_months(CAST(step AS INTEGER)) AS DATE) AS target, CAST(step AS INTEGER) AS step, v AS predicted FROM topic_series CROSS JOIN range(1, 7) s(step) WHERE ago = 0")
def fc_naive(spark, sf):
    return P.naive(history(spark, sf), KEYS)


@query("SELECT topic, CAST(month + INTERVAL 12 MONTH AS DATE) AS target, CAST(12 - ago AS INTEGER) AS step, v AS predicted FROM topic_series WHERE ago BETWEEN 6 AND 11")
def fc_seasonal_naive(spark, sf):
    return P.seasonal_naive(history(spark, sf), KEYS)


@query(
    """, d AS (SELECT topic, ago, v, v - lag(v) OVER (PARTITION BY topic ORDER BY ago DESC) AS st FROM topic_series WHERE ago < 30),
n AS (SELECT topic, greatest(stddev_pop(st), sqrt(avg(v) FILTER (WHERE ago < 6))) AS noise, max(v) FILTER (WHERE ago = 0) AS p FROM d GROUP BY ALL)
SELECT topic, CAST(step AS INTEGER) AS step, p AS predicted, round(greatest(p - 1.96 * noise * sqrt(step), 0), 6) AS lower, round(p + 1.96 * noise * sqrt(step), 6) AS upper FROM n CROSS JOIN range(1, 7) s(step)"""
)
def fc_interval(spark, sf):
    h = history(spark, sf)
    return P.intervals(h, P.naive(h, KEYS), KEYS).select("topic", "step", "predicted", r6("lower"), r6("upper"))


BACK = """, s AS (SELECT topic, v, 30 - ago AS pos FROM topic_series WHERE ago < 30),
b AS (SELECT o.topic, o.pos AS origin, step, a.v AS actual, o.v AS last, x.v AS season FROM s o CROSS JOIN range(1, 4) r(step) JOIN s a ON a.topic = o.topic AND a.pos = o.pos + step JOIN s x ON x.topic = o.topic AND x.pos = o.pos + step - 12 WHERE o.pos >= 12),
bt AS (SELECT topic, origin, step, actual, 'naive' AS model, last AS predicted FROM b UNION ALL SELECT topic, origin, step, actual, 'seasonal_naive', season FROM b),
base AS (SELECT topic, avg(abs(v - p)) AS scale FROM (SELECT topic, v, lag(v) OVER (PARTITION BY topic ORDER BY pos) AS p FROM s WHERE pos <= 12) GROUP BY ALL)
"""


@query(BACK + "SELECT topic, CAST(origin AS INTEGER) AS origin, CAST(step AS INTEGER) AS step, actual, model, predicted FROM bt")
def fc_backtest(spark, sf):
    return P.naive_backtest(history(spark, sf), KEYS)


def measures(spark, sf):
    """MAE, RMSE, sMAPE and MASE of every model and entity; MASE is scaled by the first twelve months."""
    h = history(spark, sf)
    b = P.naive_backtest(h, KEYS)
    first = h.withColumn("pos", F.row_number().over(W.partitionBy("topic").orderBy("month"))).where("pos <= 12")
    base = first.select("topic", F.abs(F.col("v") - F.lag("v").over(W.partitionBy("topic").orderBy("pos"))).alias("d")).groupBy("topic").agg(F.avg("d").alias("scale"))
    e = F.abs(F.col("actual") - F.col("predicted"))
    total = F.abs("actual") + F.abs("predicted")
    m = b.groupBy("topic", "model").agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(total == 0, 0.0).otherwise(200 * e / F.nullif(total, F.lit(0.0)))).alias("smape"))
    return m.join(base, "topic").select("*", (F.col("mae") / F.nullif("scale", F.lit(0.0))).alias("mase"))


MEASURES = BACK + """, m AS (SELECT topic, model, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0.0 ELSE 200 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) AS smape FROM bt GROUP BY ALL),
ms AS (SELECT m.*, mae / nullif(scale, 0) AS mase FROM m JOIN base USING (topic))
"""


@query(MEASURES + "SELECT topic, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape, round(mase, 6) AS mase, mase < 1 AS beats_naive FROM ms")
def m_errors(spark, sf):
    return measures(spark, sf).select("topic", "model", r6("mae"), r6("rmse"), r6("smape"), r6("mase"), (F.col("mase") < 1).alias("beats_naive"))


@query(MEASURES + "SELECT topic, model, round(metric, 6) AS metric FROM (SELECT topic, model, coalesce(mase, mae) AS metric, row_number() OVER (PARTITION BY topic ORDER BY round(coalesce(mase, mae), 9), model) AS rn FROM ms) WHERE rn = 1")
def fc_select(spark, sf):
    """The model with the lowest error; of equals the simplest."""
    m = measures(spark, sf).withColumn("metric", F.coalesce("mase", "mae"))
    return m.withColumn("rn", F.row_number().over(W.partitionBy("topic").orderBy(F.round("metric", 9), "model"))).where("rn = 1").select("topic", "model", r6("metric"))


@query(MEASURES + "SELECT model, count(*) AS n, round(median(mase), 6) AS med, round(avg(mase), 6) AS mean, round(min(mase), 6) AS lo, round(max(mase), 6) AS hi FROM ms GROUP BY ALL")
def agg_forecast_summary(spark, sf):
    return measures(spark, sf).groupBy("model").agg(F.count("*").alias("n"), r6(F.median("mase"), "med"), r6(F.avg("mase"), "mean"), r6(F.min("mase"), "lo"), r6(F.max("mase"), "hi"))


@query(
    BACK
    + "SELECT topic, model, round(avg(CASE WHEN sign(actual - last) = sign(predicted - last) THEN 1.0 ELSE 0.0 END), 6) AS direction FROM (SELECT bt.*, s.v AS last FROM bt JOIN s ON s.topic = bt.topic AND s.pos = bt.origin) GROUP BY ALL"
)
def m_direction(spark, sf):
    h = history(spark, sf)
    b = P.naive_backtest(h, KEYS)
    s = h.select("topic", F.row_number().over(W.partitionBy("topic").orderBy("month")).alias("origin"), F.col("v").alias("last"))
    hit = F.signum(F.col("actual") - F.col("last")) == F.signum(F.col("predicted") - F.col("last"))
    return b.join(s, ["topic", "origin"]).groupBy("topic", "model").agg(r6(F.avg(F.when(hit, 1.0).otherwise(0.0)), "direction"))


@query("")
def fc_models(spark, sf):
    """Holt, Holt-Winters and autoregression: fitted per entity, so there is no SQL twin."""
    return P.fitted(history(spark, sf), "topic")


RANKS = """, x AS (SELECT topic, sum(v) FILTER (WHERE ago BETWEEN 6 AND 11) AS a, sum(v) FILTER (WHERE ago < 6) AS b FROM topic_series GROUP BY ALL)
"""


def two_scores(spark, sf):
    return topic_series(spark, sf, 12).groupBy("topic").agg(F.sum(F.when(F.col("ago").between(6, 11), F.col("v"))).alias("a"), F.sum(F.when(F.col("ago") < 6, F.col("v"))).alias("b"))


@query(RANKS + ", r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def m_spearman(spark, sf):
    x = two_scores(spark, sf).withColumn("c", F.lit(1))
    rank = lambda k: (F.rank().over(W.partitionBy("c").orderBy(k)) + (F.count("*").over(W.partitionBy("c", k)) - 1) / 2).cast("double")
    r = x.select(rank("a").alias("ra"), rank("b").alias("rb"))
    return r.agg(r6(corr("ra", "rb"), "spearman"))


@query(
    RANKS
    + """, p AS (SELECT sign(l.a - r.a) AS sa, sign(l.b - r.b) AS sb FROM x l JOIN x r ON l.topic < r.topic)
SELECT round(sum(sa * sb) / nullif(sqrt(sum(sa * sa) * sum(sb * sb)), 0), 6) AS kendall FROM p"""
)
def m_kendall(spark, sf):
    """Tau-b by sorting and merging: a ranking has a row for each entity, so it is one task's work, not all pairs'."""
    both = two_scores(spark, sf).agg(F.collect_list(F.struct(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))).alias("x"))
    return both.mapInPandas(P.kendall, "kendall double").select(r6("kendall"))


FOLDS = """, cut AS (SELECT ago AS c FROM months WHERE ago BETWEEN 2 AND 60),
f AS (SELECT c, topic, sum(v) FILTER (WHERE ago BETWEEN c AND c + 2) AS now, sum(v) FILTER (WHERE ago BETWEEN c + 3 AND c + 5) AS before, sum(v) FILTER (WHERE ago BETWEEN c - 2 AND c) AS after, sum(v) FILTER (WHERE ago BETWEEN c + 1 AND c + 3) AS base
  FROM topic_series JOIN cut ON ago BETWEEN c - 2 AND c + 5 GROUP BY ALL),
g AS (SELECT c, topic, ln((now + 1) / (before + 1)) AS score, ln((after + 1) / (base + 1)) AS real FROM f)
"""


def folds(spark, sf):
    """(c, topic, score, real) of every cutoff in one plan: growth up to the cutoff and growth after it.

    The cutoff's month counts in both, as in the rule this follows.
    """
    s = topic_series(spark, sf, 80)
    # a month feeds the cutoffs up to two months before it and five after it
    e = s.select("topic", "ago", "v", F.explode(F.sequence(F.greatest(F.col("ago") - 5, F.lit(2)), F.least(F.col("ago") + 2, F.lit(60)))).alias("c")).where("ago <= 65")
    between = lambda lo, hi: F.sum(F.when(F.col("ago").between(F.col("c") + lo, F.col("c") + hi), F.col("v")))
    g = e.groupBy("c", "topic").agg(between(0, 2).alias("now"), between(3, 5).alias("before"), between(-2, 0).alias("after"), between(1, 3).alias("base"))
    ratio = lambda a, b: F.log((F.col(a) + 1) / (F.col(b) + 1))
    return g.select(F.col("c").cast("long").alias("c"), "topic", ratio("now", "before").alias("score"), ratio("after", "base").alias("real"))


@query(FOLDS + "SELECT c AS cutoff, topic, round(score, 6) AS score, round(real, 6) AS realized FROM g")
def ev_topic_backtest(spark, sf):
    return folds(spark, sf).select(F.col("c").alias("cutoff"), "topic", r6("score"), r6("real", "realized"))


@query(FOLDS + ", r AS (SELECT c, topic, real, row_number() OVER (PARTITION BY c ORDER BY round(score, 9) DESC, topic) AS pos FROM g) SELECT c AS cutoff, round(avg(CASE WHEN real > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision_3 FROM r WHERE pos <= 3 GROUP BY ALL")
def ev_fold_precision(spark, sf):
    r = folds(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("c").orderBy(F.desc(F.round("score", 9)), "topic"))).where("pos <= 3")
    return r.groupBy(F.col("c").alias("cutoff")).agg(r6(F.avg(F.when(F.col("real") > 0, 1.0).otherwise(0.0)), "precision_3"))


@query(FOLDS + ", r AS (SELECT c, topic, row_number() OVER (PARTITION BY c ORDER BY round(score, 9) DESC, topic) AS pos, count(*) OVER (PARTITION BY c) AS n FROM g) SELECT topic, round(avg(pos), 6) AS mean_rank, round(avg(1 - (pos - 1) / (n - 1)), 6) AS percentile FROM r GROUP BY ALL")
def ev_benchmarks(spark, sf):
    r = folds(spark, sf).select("topic", F.row_number().over(W.partitionBy("c").orderBy(F.desc(F.round("score", 9)), "topic")).alias("pos"), F.count("*").over(W.partitionBy("c")).alias("n"))
    return r.groupBy("topic").agg(r6(F.avg("pos"), "mean_rank"), r6(F.avg(1 - (F.col("pos") - 1) / (F.col("n") - 1)), "percentile"))


@query(", b AS (SELECT min(month) AS lo, max(month) AS hi FROM records) SELECT CAST(unnest(generate_series(lo + INTERVAL 15 MONTH, hi - INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS cutoff FROM b")
def ev_cutoffs(spark, sf):
    """Months with fifteen before them and a whole horizon after, of what the records span."""
    from pulsegrid.sources.tables import records

    b = records(spark, sf).agg(F.add_months(F.min("month"), 15).alias("lo"), F.add_months(F.max("month"), -3).alias("hi")).where("lo <= hi")
    return b.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("cutoff"))


@query(FOLDS + ", r AS (SELECT c, topic, real, row_number() OVER (PARTITION BY c ORDER BY round(score, 9) DESC, topic) AS pos FROM g), p AS (SELECT c, avg(CASE WHEN real > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(real) AS gain FROM r WHERE pos <= 3 GROUP BY ALL) SELECT count(*) AS folds, round(avg(hit), 6) AS precision_3, round(avg(gain), 6) AS gain_3 FROM p")
def ev_fold_means(spark, sf):
    """Means over the folds; a fold without a value counts for none."""
    r = folds(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("c").orderBy(F.desc(F.round("score", 9)), "topic"))).where("pos <= 3")
    p = r.groupBy("c").agg(F.avg(F.when(F.col("real") > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg("real").alias("gain"))
    return p.agg(F.count("*").alias("folds"), r6(F.avg("hit"), "precision_3"), r6(F.avg("gain"), "gain_3"))


@query(MEASURES + "SELECT topic, model, mase < 1 AS beats_naive FROM ms")
def m_beats_naive(spark, sf):
    """Whether a model's scaled error is below one; null where the scale is none."""
    return measures(spark, sf).select("topic", "model", (F.col("mase") < 1).alias("beats_naive"))


@query("")
def fc_run(spark, sf):
    """Forecasts of every topic by the best of five models in its backtest; fitted per entity, so there is no SQL twin."""
    return P.selected(history(spark, sf), "topic")

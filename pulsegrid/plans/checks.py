"""Filters, robustness of the rankings, reviews of alerts, candidate topics and classifiers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.operators import cohort as C
from pulsegrid.plans.activity import corr, r6, topic_series, topic_source
from pulsegrid.plans.series import FEATURES, topic_features
from pulsegrid.plans.store import TREND, day
from pulsegrid.sources.tables import PRELUDE, RECORD_TYPES, read, record_orgs, record_topics, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


# filters


@query("SELECT p_type AS topic, count(*) AS parts FROM part WHERE p_size > 5 AND p_retailprice >= 900 GROUP BY ALL", False)
def flt_active_topics(spark, sf):
    """Topics that are switched on (size) and in use (price)."""
    return read(spark, sf, "part").where("p_size > 5 and p_retailprice >= 900").groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("parts"))


@query("SELECT s_suppkey AS org_id, s_acctbal > 5000 AS included, s_nationkey < 5 AS discovered FROM supplier WHERE s_acctbal > 5000 OR s_nationkey < 5", False)
def flt_monitored_orgs(spark, sf):
    return read(spark, sf, "supplier").where("s_acctbal > 5000 or s_nationkey < 5").select(F.col("s_suppkey").alias("org_id"), (F.col("s_acctbal") > 5000).alias("included"), (F.col("s_nationkey") < 5).alias("discovered"))


@query("SELECT id, published_at FROM records WHERE published_at >= TIMESTAMP '2000-03-01' AND published_at < TIMESTAMP '2000-06-01'")
def flt_window(spark, sf):
    """A half-open range of moments; it reaches the scan."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return records(spark, sf).where((F.col("published_at") >= at("2000-03-01")) & (F.col("published_at") < at("2000-06-01"))).select("id", "published_at")


@query("SELECT id, record_type, month FROM records WHERE record_type IN ('patent', 'funding') AND month IN (DATE '2000-01-01', DATE '2000-07-01')")
def flt_in_list(spark, sf):
    return records(spark, sf).where(F.col("record_type").isin("patent", "funding") & F.col("month").isin(day("2000-01-01"), day("2000-07-01"))).select("id", "record_type", "month")


@query("SELECT asked, count(*) AS n FROM (SELECT * FROM (VALUES ('en'), (NULL)) a(asked) CROSS JOIN documents WHERE lang IS NOT DISTINCT FROM asked) GROUP BY ALL", False)
def flt_null_as_all(spark, sf):
    """Rows of a language, or those without one where none is asked for."""
    asked = F.broadcast(spark.createDataFrame([("en",), (None,)], "asked string"))
    d = read(spark, sf, "documents").select("lang")
    return d.join(asked, F.col("lang").eqNullSafe(F.col("asked"))).groupBy("asked").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 + o_custkey % 4 FROM orders WHERE o_orderstatus = 'P')", False)
def flt_tuple_in(spark, sf):
    """Rows whose pair of keys is among the pairs asked for: a semi join."""
    keys = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 4).cast("int").alias("l_linenumber"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(keys, ["l_orderkey", "l_linenumber"], "left_semi")


@query("SELECT p_type AS topic, p_brand AS kind, count(*) AS links FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY ALL", False)
def join_topic_type(spark, sf):
    """Links with the kind of their topic, of the kinds asked for; the filter goes into the dimension's scan."""
    p = read(spark, sf, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", F.col("p_type").alias("topic"), F.col("p_brand").alias("kind"))
    return read(spark, sf, "lineitem").select("l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("topic", "kind").agg(F.count("*").alias("links"))


@query("SELECT event_type AS source, count(*) AS runs, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS received, CAST(sum(CAST(props->>'$.k' AS BIGINT) // 10) AS BIGINT) AS duplicates, round(sum(value), 4) AS seconds FROM events GROUP BY ALL", False)
def agg_run_totals(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("runs"), F.sum(k).alias("received"), F.sum(F.floor(k / 10)).alias("duplicates"), F.round(F.sum("value"), 4).alias("seconds"))


@query("SELECT org_id, topic, recent, row_number() OVER (ORDER BY recent DESC, org_id, topic) AS place FROM (SELECT org_id, topic, count(DISTINCT id) AS recent FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id WHERE month > DATE '2001-01-01' GROUP BY ALL) ORDER BY place LIMIT 100")
def sort_entries(spark, sf):
    """Entries by their records, the most first, then by name."""
    from pulsegrid.plans.activity import agg_entry_totals

    e = agg_entry_totals(spark, sf).where("recent > 0").orderBy(F.desc("recent"), "org_id", "topic").limit(100).select("org_id", "topic", "recent")
    return e.withColumn("place", F.row_number().over(W.orderBy(F.desc("recent"), "org_id", "topic")).cast("long"))


# features as they are stored


@query(
    FEATURES
    + """, x AS (SELECT topic, unnest([{'n': 'momentum', 'v': momentum}, {'n': 'activity_total', 'v': total}, {'n': 'source_agreement', 'v': agreement}, {'n': 'sample_confidence', 'v': sample}, {'n': 'data_completeness', 'v': completeness},
  {'n': 'velocity', 'v': velocity}, {'n': 'consistency', 'v': consistency}, {'n': 'supporting_sources', 'v': CAST(supporting AS DOUBLE)}, {'n': 'growth_patent', 'v': patent_growth}, {'n': 'growth_funding', 'v': funding_growth}]) AS f FROM conf)
SELECT topic, f.n AS feature, round(CAST(f.v AS DOUBLE), 6) AS value FROM x WHERE f.v IS NOT NULL"""
)
def feat_raw_values(spark, sf):
    """Features as tall rows; what cannot be worked out has no row."""
    f = topic_features(spark, sf)
    names = {"momentum": "momentum", "activity_total": "total", "source_agreement": "agreement", "sample_confidence": "sample", "data_completeness": "completeness", "velocity": "velocity", "consistency": "consistency", "supporting_sources": "supporting", "growth_patent": "patent_growth", "growth_funding": "funding_growth"}
    tall = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(c).cast("double"), 6).alias("value")) for n, c in names.items()])
    return f.select("topic", F.explode(tall).alias("x")).select("topic", "x.feature", "x.value").where("value is not null")


@query("SELECT topic, record_type, bool_or(n < 0) AS negative, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS quiet, CASE WHEN bool_or(n < 0) THEN 'rejected' ELSE 'ok' END AS verdict FROM topic_source WHERE ago < 24 GROUP BY ALL")
def fn_series_checks(spark, sf):
    """Series with a negative or odd count are set aside rather than analysed."""
    odd = (F.col("n") < 0) | F.isnan("n") | (F.abs("n") == float("inf"))
    g = topic_source(spark, sf, 24).groupBy("topic", "record_type").agg(F.max(F.col("n") < 0).alias("negative"), F.count_if(F.col("n") == 0).alias("quiet"), F.max(odd).alias("odd"))
    return g.select("topic", "record_type", "negative", "quiet", F.when(F.col("odd"), "rejected").otherwise("ok").alias("verdict"))


METHODS = {"percentile": C.percentile, "minmax": C.min_max, "winsorized": C.winsor_min_max}


def method(name: str):
    """A cohort scale by its name."""
    if name not in METHODS:
        raise ValueError(f"unknown scale {name!r}; one of {', '.join(METHODS)}")
    return METHODS[name]


def _scaled(name: str, c: str = "b", part: str = "") -> str:
    w = f"OVER ({part})"
    flat = f"min({c}) {w} = max({c}) {w}"
    if name == "percentile":
        return f"CASE WHEN {flat} THEN 50.0 ELSE (rank() OVER ({part} ORDER BY {c}) - 1 + 0.5 * count(*) OVER (PARTITION BY {(part.removeprefix('PARTITION BY ') + ', ') if part else ''}{c})) * 100.0 / count(*) {w} END"
    if name == "minmax":
        return f"CASE WHEN {flat} THEN 50.0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) * 100 END"
    lo, hi = (f"quantile_cont({c}, {q}) {w}" for q in (0.05, 0.95))
    return f"CASE WHEN {flat} OR {lo} = {hi} THEN 50.0 ELSE (least(greatest({c}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) * 100 END"


@query("SELECT s_nationkey AS cohort, s_suppkey AS id, count(*) OVER (PARTITION BY s_nationkey) AS size, " + ", ".join(f"round({_scaled(m, 's_acctbal', 'PARTITION BY s_nationkey')}, 6) AS {m}" for m in METHODS) + " FROM supplier", False)
def norm_dispatch(spark, sf):
    """Every scale by its name, with the cohort and its size."""
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").alias("cohort"), F.col("s_suppkey").alias("id"), F.count("*").over(W.partitionBy("s_nationkey")).alias("size"), *[r6(method(m)(F.col("s_acctbal"), ["s_nationkey"]), m) for m in METHODS])


@query("SELECT p_brand AS area, list(DISTINCT p_type ORDER BY p_type) AS topics FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 0", False)
def area_topics(spark, sf):
    """Areas with their topics; an area without any has no row."""
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("area")).agg(F.sort_array(F.collect_set("p_type")).alias("topics")).where(F.size("topics") > 0)


AREA = """, la AS (SELECT DISTINCT l_orderkey AS record_id, s_nationkey AS org_id, p_brand AS area FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
ga AS (SELECT org_id, area, count(*) AS records, ln((count(*) FILTER (WHERE month > DATE '2001-04-01') + 1.0) / (count(*) FILTER (WHERE month <= DATE '2001-04-01' AND month > DATE '2001-01-01') + 1.0)) AS growth FROM records JOIN la ON id = record_id WHERE month > DATE '2000-05-01' GROUP BY ALL HAVING count(*) >= 10)
"""


@query(AREA + f"SELECT org_id, area, records, round({_scaled('percentile', 'growth', 'PARTITION BY area')}, 6) AS threat FROM ga")
def score_threat_by_area(spark, sf):
    """Growth over an area's topics, ranked within the area; pairs of at least ten records."""
    r = records(spark, sf).where(F.col("month") > day("2000-05-01")).select("id", "month")
    line, supplier, part = (read(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    la = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("s_nationkey").alias("org_id"), F.col("p_brand").alias("area"))
    j = r.join(la, "id").distinct()
    now, before = F.count_if(F.col("month") > day("2001-04-01")), F.count_if((F.col("month") <= day("2001-04-01")) & (F.col("month") > day("2001-01-01")))
    g = j.groupBy("org_id", "area").agg(F.count("*").alias("records"), F.log((now + 1.0) / (before + 1.0)).alias("growth")).where("records >= 10")
    return g.select("org_id", "area", "records", r6(C.percentile(F.col("growth"), ["area"]), "threat"))


# robustness


def _ranked(f, weights=TREND):
    score = sum((F.lit(w) * F.col(f"p_{n}") for n, w in weights.items()), F.lit(0.0))
    return f.select("topic", F.round(score, 9).alias("score")).withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), "topic")).cast("long"))


def _compared(base, others):
    """dimension, moved, kept_top3 of rankings against the first one, of those that hold the same topics."""
    out = None
    for name, df in others.items():
        df = df.select(F.lit(name).alias("dimension"), "topic", "pos")
        out = df if out is None else out.unionByName(df)
    names = F.broadcast(base.sparkSession.createDataFrame([(n,) for n in others], "dimension string"))
    want = base.select("topic", F.col("pos").alias("base")).crossJoin(names)
    j = want.join(out, ["dimension", "topic"], "full_outer").groupBy("dimension")
    g = j.agg(F.sum(F.abs(F.col("pos") - F.col("base"))).alias("moved"), F.count_if((F.col("pos") <= 3) & (F.col("base") <= 3)).alias("kept_top3"), F.count_if(F.col("pos").isNull() | F.col("base").isNull()).alias("apart"))
    return g.where("apart = 0").drop("apart")


RANK_SQL = "row_number() OVER (ORDER BY round(" + " + ".join(f"{w} * p_{n}" for n, w in TREND.items()) + ", 9) DESC, topic)"
COMPARE_SQL = " SELECT o.dimension, CAST(sum(abs(o.pos - b.pos)) AS BIGINT) AS moved, CAST(count(*) FILTER (WHERE o.pos <= 3 AND b.pos <= 3) AS BIGINT) AS kept_top3 FROM others o JOIN base b USING (topic) GROUP BY ALL"


def _features_sql(source: str, window: int = 12) -> str:
    return f"(WITH topic_source AS (SELECT * FROM {source}), topic_series AS (SELECT topic, month, ago, CAST(sum(n) AS DOUBLE) AS v FROM topic_source GROUP BY ALL)" + FEATURES.replace("FILTER (WHERE ago < 12)", f"FILTER (WHERE ago < {window})") + " SELECT * FROM p)"


SCALED = "(SELECT topic, " + ", ".join("{0} AS p_" + n for n in TREND) + " FROM f)"


def _method_sql(m: str) -> str:
    inner = "(SELECT topic, " + ", ".join(f"{_scaled(m, n)} AS p_{n}" for n in TREND) + " FROM f)"
    return f"SELECT 'normalization:{m}' AS dimension, topic, {RANK_SQL} AS pos FROM {inner}"


@query(FEATURES + f", base AS (SELECT topic, {RANK_SQL} AS pos FROM p), others AS (" + " UNION ALL ".join(_method_sql(m) for m in METHODS if m != "percentile") + ")" + COMPARE_SQL)
def ev_method(spark, sf):
    """The ranking under every other cohort scale."""
    return _compared(_ranked(topic_features(spark, sf)), {f"normalization:{m}": _ranked(topic_features(spark, sf, scale=method(m))) for m in METHODS if m != "percentile"})


def _without_sql(kinds) -> str:
    return " UNION ALL ".join(f"SELECT 'source_removed:{k}' AS dimension, topic, {RANK_SQL} AS pos FROM {_features_sql('wo_' + k)}" for k in kinds)


WITHOUT = ", all_source AS (SELECT * FROM topic_source), " + ", ".join(f"wo_{k} AS (SELECT topic, record_type, month, ago, CASE WHEN record_type = '{k}' THEN 0 ELSE n END AS n, w FROM topic_source)" for k in RECORD_TYPES)


@query(WITHOUT + f", base AS (SELECT topic, {RANK_SQL} AS pos FROM {_features_sql('all_source')}), others AS ({_without_sql(RECORD_TYPES)})" + COMPARE_SQL)
def ev_source(spark, sf):
    """The ranking as if a source had never been collected, for every source."""
    return _compared(_ranked(topic_features(spark, sf)), {f"source_removed:{k}": _ranked(topic_features(spark, sf, without=k)) for k in RECORD_TYPES})


@query(WITHOUT + f" SELECT topic, round(momentum, 6) AS momentum, round(velocity, 6) AS velocity, CAST(supporting AS BIGINT) AS supporting FROM {_features_sql('wo_patent')}")
def ev_without_source(spark, sf):
    """The features without patents."""
    return topic_features(spark, sf, without="patent").select("topic", r6("momentum"), r6("velocity"), "supporting")


@query(", all_source AS (SELECT * FROM topic_source)" + f", base AS (SELECT topic, {RANK_SQL} AS pos FROM {_features_sql('all_source')}), others AS (SELECT 'window_months' AS dimension, topic, {RANK_SQL} AS pos FROM {_features_sql('all_source', 9)})" + COMPARE_SQL)
def ev_window(spark, sf):
    """The ranking with velocities over nine months instead of twelve."""
    return _compared(_ranked(topic_features(spark, sf)), {"window_months": _ranked(topic_features(spark, sf, window=9))})


@query(FEATURES + ", r AS (SELECT rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS ra, rank() OVER (ORDER BY round(confidence, 9)) + (count(*) OVER (PARTITION BY round(confidence, 9)) - 1) / 2.0 AS rb FROM conf) SELECT round(corr(ra, rb), 6) AS spearman, corr(ra, rb) > 0 AS ok, count(*) AS topics FROM r")
def ev_lowsample(spark, sf):
    """Whether confidence is lower where there are fewer records: the rank correlation of both.

    Topics without a confidence rank last. Where all topics rank alike the correlation is
    NaN, as in SQL, and NaN is above 0; without topics it is null.
    """
    f = topic_features(spark, sf).select("c", "total", F.round("confidence", 9).alias("confidence"))
    rank = lambda k: (F.rank().over(W.partitionBy("c").orderBy(F.asc_nulls_last(k))) + (F.count("*").over(W.partitionBy("c", k)) - 1) / 2).cast("double")
    r = f.select(rank("total").alias("ra"), rank("confidence").alias("rb"))
    return r.agg(r6(corr("ra", "rb"), "spearman"), (corr("ra", "rb") > 0).alias("ok"), F.count("*").alias("topics"))


@query(FEATURES + f" SELECT topic, round({' + '.join(f'{w} * p_{n}' for n, w in TREND.items())}, 6) AS score, {RANK_SQL} AS pos FROM p")
def ev_rank_trend(spark, sf):
    """The ranking that all comparisons start from."""
    return _ranked(topic_features(spark, sf)).select("topic", r6("score"), "pos")


@query(
    """, x AS (SELECT topic, sum(v) FILTER (WHERE ago BETWEEN 6 AND 11) AS a, sum(v) FILTER (WHERE ago < 6) AS b FROM topic_series GROUP BY ALL), r AS (SELECT topic, row_number() OVER (ORDER BY a DESC, topic) AS ra, row_number() OVER (ORDER BY b DESC, topic) AS rb FROM x)
SELECT round(corr(ra, rb), 6) AS spearman, round(count(*) FILTER (WHERE ra <= 3 AND rb <= 3) / 3.0, 6) AS overlap FROM r"""
)
def m_rank_stability(spark, sf):
    """Rank correlation of two rankings' positions, and what their first three share."""
    from pulsegrid.plans.forecasts import two_scores

    x = two_scores(spark, sf).withColumn("c", F.lit(1))
    r = x.select(*[F.row_number().over(W.partitionBy("c").orderBy(F.desc(k), "topic")).cast("double").alias(f"r{k}") for k in ("a", "b")])
    return r.agg(r6(corr("ra", "rb"), "spearman"), r6(F.count_if((F.col("ra") <= 3) & (F.col("rb") <= 3)) / 3.0, "overlap"))


@query(
    """, old AS (SELECT topic, row_number() OVER (ORDER BY topic) AS p FROM topics), new AS (SELECT topic, row_number() OVER (ORDER BY topic DESC) AS p FROM topics WHERE topic <> (SELECT max(topic) FROM topics))
SELECT CAST(count(*) AS BIGINT) AS topics, CAST(count(*) FILTER (WHERE o.topic IS NULL OR n.topic IS NULL) AS BIGINT) AS apart, count(*) FILTER (WHERE o.topic IS NULL OR n.topic IS NULL) = 0 AS comparable FROM old o FULL JOIN new n USING (topic)"""
)
def ev_compare(spark, sf):
    """Two rankings may be compared only if they hold the same topics; here one lacks the last."""
    t = read(spark, sf, "part").join(read(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_type").alias("topic")).distinct()
    last = t.agg(F.max("topic").alias("last"))
    new = t.join(F.broadcast(last), F.col("topic") != F.col("last")).select("topic", F.lit(True).alias("n"))
    j = t.withColumn("o", F.lit(True)).join(new, "topic", "full_outer")
    apart = F.count_if(F.col("o").isNull() | F.col("n").isNull())
    return j.agg(F.count("*").alias("topics"), apart.alias("apart"), (apart == 0).alias("comparable"))


# data quality and evaluation


@query("SELECT event_type AS source, max(ts) AS last_success, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') AS age_days, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') <= 7 AS fresh FROM events WHERE event_type <> 'error' GROUP BY ALL", False)
def ev_fresh(spark, sf):
    """Sources whose last success is at most seven days back."""
    g = read(spark, sf, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_success"))
    age = F.date_diff(day("2024-02-05"), F.col("last_success").cast("date")).cast("long")
    return g.select("source", "last_success", age.alias("age_days"), (age <= 7).alias("fresh"))


RATINGS = ("relevant", "not_relevant", "uncertain", "duplicate")
REVIEWS = "reviews AS (SELECT event_id, user_id % 200 AS insight_id, ([" + ", ".join(f"'{r}'" for r in RATINGS) + "])[1 + CAST(props->>'$.k' AS BIGINT) % 4] AS rating, ts AS reviewed_at FROM events), latest AS (SELECT insight_id, arg_max(rating, (reviewed_at, event_id)) AS rating, max(reviewed_at) AS reviewed_at FROM reviews GROUP BY ALL)"


def latest_reviews(spark, sf):
    """The newest rating of every insight; events stand for reviews."""
    rating = F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (1 + F.get_json_object("props", "$.k").cast("long") % 4).cast("int"))
    r = read(spark, sf, "events").select("event_id", (F.col("user_id") % 200).alias("insight_id"), rating.alias("rating"), F.col("ts").alias("reviewed_at"))
    return r.groupBy("insight_id").agg(F.max_by("rating", F.struct("reviewed_at", "event_id")).alias("rating"), F.max("reviewed_at").alias("reviewed_at"))


@query("WITH " + REVIEWS + " SELECT insight_id, rating, reviewed_at FROM latest", False)
def ev_alert_latest(spark, sf):
    return latest_reviews(spark, sf)


@query("WITH " + REVIEWS + " SELECT section, rows, newest FROM (SELECT rating AS section, count(*) AS rows, max(reviewed_at) AS newest FROM latest GROUP BY ALL)", False)
def ev_latest_stored(spark, sf):
    """The newest stored result of every section."""
    return latest_reviews(spark, sf).groupBy(F.col("rating").alias("section")).agg(F.count("*").alias("rows"), F.max("reviewed_at").alias("newest"))


@query("WITH " + REVIEWS + " SELECT event_id, insight_id, rating FROM reviews WHERE insight_id IN (SELECT n_nationkey FROM nation) AND rating <> 'uncertain'", False)
def ev_record_review(spark, sf):
    """Ratings that are taken down: of a known insight, and of the ratings that judge."""
    rating = F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (1 + F.get_json_object("props", "$.k").cast("long") % 4).cast("int"))
    r = read(spark, sf, "events").select("event_id", (F.col("user_id") % 200).alias("insight_id"), rating.alias("rating")).where("rating <> 'uncertain'")
    known = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("insight_id"))
    return r.join(F.broadcast(known), "insight_id", "left_semi")


ALERTS = """, lev AS (SELECT topic, month, avg(v) OVER (PARTITION BY topic ORDER BY ago DESC ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS level, v, ago FROM topic_series WHERE ago < 40),
alerts AS (SELECT topic, month, greatest(level, 1) AS level, row_number() OVER (ORDER BY topic, month) AS insight_id FROM lev WHERE ago BETWEEN 6 AND 29),
rated AS (SELECT a.*, CASE WHEN insight_id % 7 = 0 THEN NULL WHEN insight_id % 5 = 0 THEN 'duplicate' WHEN insight_id % 3 = 0 THEN 'not_relevant' WHEN insight_id % 11 = 0 THEN 'uncertain' ELSE 'relevant' END AS rating FROM alerts a),
leads AS (SELECT r.insight_id, date_diff('day', r.month, min(l.month)) AS lead FROM rated r JOIN lev l ON l.topic = r.topic AND l.month > r.month AND l.month <= r.month + INTERVAL 6 MONTH AND l.v >= 1.5 * r.level WHERE rating = 'relevant' GROUP BY r.insight_id, r.month)
"""


@query(
    ALERTS
    + """SELECT count(*) AS insights, count(rating) AS reviewed, round(count(*) FILTER (WHERE rating = 'relevant') / nullif(count(*) FILTER (WHERE rating IN ('relevant', 'not_relevant')), 0), 6) AS precision_, round(count(*) FILTER (WHERE rating IN ('relevant', 'uncertain')) / nullif(count(rating), 0), 6) AS acceptance,
  round(count(*) FILTER (WHERE rating = 'duplicate') / nullif(count(rating), 0), 6) AS duplicate_rate, (SELECT median(lead) FROM leads) AS median_lead_days, (SELECT count(*) FROM leads) AS lead_time_measurable FROM rated"""
)
def agg_alert_metrics(spark, sf):
    """Precision, acceptance, duplicates and lead of reviewed alerts: one for each topic and month, rated by their number.

    An alert is confirmed in the first of the next six months with at least one and
    a half times the level of its quarter (one at least).
    """
    s = topic_series(spark, sf, 40)
    by = W.partitionBy("topic").orderBy(F.col("ago").desc())
    ahead = F.filter(F.array(*[F.struct(F.lead("v", i).over(by).alias("v"), F.lead("month", i).over(by).alias("month")) for i in range(1, 7)]), lambda x: x["v"].isNotNull())
    a = s.select("topic", "month", "ago", F.greatest(F.avg("v").over(by.rowsBetween(-2, 0)), F.lit(1.0)).alias("level"), ahead.alias("ahead")).where("ago between 6 and 29")
    a = a.withColumn("n", F.row_number().over(W.orderBy("topic", "month")))
    n = F.col("n")
    rating = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, "duplicate").when(n % 3 == 0, "not_relevant").when(n % 11 == 0, "uncertain").otherwise("relevant")
    first = F.get(F.filter("ahead", lambda x: x["v"] >= 1.5 * F.col("level")), F.lit(0))
    a = a.select(rating.alias("rating"), F.when(rating == "relevant", F.date_diff(first["month"], F.col("month"))).alias("lead"))
    is_ = lambda *names: F.count_if(F.col("rating").isin(*names))
    share = lambda x, y: r6(x / F.nullif(y, F.lit(0)), None)
    known = F.count("rating")
    return a.agg(
        F.count("*").alias("insights"), known.alias("reviewed"), share(is_("relevant"), is_("relevant", "not_relevant")).alias("precision_"), share(is_("relevant", "uncertain"), known).alias("acceptance"),
        share(is_("duplicate"), known).alias("duplicate_rate"), F.median("lead").alias("median_lead_days"), F.count("lead").alias("lead_time_measurable"),
    )


@query("SELECT quality AS rating, count(*) AS rated, round(avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END), 6) AS mean_score FROM labels JOIN documents USING (doc_id) GROUP BY ALL", False)
def ev_expert_summary(spark, sf):
    """Mean score by the experts' rating."""
    j = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy(F.col("quality").alias("rating")).agg(F.count("*").alias("rated"), r6(F.avg(F.when(F.col("n_chars") > 500, 1.0).otherwise(0.0)), "mean_score"))


@query("WITH t AS (SELECT p_type AS topic, count(*) AS records, count(*) FILTER (WHERE p_size > 25) AS accepted, count(*) FILTER (WHERE p_size < 10) AS rejected FROM part GROUP BY ALL) SELECT topic, records, round(accepted / nullif(accepted + rejected, 0), 6) AS accepted_share FROM t ORDER BY records DESC, topic LIMIT 4", False)
def ev_topic_discovery(spark, sf):
    """Of candidate topics, the largest, with the share of reviews that accepted them."""
    t = read(spark, sf, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("records"), F.count_if(F.col("p_size") > 25).alias("accepted"), F.count_if(F.col("p_size") < 10).alias("rejected"))
    return t.orderBy(F.desc("records"), "topic").limit(4).select("topic", "records", r6(F.col("accepted") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0)), "accepted_share"))


@query(", fm AS (SELECT topic, avg(v) AS level, stddev_pop(v) AS dev FROM topic_series WHERE ago < 30 GROUP BY ALL) SELECT topic, CASE WHEN dev > 0 THEN 'mase' ELSE 'mae' END AS metric FROM fm")
def fc_metric(spark, sf):
    """Models are chosen by MASE, or by MAE where a series is flat."""
    g = topic_series(spark, sf, 30).groupBy("topic").agg(F.stddev_pop("v").alias("dev"))
    return g.select("topic", F.when(F.col("dev") > 0, "mase").otherwise("mae").alias("metric"))


@query("SELECT topic, month FROM topic_series WHERE ago < 24 AND month <> DATE '2001-01-01'")
def ev_cleanup(spark, sf):
    """What is left after a fold's rows are dropped."""
    return topic_series(spark, sf, 24).where(F.col("month") != day("2001-01-01")).select("topic", "month")


# candidate topics and classifiers


def dense_groups(spark, sf, reach: float = 0.35, least: int = 5):
    """vec_id, cluster of density clusters by cosine distance.

    A vector is a core with at least ``least`` vectors, itself included, within
    ``reach``; cores within reach share a cluster, named by its smallest core; a
    vector that is no core joins the smallest cluster of a core within reach.
    Pairs meet block by block in Arrow; vectors that may be near are found by random
    projections whose difference bounds the distance, so no pair is lost.
    """
    from pulsegrid.operators.density import clusters

    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return clusters(e, "vec_id", "v", reach, least)


@query("")
def ai_dbscan(spark, sf):
    """Density clusters of the vectors; the tests hold them against brute force."""
    return dense_groups(spark, sf)


def _candidates(spark, sf):
    """label, size, first_id of the label's vectors: candidate topics."""
    return read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"))


@query("WITH c AS (SELECT label, count(*) AS size, min(vec_id) AS first_id FROM embeddings GROUP BY ALL), s AS (SELECT label, size - 1 AS size, first_id FROM c WHERE label % 2 = 0) SELECT c.label, c.size, CASE WHEN s.label IS NULL THEN 'insert' WHEN s.size <> c.size THEN 'update' ELSE 'unchanged' END AS action, false AS active FROM c LEFT JOIN s USING (label)", False)
def ai_store_candidate(spark, sf):
    """Candidate topics as inactive topics: new ones are inserted, stored ones refreshed, none doubled."""
    from pulsegrid.sources.sinks import upsert

    c = _candidates(spark, sf).select("label", "size")
    stored = c.where("label % 2 = 0").withColumn("size", F.col("size") - 1)
    return upsert(stored, c, ["label"], ["size"]).where("action <> 'keep'").select("label", "size", "action", F.lit(False).alias("active"))


@query("WITH c AS (SELECT label, count(*) AS size FROM embeddings GROUP BY ALL), a AS (SELECT label, CASE label % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS action FROM c) SELECT label, coalesce(action = 'approve', false) AS active, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status FROM a", False)
def review_actions(spark, sf):
    """Approved candidates become active; rejected ones stay as they are, out of the queue."""
    action = F.when(F.col("label") % 3 == 0, "approve").when(F.col("label") % 3 == 1, "reject")
    c = _candidates(spark, sf).withColumn("action", action)
    return c.select("label", F.coalesce(F.col("action") == "approve", F.lit(False)).alias("active"), F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("pending").alias("status"))


TOPIC_TERMS = {"articles": ("the", "les", "der"), "conjunctions": ("and", "und", "et"), "negations": ("not", "nicht", "pas")}


@query("SELECT id, record_type, fields FROM (SELECT id, record_type, CASE record_type WHEN 'clinical_trial' THEN ['title', 'conditions', 'abstract'] WHEN 'patent' THEN ['title', 'abstract', 'claims'] WHEN 'publication' THEN ['title', 'mesh', 'abstract'] ELSE ['title', 'abstract'] END AS fields FROM records)")
def topic_fields(spark, sf):
    """The fields of each type of record in which topics are looked for."""
    of = {"clinical_trial": ("title", "conditions", "abstract"), "patent": ("title", "abstract", "claims"), "publication": ("title", "mesh", "abstract")}
    fields = F.array(F.lit("title"), F.lit("abstract"))
    for k, names in of.items():
        fields = F.when(F.col("record_type") == k, F.array(*[F.lit(n) for n in names])).otherwise(fields)
    return records(spark, sf).select("id", "record_type", fields.alias("fields"))


def classifier_folds(spark, sf, folds: int = 5):
    """doc_id, toxic, fold: folds dealt out within each label."""
    lab = read(spark, sf, "labels").select("doc_id", "toxic")
    return lab.withColumn("fold", (F.row_number().over(W.partitionBy("toxic").orderBy("doc_id")) % folds).cast("int"))


def _fitted(train, rows):
    """Words and pairs of words, weighed by rarity, in a balanced logistic regression; ``rows`` with its prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, NGram, SQLTransformer, Tokenizer, VectorAssembler

    n = train.count()
    weights = train.groupBy("toxic").agg((n / (2 * F.count("*"))).alias("weight"))
    stages = [
        Tokenizer(inputCol="text", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="tfidf"), VectorAssembler(inputCols=["tfidf"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=30),
    ]
    data = train.join(F.broadcast(weights), "toxic").withColumn("label", F.col("toxic").cast("double"))
    return Pipeline(stages=stages).fit(data).transform(rows)


@query("")
def ai_classifier(spark, sf):
    """Predictions for all texts by a classifier of the labelled ones; a class needs three texts."""
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = docs.join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return _fitted(train, docs).select("doc_id", F.col("prediction").cast("int").alias("toxic"))


@query("")
def ev_ai_ablation(spark, sf):
    """Keyword rules against a classifier that never saw the fold it judges: recall of each class."""
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(classifier_folds(spark, sf), "doc_id")
    said = None
    for fold in range(5):
        got = _fitted(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)).select("doc_id", "toxic", F.col("prediction").cast("int").alias("said"))
        said = got if said is None else said.unionByName(got)
    rules = rows.select("doc_id", "toxic", F.when(X.first_rule(F.col("text"), X.ANNOUNCEMENTS, "other") != "other", 1).otherwise(0).alias("said"))
    both = said.withColumn("kind", F.lit("classifier")).unionByName(rules.withColumn("kind", F.lit("keyword")))
    return both.groupBy("kind", F.col("toxic").alias("label")).agg(F.count("*").alias("n"), r6(F.avg((F.col("toxic") == F.col("said")).cast("double")), "recall"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'cached' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'classifier' ELSE 'keyword' END AS tier, CASE WHEN doc_id % 7 = 0 THEN 'partnership' WHEN doc_id IN (SELECT doc_id FROM labels) THEN (SELECT CASE WHEN l.toxic = 1 THEN 'regulatory' ELSE 'funding' END FROM labels l WHERE l.doc_id = d.doc_id) ELSE 'other' END AS kind FROM documents d WHERE text IS NOT NULL AND NOT regexp_matches(lower(text), 'merger|license agreement|ipo|series a|series b|series c|joint venture|interim analysis')", False)
def ai_extract_tiers(spark, sf):
    """What a text announces, by the first tier that knows: stored answers, the classifier's (labels stand for it), keyword rules."""
    d = read(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.lower("text").rlike("merger|license agreement|ipo|series a|series b|series c|joint venture|interim analysis"))
    cached = d.where("doc_id % 7 = 0").select("doc_id", F.lit("partnership").alias("cached"))
    lab = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "regulatory").otherwise("funding").alias("told"))
    j = d.select("doc_id", "text").join(cached, "doc_id", "left").join(lab, "doc_id", "left")
    rules = X.first_rule(F.col("text"), X.ANNOUNCEMENTS, "other")
    return j.select("doc_id", F.when(F.col("cached").isNotNull(), "cached").when(F.col("told").isNotNull(), "classifier").otherwise("keyword").alias("tier"), F.coalesce("cached", "told", rules).alias("kind"))

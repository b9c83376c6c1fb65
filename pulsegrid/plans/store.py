"""Stored scores of two dates, the insights drawn from them with their evidence, the fact tables, and the reads that a service offers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.operators import cohort as C
from pulsegrid.operators.graph import written
from pulsegrid.plans.activity import CUBE, agg_hhi_density, cube, r6
from pulsegrid.plans.series import FEATURES, INNOVATION, topic_features
from pulsegrid.sources.tables import PRELUDE, read, record_orgs, record_topics, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: str = PRELUDE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = prelude + sql
        return f

    return add


def day(x):
    return F.lit(x).cast("date")


# Weights, gates, bands, and what makes an insight.
TREND = {"velocity": 0.30, "momentum": 0.25, "patent_growth": 0.20, "funding_growth": 0.15, "consistency": 0.10}
LEAST_TREND, LEAST_CONFIDENCE, LEAST_SAMPLE, LEAST_SOURCES = 60, 60, 10, 2
RANK_MOVE, SURGE, EVIDENCE = 2, 85.0, 8
#: Scoring dates: the last complete month and the one before.
DATES = ("2001-07-01", "2001-06-01")


def topic_ids(spark, sf):
    """topic, topic_id: ids in name order, for the few topics."""
    t = read(spark, sf, "part").select(F.col("p_type").alias("topic")).distinct()
    return t.withColumn("topic_id", F.row_number().over(W.orderBy("topic")).cast("long"))


def _part(name, raw, normalized, weight):
    c = lambda x: x.cast("double")
    return F.struct(F.lit(name).alias("component"), F.round(c(raw), 6).alias("raw_value"), F.round(c(normalized), 6).alias("normalized_value"), F.lit(weight).cast("double").alias("weight"), F.round(c(normalized) * weight, 6).alias("points"), normalized.isNotNull().alias("is_available"))


def _gates(**tests):
    """Names of the tests that fail, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda n: n.isNotNull())


def trend_scores(spark, sf, back: int = 0):
    f = topic_features(spark, sf, back)
    failed = _gates(score=F.col("trend") >= LEAST_TREND, confidence=F.col("confidence") >= LEAST_CONFIDENCE, sample=F.col("total") >= LEAST_SAMPLE, sources=F.col("supporting") >= LEAST_SOURCES, steady=~F.col("single_spike"))
    parts = F.array(*[_part(n, F.col(n), F.col(f"p_{n}"), w) for n, w in sorted(TREND.items())])
    return f.select(day(DATES[back]).alias("score_date"), F.lit("topic").alias("entity_type"), F.col("topic").alias("entity"), F.lit("trend").alias("score_type"), "trend", "confidence", F.col("total").cast("long").alias("sample_size"), failed.alias("failed"), parts.alias("components"), F.col("supporting").cast("long").alias("supporting"), "agreement", "single_spike").withColumnRenamed("trend", "score_value")


def opportunity_scores(spark, sf):
    """Trend, open competition and agreement; a density that could not be measured shares its weight out, and fails a gate."""
    t = trend_scores(spark, sf)
    density = agg_hhi_density(spark, sf).select(F.col("topic").alias("entity"), "density")
    j = t.join(density, "entity", "left").withColumn("openness", 100 - F.col("density"))
    value = F.when(F.col("density").isNotNull(), 0.60 * F.col("score_value") + 0.25 * F.col("openness") + 0.15 * F.col("agreement") * 100).otherwise((0.60 * F.col("score_value") + 0.15 * F.col("agreement") * 100) / 0.75)
    failed = _gates(evidence=F.col("sample_size") >= LEAST_SAMPLE, confidence=F.col("confidence") >= LEAST_CONFIDENCE, sources=F.col("supporting") >= LEAST_SOURCES, spread=(F.col("sample_size") >= 2) & ~F.col("single_spike"), competition=F.col("density").isNotNull())
    parts = F.array(_part("agreement", F.col("agreement"), F.col("agreement") * 100, 0.15), _part("low_competition", F.col("density"), F.col("openness"), 0.25), _part("trend", F.col("score_value"), F.col("score_value"), 0.60))
    return j.select("score_date", "entity_type", "entity", F.lit("opportunity").alias("score_type"), value.alias("score_value"), "confidence", "sample_size", failed.alias("failed"), parts.alias("components"), "supporting", "openness")


def innovation_scores(spark, sf):
    """Both dates in one scan: percentiles of each source's level among organizations over the fourteen months to a date."""
    r, o = records(spark, sf), record_orgs(spark, sf)
    j = r.join(o, r["id"] == o["record_id"]).select("org_id", "id", "record_type", "month")
    at = F.explode(F.array(*[F.lit(d).cast("date") for d in DATES]))
    j = j.withColumn("score_date", at).where((F.col("month") <= F.col("score_date")) & (F.col("month") > F.add_months("score_date", -14)))
    a = j.groupBy("score_date", "org_id").agg(*[F.count_distinct(F.when(F.col("record_type") == k, F.col("id"))).cast("double").alias(k) for k in INNOVATION], F.count_distinct("id").alias("sample_size"))
    top = W.partitionBy("score_date")
    p = a.select("*", *[F.when(F.max(k).over(top) > 0, C.percentile(F.col(k), ["score_date"])).alias(f"p_{k}") for k in INNOVATION])
    have = sum((F.when(F.col(f"p_{k}").isNotNull(), w).otherwise(0.0) for k, w in INNOVATION.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(f"p_{k}") * w, F.lit(0.0)) for k, w in INNOVATION.items()), F.lit(0.0))
    confidence = 100 * (1 - F.exp(-F.col("sample_size") / 25))
    parts = F.array(*[_part(k, F.col(k), F.col(f"p_{k}"), w) for k, w in sorted(INNOVATION.items())])
    name = F.concat(F.lit("organization "), F.col("org_id").cast("string"))
    s = p.select("score_date", "org_id", F.lit("competitor").alias("entity_type"), name.alias("entity"), F.lit("innovation").alias("score_type"), F.round(got / have, 9).alias("score_value"), confidence.alias("confidence"), "sample_size", parts.alias("components"))
    return s.withColumn("rank", F.rank().over(W.partitionBy("score_date").orderBy(F.desc("score_value"))).cast("long"))


SCORE = ("score_date", "entity_type", "entity_id", "entity", "score_type", "score_value", "confidence", "sample_size", "failed", "components")


def stored_scores(spark, sf):
    """All scores of both dates, with the ids of their entities."""
    ids = topic_ids(spark, sf).select(F.col("topic").alias("entity"), F.col("topic_id").alias("entity_id"))
    topics = None
    for df in (trend_scores(spark, sf), trend_scores(spark, sf, 1), opportunity_scores(spark, sf)):
        df = df.join(F.broadcast(ids), "entity").select(*SCORE)
        topics = df if topics is None else topics.unionByName(df)
    orgs = innovation_scores(spark, sf).select("*", F.col("org_id").cast("long").alias("entity_id"), F.array().cast("array<string>").alias("failed")).select(*SCORE)
    return topics.unionByName(orgs)


def _part_sql(name, raw, normalized, weight):
    return f"{{'component': '{name}', 'raw_value': round(CAST({raw} AS DOUBLE), 6), 'normalized_value': round(CAST({normalized} AS DOUBLE), 6), 'weight': CAST({weight} AS DOUBLE), 'points': round(CAST({normalized} AS DOUBLE) * {weight}, 6), 'is_available': {normalized} IS NOT NULL}}"


def _gates_sql(**tests):
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{n}' END" for n, t in tests.items()) + "], lambda n: n IS NOT NULL)"


SPIKE = "(coalesce(largest_share, 0) >= 0.5 AND consistency < 0.5)"


def features_at(back: int) -> str:
    """All of FEATURES as things stood ``back`` months ago, as a subquery over ts0."""
    return f"(WITH topic_source AS (SELECT topic, record_type, month, ago - {back} AS ago, n, w FROM ts0 WHERE ago >= {back}), topic_series AS (SELECT topic, month, ago, CAST(sum(n) AS DOUBLE) AS v FROM topic_source GROUP BY ALL){FEATURES} SELECT * FROM conf)"


def _trend_sql(back: int) -> str:
    gates = _gates_sql(score="trend >= 60", confidence="confidence >= 60", sample="total >= 10", sources="supporting >= 2", steady=f"NOT {SPIKE}")
    parts = "[" + ", ".join(_part_sql(n, n, f"p_{n}", w) for n, w in sorted(TREND.items())) + "]"
    return f"SELECT DATE '{DATES[back]}' AS score_date, 'topic' AS entity_type, topic AS entity, 'trend' AS score_type, trend AS score_value, confidence, CAST(total AS BIGINT) AS sample_size, {gates} AS failed, {parts} AS components, CAST(supporting AS BIGINT) AS supporting, agreement, {SPIKE} AS single_spike FROM {features_at(back)}"


INNO_COUNTS = ", ".join(f"CAST(count(DISTINCT id) FILTER (WHERE record_type = '{k}') AS DOUBLE) AS {k}" for k in INNOVATION)
INNO_PCT = ", ".join(f"CASE WHEN max({k}) OVER d = 0 THEN NULL WHEN min({k}) OVER d = max({k}) OVER d THEN 50.0 ELSE (rank() OVER (PARTITION BY score_date ORDER BY {k}) - 1 + 0.5 * count(*) OVER (PARTITION BY score_date, {k})) * 100.0 / count(*) OVER d END AS p_{k}" for k in INNOVATION)
SCORES = f""", ts0 AS (SELECT * FROM topic_source), tid AS (SELECT topic, row_number() OVER (ORDER BY topic) AS topic_id FROM (SELECT DISTINCT p_type AS topic FROM part)),
tr AS ({_trend_sql(0)}), tr1 AS ({_trend_sql(1)}),
act AS (SELECT topic, org_id, sum(o.confidence * t.confidence) AS w FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id WHERE month > DATE '2000-07-01' GROUP BY ALL HAVING sum(o.confidence * t.confidence) >= 1),
dens AS (SELECT topic, round(100 * (1 - exp(-(1 / sum(share * share)) / 8)), 6) AS density FROM (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS share FROM act) GROUP BY ALL),
op AS (SELECT score_date, entity_type, entity, 'opportunity' AS score_type, CASE WHEN density IS NOT NULL THEN 0.60 * score_value + 0.25 * (100 - density) + 0.15 * agreement * 100 ELSE (0.60 * score_value + 0.15 * agreement * 100) / 0.75 END AS score_value, confidence, sample_size,
  {_gates_sql(evidence='sample_size >= 10', confidence='confidence >= 60', sources='supporting >= 2', spread='sample_size >= 2 AND NOT single_spike', competition='density IS NOT NULL')} AS failed,
  [{_part_sql('agreement', 'agreement', '(agreement * 100)', 0.15)}, {_part_sql('low_competition', 'density', '(100 - density)', 0.25)}, {_part_sql('trend', 'score_value', 'score_value', 0.60)}] AS components, supporting, 100 - density AS openness FROM tr LEFT JOIN dens ON dens.topic = entity),
dts(score_date) AS (VALUES (DATE '{DATES[0]}'), (DATE '{DATES[1]}')),
ia AS (SELECT score_date, org_id, {INNO_COUNTS}, count(DISTINCT id) AS sample_size FROM records JOIN record_orgs ON id = record_id JOIN dts ON month <= score_date AND month > score_date - INTERVAL 14 MONTH GROUP BY ALL),
ip AS (SELECT *, {INNO_PCT} FROM ia WINDOW d AS (PARTITION BY score_date)),
inn0 AS (SELECT score_date, org_id, 'competitor' AS entity_type, 'organization ' || org_id AS entity, 'innovation' AS score_type, round(({' + '.join(f'coalesce({w} * p_{k}, 0)' for k, w in INNOVATION.items())}) / ({' + '.join(f'CASE WHEN p_{k} IS NULL THEN 0 ELSE {w} END' for k, w in INNOVATION.items())}), 9) AS score_value,
  100 * (1 - exp(-sample_size / 25)) AS confidence, sample_size, [{', '.join(_part_sql(k, k, f'p_{k}', w) for k, w in sorted(INNOVATION.items()))}] AS components FROM ip),
inn AS (SELECT *, rank() OVER (PARTITION BY score_date ORDER BY score_value DESC) AS rank FROM inn0),
scores AS (SELECT score_date, entity_type, topic_id AS entity_id, entity, score_type, score_value, confidence, sample_size, failed, components FROM (SELECT * EXCLUDE (supporting, agreement, single_spike) FROM tr UNION ALL SELECT * EXCLUDE (supporting, agreement, single_spike) FROM tr1 UNION ALL SELECT * EXCLUDE (supporting, openness) FROM op) JOIN tid ON topic = entity
  UNION ALL SELECT score_date, entity_type, CAST(org_id AS BIGINT), entity, score_type, score_value, confidence, sample_size, CAST([] AS VARCHAR[]), components FROM inn)
"""
BAND = "CASE WHEN score_value >= 80 THEN 'strong' WHEN score_value >= 60 THEN 'rising' WHEN score_value >= 40 THEN 'steady' ELSE 'weak' END"


def band(c):
    return F.when(c >= 80, "strong").when(c >= 60, "rising").when(c >= 40, "steady").otherwise("weak")


@query(SCORES + f"SELECT score_date, entity_type, entity, score_type, round(score_value, 6) AS score, round(confidence, 6) AS confidence, {BAND} AS category, len(failed) = 0 AS qualified, array_to_string(failed, ', ') AS failed_rules, sample_size FROM scores")
def prj_score_row(spark, sf):
    s = stored_scores(spark, sf)
    return s.select("score_date", "entity_type", "entity", "score_type", r6("score_value", "score"), r6("confidence"), band(F.col("score_value")).alias("category"), (F.size("failed") == 0).alias("qualified"), F.array_join("failed", ", ").alias("failed_rules"), "sample_size")


@query(SCORES + "SELECT topic, round(0.60 * score_value + 0.25 * (100 - density) + 0.15 * agreement * 100, 6) AS opportunity, round(density, 6) AS density FROM tr JOIN dens ON topic = entity")
def score_opportunity(spark, sf):
    """Of the topics whose competition could be measured."""
    o = opportunity_scores(spark, sf).where("openness is not null")
    return o.select(F.col("entity").alias("topic"), r6("score_value", "opportunity"), r6(100 - F.col("openness"), "density"))


@query(", d AS (SELECT DISTINCT month FROM records) SELECT max(month) AS latest, max(month) FILTER (WHERE month <= DATE '2000-02-15') AS known, max(month) FILTER (WHERE month < (SELECT max(month) FROM d)) AS earlier FROM d")
def prj_latest_date(spark, sf):
    """The latest date, the latest one by a day, and the one before the latest: of distinct months, so in one small aggregate."""
    d = records(spark, sf).select("month").distinct()
    top = d.agg(F.array_sort(F.collect_set("month"), lambda a, b: F.date_diff(b, a)).alias("all"))
    return top.select(F.get("all", F.lit(0)).alias("latest"), F.get(F.filter("all", lambda m: m <= day("2000-02-15")), F.lit(0)).alias("known"), F.get("all", F.lit(1)).alias("earlier"))


@query(SCORES + "SELECT entity_type, entity, score_type, list(round(score_value, 6) ORDER BY score_date) AS scores, CAST(count(*) AS BIGINT) AS dates FROM scores GROUP BY ALL")
def score_history(spark, sf):
    """Every score through its dates, oldest first."""
    s = stored_scores(spark, sf).groupBy("entity_type", "entity", "score_type").agg(F.array_sort(F.collect_list(F.struct("score_date", F.round("score_value", 6).alias("v")))).alias("x"), F.count("*").alias("dates"))
    return s.select("entity_type", "entity", "score_type", F.transform("x", lambda x: x["v"]).alias("scores"), "dates")


@query(SCORES + "SELECT entity, score_type, round(arg_max(score_value, score_date), 6) AS previous, max(score_date) AS previous_date FROM scores WHERE score_date < (SELECT max(score_date) FROM scores) GROUP BY ALL")
def score_previous(spark, sf):
    s = stored_scores(spark, sf)
    last = s.agg(F.max("score_date").alias("last"))
    return s.join(F.broadcast(last), F.col("score_date") < F.col("last")).groupBy("entity", "score_type").agg(r6(F.max_by("score_value", "score_date"), "previous"), F.max("score_date").alias("previous_date"))


@query(FEATURES + "SELECT topic, '{\"total\":' || CAST(total AS BIGINT) || ',\"supporting\":' || supporting || ',\"available\":' || available || '}' AS inputs FROM conf")
def score_evidence(spark, sf):
    f = topic_features(spark, sf)
    return f.select("topic", F.to_json(F.struct(F.col("total").cast("long").alias("total"), "supporting", "available")).alias("inputs"))


STABLE = ("velocity", "momentum", "consistency")


@query(
    SCORES
    + ", a AS (SELECT entity, unnest(components) AS c FROM tr), b AS (SELECT entity, unnest(components) AS c FROM tr1) "
    + "SELECT a.entity AS topic, round(1 - avg(abs(a.c.normalized_value - b.c.normalized_value)) / 100, 5) AS stability FROM a JOIN b ON a.entity = b.entity AND a.c.component = b.c.component WHERE a.c.component IN ('velocity', 'momentum', 'consistency') GROUP BY ALL"
)
def win_stability(spark, sf):
    """One less the mean change of the normalized velocity, momentum and consistency since the date before."""
    now, before = (trend_scores(spark, sf, back).select("entity", F.explode("components").alias("c")).select("entity", "c.component", F.col("c.normalized_value").alias(f"v{back}")) for back in (0, 1))
    j = now.join(before, ["entity", "component"]).where(F.col("component").isin(*STABLE))
    return j.groupBy(F.col("entity").alias("topic")).agg(F.round(1 - F.avg(F.abs(F.col("v0") - F.col("v1"))) / 100, 5).alias("stability"))


# insights


INSIGHT = ("insight_type", "entity_type", "entity_id", "entity", "severity", "confidence", "title", "observed_fact", "dedupe_key")


def severity(c):
    return F.when(c >= 80, "high").when(c >= 60, "medium").otherwise("low")


SEVERITY = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'medium' ELSE 'low' END"


def whole(c):
    return F.round(c, 0).cast("long").cast("string")


def with_ids(spark, sf, scores):
    return scores.join(F.broadcast(topic_ids(spark, sf).select(F.col("topic").alias("entity"), F.col("topic_id").alias("entity_id"))), "entity")


def emerging(spark, sf):
    t = with_ids(spark, sf, trend_scores(spark, sf)).where((F.size(F.filter("failed", lambda x: x != "score")) <= 1) & (F.col("score_value") >= 50))
    fact = F.concat("entity", F.lit(" scored "), whole(F.col("score_value")), F.lit("/100 for trend strength, backed by "), F.col("sample_size").cast("string"), F.lit(" record(s)."))
    return t.select(F.lit("emerging_trend").alias("insight_type"), "entity_type", "entity_id", "entity", severity(F.col("score_value")).alias("severity"), "confidence", F.concat("entity", F.lit(": emerging trend")).alias("title"), fact.alias("observed_fact"), F.concat(F.lit("emerging_trend:topic:"), "entity_id", F.lit(":2001-07")).alias("dedupe_key"))


def movement(spark, sf):
    i = innovation_scores(spark, sf)
    now, before = (i.where(F.col("score_date") == day(d)) for d in DATES)
    j = now.join(before.select("org_id", F.col("rank").alias("was")), "org_id").where(F.abs(F.col("was") - F.col("rank")) >= RANK_MOVE)
    way = F.when(F.col("rank") < F.col("was"), "up").otherwise("down")
    fact = F.concat("entity", F.lit(" moved "), way, F.lit(" from rank "), "was", F.lit(" to rank "), "rank", F.lit(" on innovation output (score "), whole(F.col("score_value")), F.lit("/100)."))
    return j.select(F.lit("competitor_movement").alias("insight_type"), "entity_type", F.col("org_id").cast("long").alias("entity_id"), "entity", F.lit("watch").alias("severity"), "confidence", F.concat("entity", F.lit(": moved "), way, F.lit(" the innovation ranking")).alias("title"), fact.alias("observed_fact"), F.concat(F.lit("competitor_movement:competitor:"), "org_id", F.lit(":2001-07:"), "rank").alias("dedupe_key"))


def market_entries(spark, sf):
    """Organizations with three records or more of a topic in six months and none in the eighteen before."""
    from pulsegrid.plans.activity import agg_entry_totals

    e = agg_entry_totals(spark, sf).where("recent >= 3 and before = 0")
    ids = topic_ids(spark, sf)
    name = F.concat(F.lit("organization "), F.col("org_id").cast("string"))
    e = e.join(F.broadcast(ids), "topic").withColumn("entity", name)
    fact = F.concat("entity", F.lit(" recorded "), "recent", F.lit(" record(s) in "), "topic", F.lit(" after 18 month(s) with none."))
    return e.select(F.lit("new_market_entry").alias("insight_type"), F.lit("competitor").alias("entity_type"), F.col("org_id").cast("long").alias("entity_id"), "entity", F.lit("watch").alias("severity"), F.lit(100.0).alias("confidence"), F.concat("entity", F.lit(": entered "), "topic").alias("title"), fact.alias("observed_fact"), F.concat(F.lit("new_market_entry:"), "org_id", F.lit(":"), "topic_id", F.lit(":2001-07")).alias("dedupe_key"))


def patent_surges(spark, sf):
    t = with_ids(spark, sf, trend_scores(spark, sf))
    t = t.withColumn("c", F.get(F.filter("components", lambda c: c["component"] == "patent_growth"), F.lit(0))).where((F.col("c.normalized_value") >= SURGE) & (F.col("c.raw_value") > 0))
    fact = F.concat(F.lit("Patent activity for topic "), "entity", F.lit(" grew by roughly "), whole((F.exp("c.raw_value") - 1) * 100), F.lit("% over the comparison period."))
    return t.select(F.lit("patent_surge").alias("insight_type"), "entity_type", "entity_id", "entity", severity(F.col("c.normalized_value")).alias("severity"), "confidence", F.concat("entity", F.lit(": patent activity surge")).alias("title"), fact.alias("observed_fact"), F.concat(F.lit("patent_surge:topic:"), "entity_id", F.lit(":2001-07")).alias("dedupe_key"))


def opportunities(spark, sf):
    o = with_ids(spark, sf, opportunity_scores(spark, sf)).where("score_value >= 30")
    note = F.when(F.col("openness") >= 80, "very few competitors are active in it").otherwise("the field is not yet crowded")
    fact = F.concat("entity", F.lit(" scored "), whole(F.col("score_value")), F.lit("/100 for opportunity: it is trending and "), note, F.lit("."))
    return o.select(F.lit("opportunity").alias("insight_type"), "entity_type", "entity_id", "entity", severity(F.col("score_value")).alias("severity"), "confidence", F.concat("entity", F.lit(": opportunity for review")).alias("title"), fact.alias("observed_fact"), F.concat(F.lit("opportunity:topic:"), "entity_id", F.lit(":2001-07")).alias("dedupe_key"))


N0 = lambda x: f"CAST(CAST(round({x}, 0) AS BIGINT) AS VARCHAR)"
EMERGING = f"""SELECT 'emerging_trend' AS insight_type, entity_type, entity_id, entity, {SEVERITY.format('score_value')} AS severity, confidence, entity || ': emerging trend' AS title, entity || ' scored ' || {N0('score_value')} || '/100 for trend strength, backed by ' || sample_size || ' record(s).' AS observed_fact, 'emerging_trend:topic:' || entity_id || ':2001-07' AS dedupe_key
  FROM scores WHERE score_type = 'trend' AND score_date = DATE '2001-07-01' AND len(list_filter(failed, lambda x: x <> 'score')) <= 1 AND score_value >= 50"""
MOVEMENT = f"""SELECT 'competitor_movement' AS insight_type, n.entity_type, CAST(n.org_id AS BIGINT) AS entity_id, n.entity, 'watch' AS severity, n.confidence, n.entity || ': moved ' || way || ' the innovation ranking' AS title, n.entity || ' moved ' || way || ' from rank ' || was || ' to rank ' || n.rank || ' on innovation output (score ' || {N0('n.score_value')} || '/100).' AS observed_fact, 'competitor_movement:competitor:' || n.org_id || ':2001-07:' || n.rank AS dedupe_key
  FROM (SELECT a.*, b.rank AS was, CASE WHEN a.rank < b.rank THEN 'up' ELSE 'down' END AS way FROM inn a JOIN inn b USING (org_id) WHERE a.score_date = DATE '2001-07-01' AND b.score_date = DATE '2001-06-01' AND abs(a.rank - b.rank) >= 2) n"""
ENTRIES = """SELECT 'new_market_entry' AS insight_type, 'competitor' AS entity_type, CAST(org_id AS BIGINT) AS entity_id, 'organization ' || org_id AS entity, 'watch' AS severity, CAST(100 AS DOUBLE) AS confidence, 'organization ' || org_id || ': entered ' || topic AS title, 'organization ' || org_id || ' recorded ' || recent || ' record(s) in ' || topic || ' after 18 month(s) with none.' AS observed_fact, 'new_market_entry:' || org_id || ':' || topic_id || ':2001-07' AS dedupe_key
  FROM (SELECT org_id, topic, count(DISTINCT id) FILTER (WHERE month > DATE '2001-01-01') AS recent, count(DISTINCT id) FILTER (WHERE month <= DATE '2001-01-01' AND month > DATE '1999-07-01') AS before FROM records JOIN record_orgs o ON id = o.record_id JOIN record_topics t ON id = t.record_id GROUP BY ALL) JOIN tid USING (topic) WHERE recent >= 3 AND before = 0"""
SURGES = f"""SELECT 'patent_surge' AS insight_type, entity_type, entity_id, entity, {SEVERITY.format('c.normalized_value')} AS severity, confidence, entity || ': patent activity surge' AS title, 'Patent activity for topic ' || entity || ' grew by roughly ' || {N0('(exp(c.raw_value) - 1) * 100')} || '% over the comparison period.' AS observed_fact, 'patent_surge:topic:' || entity_id || ':2001-07' AS dedupe_key
  FROM (SELECT *, list_filter(components, lambda x: x.component = 'patent_growth')[1] AS c FROM scores WHERE score_type = 'trend' AND score_date = DATE '2001-07-01') WHERE c.normalized_value >= 85 AND c.raw_value > 0"""
OPENINGS = f"""SELECT 'opportunity' AS insight_type, entity_type, topic_id AS entity_id, entity, {SEVERITY.format('score_value')} AS severity, confidence, entity || ': opportunity for review' AS title, entity || ' scored ' || {N0('score_value')} || '/100 for opportunity: it is trending and ' || CASE WHEN openness >= 80 THEN 'very few competitors are active in it' ELSE 'the field is not yet crowded' END || '.' AS observed_fact, 'opportunity:topic:' || topic_id || ':2001-07' AS dedupe_key
  FROM op JOIN tid ON topic = entity WHERE score_value >= 30"""
ROW = "SELECT insight_type, entity_type, entity_id, entity, severity, round(CAST(confidence AS DOUBLE), 6) AS confidence, title, observed_fact, dedupe_key FROM ("


def _insight(df):
    return df.select(*[r6("confidence") if c == "confidence" else c for c in INSIGHT])


@query(SCORES + ROW + EMERGING + ")")
def insight_emerging(spark, sf):
    return _insight(emerging(spark, sf))


@query(SCORES + ROW + MOVEMENT + ")")
def insight_movement(spark, sf):
    return _insight(movement(spark, sf))


@query(SCORES + ROW + ENTRIES + ")")
def insight_entry(spark, sf):
    return _insight(market_entries(spark, sf))


@query(SCORES + ROW + SURGES + ")")
def insight_patent_surge(spark, sf):
    return _insight(patent_surges(spark, sf))


@query(SCORES + ROW + OPENINGS + ")")
def insight_opportunity(spark, sf):
    return _insight(opportunities(spark, sf))


def candidates(spark, sf):
    """What all rules find, as a table: it is read more than once, and five rules are not worked out again each time."""
    out = None
    for rule in (emerging, movement, market_entries, patent_surges, opportunities):
        df = rule(spark, sf).select(*INSIGHT)
        out = df if out is None else out.unionByName(df)
    return written(out, "candidates")


CANDIDATES = f", cand AS ({ROW}{EMERGING}) UNION ALL {ROW}{MOVEMENT}) UNION ALL {ROW}{ENTRIES}) UNION ALL {ROW}{SURGES}) UNION ALL {ROW}{OPENINGS}))"


# What is made of each kind of insight.
READINGS = {
    "emerging_trend": ("Activity in this topic is rising consistently enough, across enough independent sources, to be treated as a genuine trend rather than noise.", "Have a subject-matter expert confirm this topic warrants closer monitoring or further investment review."),
    "competitor_movement": ("Research output relative to the other monitored competitors has changed since the last scoring run.", "Review what changed in patent, trial or publication activity over the period."),
    "new_market_entry": ("A first move into the topic, or a return after an extended quiet period.", "Assess whether the topic is a strategic priority and what the entry means for it."),
    "patent_surge": ("A sharp rise in patent filings often precedes public announcements by months, since filings happen before disclosure.", "Review the recent patent filings for the technology or claim areas involved."),
    "opportunity": ("Growth and open competitive space are worth an expert's attention. This is a prioritization signal for review, not a recommendation.", "Have a subject-matter expert assess whether the topic merits further investigation."),
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(SCORES + CANDIDATES + " SELECT dedupe_key, title, observed_fact, CASE insight_type " + " ".join(f"WHEN '{k}' THEN {_quoted(a)}" for k, (a, _) in READINGS.items()) + " END AS interpretation, CASE insight_type " + " ".join(f"WHEN '{k}' THEN {_quoted(b)}" for k, (_, b) in READINGS.items()) + " END AS recommended_review FROM cand")
def insight_text(spark, sf):
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in READINGS.items() for x in (k, v[i])]), F.col("insight_type"))
    return candidates(spark, sf).select("dedupe_key", "title", "observed_fact", of(0).alias("interpretation"), of(1).alias("recommended_review"))


def evidence(spark, sf):
    """entity_type, entity_id, record_id: the newest records of every topic and organization, EVIDENCE of each."""
    r = records(spark, sf).select("id", "published_at")
    ids = topic_ids(spark, sf)
    t = record_topics(spark, sf).select("record_id", "topic").distinct().join(F.broadcast(ids), "topic").select("record_id", F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"))
    o = record_orgs(spark, sf).select("record_id", F.lit("competitor").alias("entity_type"), F.col("org_id").cast("long").alias("entity_id")).distinct()
    j = r.join(t.unionByName(o), F.col("id") == F.col("record_id"))
    rn = F.row_number().over(W.partitionBy("entity_type", "entity_id").orderBy(F.desc("published_at"), "id"))
    return j.withColumn("rn", rn).where(F.col("rn") <= EVIDENCE).select("entity_type", "entity_id", "record_id")


EVIDENCE_SQL = """, ev0 AS (SELECT DISTINCT 'topic' AS entity_type, topic_id AS entity_id, id AS record_id, published_at FROM records JOIN record_topics ON id = record_id JOIN tid USING (topic) UNION ALL SELECT DISTINCT 'competitor', CAST(org_id AS BIGINT), id, published_at FROM records JOIN record_orgs ON id = record_id),
ev AS (SELECT entity_type, entity_id, record_id FROM ev0 QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY published_at DESC, record_id) <= 8)"""
#: A run that stopped half-way has stored the insights about entities with even ids.
SEEN = "entity_id % 2 = 0 AND insight_type <> 'new_market_entry'"


def insights(spark, sf):
    """What a run stores: one insight for each key, those seen before and those without evidence go."""
    c = candidates(spark, sf)
    seen = c.where(SEEN).select("dedupe_key").distinct()
    new = c.join(seen, "dedupe_key", "left_anti").dropDuplicates(["dedupe_key"])
    return new.join(evidence(spark, sf).select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_semi")


INSIGHTS = SCORES + CANDIDATES + EVIDENCE_SQL + f", ins AS (SELECT * FROM cand WHERE NOT ({SEEN}) AND (entity_type, entity_id) IN (SELECT (entity_type, entity_id) FROM ev) QUALIFY row_number() OVER (PARTITION BY dedupe_key) = 1)"


@query(INSIGHTS + " SELECT insight_type, entity, severity, dedupe_key FROM ins")
def insight_generate(spark, sf):
    return insights(spark, sf).select("insight_type", "entity", "severity", "dedupe_key")


@query(INSIGHTS + " SELECT dedupe_key, count(*) AS evidence_count FROM ins JOIN ev USING (entity_type, entity_id) GROUP BY ALL")
def agg_evidence_count(spark, sf):
    return insights(spark, sf).join(evidence(spark, sf), ["entity_type", "entity_id"]).groupBy("dedupe_key").agg(F.count("*").alias("evidence_count"))


@query(INSIGHTS + " SELECT dedupe_key, record_id, record_type, published_at FROM ins JOIN ev USING (entity_type, entity_id) JOIN records ON id = record_id")
def join_evidence(spark, sf):
    r = records(spark, sf).select(F.col("id").alias("record_id"), "record_type", "published_at")
    return insights(spark, sf).select("entity_type", "entity_id", "dedupe_key").join(evidence(spark, sf), ["entity_type", "entity_id"]).join(r, "record_id").select("dedupe_key", "record_id", "record_type", "published_at")


@query(INSIGHTS + " SELECT title, severity, round(confidence, 6) AS confidence FROM ins ORDER BY round(confidence, 6) DESC, dedupe_key LIMIT 10")
def topk_insights(spark, sf):
    i = insights(spark, sf).withColumn("confidence", F.round("confidence", 6))
    return i.orderBy(F.desc("confidence"), "dedupe_key").limit(10).select("title", "severity", "confidence")


# facts


@query(CUBE + """, long AS (SELECT record_type, org_id, topic, 'month' AS period_type, month AS period, records, weighted FROM cube UNION ALL SELECT record_type, org_id, topic, 'quarter', CAST(date_trunc('quarter', month) AS DATE), records, weighted FROM cube UNION ALL SELECT record_type, org_id, topic, 'year', CAST(date_trunc('year', month) AS DATE), records, weighted FROM cube)
SELECT period, period_type, org_id AS organization_id, topic, record_type AS source_type, CAST(sum(records) AS BIGINT) AS activity_count, round(sum(weighted), 4) AS weighted_activity, false AS is_synthetic FROM long GROUP BY ALL""")
def fact_activity(spark, sf):
    from pulsegrid.operators.activity import roll_up

    a = roll_up(cube(spark, sf))
    return a.select("period", "period_type", F.col("org_id").alias("organization_id"), "topic", F.col("record_type").alias("source_type"), F.col("records").alias("activity_count"), F.round("weighted", 4).alias("weighted_activity"), F.lit(False).alias("is_synthetic"))


def entity_columns():
    return F.when(F.col("entity_type") == "competitor", F.col("entity_id")).alias("organization_id"), F.when(F.col("entity_type") == "topic", F.col("entity_id")).alias("topic_id")


ENTITY = "CASE WHEN entity_type = 'competitor' THEN entity_id END AS organization_id, CASE WHEN entity_type = 'topic' THEN entity_id END AS topic_id"


@query(SCORES + f"SELECT DISTINCT entity_type, entity_id, {ENTITY} FROM scores")
def prj_split_entity(spark, sf):
    return stored_scores(spark, sf).select("entity_type", "entity_id", *entity_columns()).distinct()


@query(SCORES + f"SELECT score_date, entity_type, {ENTITY}, score_type, round(score_value, 6) AS score_value, round(confidence, 6) AS confidence_score, {BAND} AS category, len(failed) = 0 AS is_qualified, sample_size FROM scores")
def fact_scores(spark, sf):
    return stored_scores(spark, sf).select("score_date", "entity_type", *entity_columns(), "score_type", r6("score_value"), r6("confidence", "confidence_score"), band(F.col("score_value")).alias("category"), (F.size("failed") == 0).alias("is_qualified"), "sample_size")


@query(SCORES + "SELECT score_date, score_type, entity, c.component AS component, round(c.raw_value, 4) AS raw_value, round(c.normalized_value, 4) AS normalized_value, c.weight AS weight, round(c.points, 4) AS points, c.is_available AS is_available FROM (SELECT *, unnest(components) AS c FROM scores)")
def fact_score_components(spark, sf):
    c = stored_scores(spark, sf).select("score_date", "score_type", "entity", F.explode("components").alias("c"))
    return c.select("score_date", "score_type", "entity", "c.component", F.round("c.raw_value", 4).alias("raw_value"), F.round("c.normalized_value", 4).alias("normalized_value"), "c.weight", F.round("c.points", 4).alias("points"), "c.is_available")


FORECAST = """, d AS (SELECT topic, ago, v, v - lag(v) OVER (PARTITION BY topic ORDER BY ago DESC) AS st FROM topic_series WHERE ago < 30),
n AS (SELECT topic, greatest(stddev_pop(st), sqrt(avg(v) FILTER (WHERE ago < 6))) AS noise, max(v) FILTER (WHERE ago = 0) AS p FROM d GROUP BY ALL),
fc AS (SELECT DATE '2001-07-01' AS forecast_date, CAST(DATE '2001-07-01' + to_months(CAST(step AS INTEGER)) AS DATE) AS target_period, topic, p AS predicted_value, round(greatest(p - 1.96 * noise * sqrt(step), 0), 6) AS lower_bound, round(p + 1.96 * noise * sqrt(step), 6) AS upper_bound, 'naive' AS model_name, CAST(30 AS BIGINT) AS training_months FROM n CROSS JOIN range(1, 7) s(step))
"""


@query(FORECAST + "SELECT * FROM fc")
def fact_forecasts(spark, sf):
    from pulsegrid.operators import forecast as P
    from pulsegrid.plans.activity import topic_series

    h = topic_series(spark, sf, 30)
    f = P.intervals(h, P.naive(h, ["topic"]), ["topic"])
    return f.select(day(DATES[0]).alias("forecast_date"), F.col("target").alias("target_period"), "topic", F.col("predicted").alias("predicted_value"), r6("lower", "lower_bound"), r6("upper", "upper_bound"), F.lit("naive").alias("model_name"), F.lit(30).cast("long").alias("training_months"))


@query(FORECAST + ", asked AS (SELECT min(topic) AS topic FROM topics) SELECT fc.* FROM fc JOIN asked USING (topic) WHERE forecast_date = (SELECT max(forecast_date) FROM fc)")
def q_forecast_for(spark, sf):
    """The latest forecast of one entity, the first by name."""
    f = fact_forecasts(spark, sf)
    asked = topic_ids(spark, sf).where("topic_id = 1").select("topic")
    last = f.agg(F.max("forecast_date").alias("last"))
    return f.join(F.broadcast(asked), "topic").join(F.broadcast(last), F.col("forecast_date") == F.col("last")).drop("last")


def _anomalies(spark, sf):
    from pulsegrid.operators import series as S
    from pulsegrid.plans.activity import topic_series
    from pulsegrid.plans.series import quiet_months

    a = S.anomalies(topic_series(spark, sf), ["topic"], quiet=quiet_months(spark, sf))
    return a.select("topic", "month", "v", r6("z"), r6("lower"), r6("upper"), "anomaly_class", r6("confidence"))


def _anomalies_sql() -> str:
    from pulsegrid.plans.series import ORACLES as SERIES

    return "WITH a1 AS (" + SERIES["win_anomalies"] + "), a2 AS (" + SERIES["win_anomaly_classify"] + "), a0 AS (SELECT a1.*, a2.anomaly_class FROM a1 JOIN a2 USING (topic, month)) "


@query(_anomalies_sql() + "SELECT month AS anomaly_date, 'topic' AS entity_type, topic AS entity, v AS observed_value, lower AS expected_lower, upper AS expected_upper, z AS deviation, anomaly_class, confidence FROM a0", "")
def fact_anomalies(spark, sf):
    return _anomalies(spark, sf).select(F.col("month").alias("anomaly_date"), F.lit("topic").alias("entity_type"), F.col("topic").alias("entity"), F.col("v").alias("observed_value"), F.col("lower").alias("expected_lower"), F.col("upper").alias("expected_upper"), F.col("z").alias("deviation"), "anomaly_class", "confidence")


@query(_anomalies_sql() + "SELECT topic, month, confidence FROM a0 ORDER BY month DESC, confidence DESC, topic LIMIT 5", "")
def topk_anomalies(spark, sf):
    return _anomalies(spark, sf).orderBy(F.desc("month"), F.desc("confidence"), "topic").limit(5).select("topic", "month", "confidence")


@query(INSIGHTS + f" SELECT i.insight_type, severity, {ENTITY.replace('entity_type', 'i.entity_type').replace('entity_id', 'i.entity_id')}, title, observed_fact, round(confidence, 6) AS confidence_score, 'new' AS status, (SELECT count(*) FROM ev WHERE ev.entity_type = i.entity_type AND ev.entity_id = i.entity_id) AS evidence_count FROM ins i")
def fact_insights(spark, sf):
    n = evidence(spark, sf).groupBy("entity_type", "entity_id").agg(F.count("*").alias("evidence_count"))
    return insights(spark, sf).join(n, ["entity_type", "entity_id"]).select("insight_type", "severity", *entity_columns(), "title", "observed_fact", r6("confidence", "confidence_score"), F.lit("new").alias("status"), "evidence_count")


@query(INSIGHTS + " SELECT dedupe_key, id AS source_record_id, record_type, CAST(published_at AS DATE) AS published_date, 'record ' || id AS title FROM ins JOIN ev USING (entity_type, entity_id) JOIN records ON id = record_id")
def fact_evidence(spark, sf):
    return join_evidence(spark, sf).select("dedupe_key", F.col("record_id").alias("source_record_id"), "record_type", F.col("published_at").cast("date").alias("published_date"), F.concat(F.lit("record "), "record_id").alias("title"))


RUNS = """runs AS (SELECT event_id AS run_id, event_type AS source_name, ts AS start_time, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS end_time, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CAST(props->>'$.k' AS BIGINT) AS received FROM events)"""


def runs(spark, sf):
    """Events as ingestion runs: the value is a run's seconds, k what it received."""
    e = read(spark, sf, "events")
    end = F.expr("ts + make_dt_interval(0, 0, 0, cast(round(value, 6) as decimal(18, 6)))")
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source_name"), F.col("ts").alias("start_time"), end.alias("end_time"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("received"))


@query("WITH " + RUNS + " SELECT run_id, source_name, start_time, end_time, round(epoch(end_time - start_time), 3) AS duration_seconds, status, received AS records_received, received // 10 AS duplicate_count FROM runs", "")
def fact_ingestion_runs(spark, sf):
    r = runs(spark, sf)
    seconds = F.round((F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6, 3)
    return r.select("run_id", "source_name", "start_time", "end_time", seconds.alias("duration_seconds"), "status", F.col("received").alias("records_received"), F.floor(F.col("received") / 10).alias("duplicate_count"))


def evaluations(spark, sf):
    """section, metrics: the evaluation's sections as nested JSON."""
    d, e = read(spark, sf, "documents"), read(spark, sf, "events")
    quality = d.agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("missing")).select(F.lit("data_quality").alias("section"), F.to_json(F.struct(F.struct("rows", "missing").alias("documents"), (F.col("missing") == 0).alias("ok"))).alias("metrics"))
    ingest = e.agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed")).select(F.lit("ingestion").alias("section"), F.to_json(F.struct("runs", "failed", F.array(F.lit("a"), F.lit("b")).alias("notes"))).alias("metrics"))
    return quality.unionByName(ingest)


EVAL = """WITH q AS (SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS missing FROM documents), i AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events),
ev AS (SELECT 'data_quality' AS section, 'documents.rows' AS metric_path, n::VARCHAR AS value FROM q UNION ALL SELECT 'data_quality', 'documents.missing', missing::VARCHAR FROM q UNION ALL SELECT 'data_quality', 'ok', CASE WHEN missing = 0 THEN 'true' ELSE 'false' END FROM q
  UNION ALL SELECT 'ingestion', 'runs', n::VARCHAR FROM i UNION ALL SELECT 'ingestion', 'failed', failed::VARCHAR FROM i UNION ALL SELECT 'ingestion', 'notes', 'a, b')"""


@query(EVAL + " SELECT section, metric_path, TRY_CAST(value AS DOUBLE) AS value_number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS value_text FROM ev", "")
def fact_evaluations(spark, sf):
    from pulsegrid.operators.nested import flatten

    f = flatten(evaluations(spark, sf), "metrics")
    number = F.expr("try_cast(value as double)")
    return f.select("section", F.col("path").alias("metric_path"), number.alias("value_number"), F.when(number.isNull(), F.col("value")).alias("value_text"))


@query(EVAL + " SELECT section, count(*) AS metrics, bool_and(value IS NOT NULL) AS ok FROM ev GROUP BY ALL", "")
def ev_report(spark, sf):
    """Every section of the evaluation with what it measured; a section stands on its own."""
    f = fact_evaluations(spark, sf)
    return f.groupBy("section").agg(F.count("*").alias("metrics"), F.every(F.col("value_number").isNotNull() | F.col("value_text").isNotNull()).alias("ok"))


@query(EVAL + " SELECT section, list({'k': metric_path, 'v': value} ORDER BY metric_path)[1].v AS first_value, count(*) AS metrics FROM ev WHERE section = 'ingestion' GROUP BY ALL", "")
def q_evaluation(spark, sf):
    """The newest stored result of one section."""
    from pulsegrid.operators.nested import flatten

    f = flatten(evaluations(spark, sf).where("section = 'ingestion'"), "metrics")
    return f.groupBy("section").agg(F.min_by("value", "path").alias("first_value"), F.count("*").alias("metrics"))


@query("SELECT record_type AS source_name, string_agg(DISTINCT status, '; ' ORDER BY status) AS record_types, count(*) AS records, CAST(min(published_at) AS DATE) AS first_published, CAST(max(published_at) AS DATE) AS last_published, false AS is_synthetic FROM records GROUP BY ALL UNION ALL SELECT DISTINCT event_type, '', 0, NULL, NULL, false FROM events".replace("SELECT record_type", " SELECT record_type", 1))
def dim_source(spark, sf):
    """Sources with their records; one that has run but yielded nothing still belongs in the list."""
    r = records(spark, sf).groupBy(F.col("record_type").alias("source_name")).agg(F.array_join(F.sort_array(F.collect_set("status")), "; ").alias("record_types"), F.count("*").alias("records"), F.min("published_at").cast("date").alias("first_published"), F.max("published_at").cast("date").alias("last_published"))
    ran = read(spark, sf, "events").select(F.col("event_type").alias("source_name")).distinct()
    return r.join(ran, "source_name", "full_outer").select("source_name", F.coalesce("record_types", F.lit("")).alias("record_types"), F.coalesce("records", F.lit(0)).alias("records"), "first_published", "last_published", F.lit(False).alias("is_synthetic"))


@query(
    SCORES
    + """, k AS (SELECT 'scores' AS fact, 'topic' AS dimension, entity_id NOT IN (SELECT topic_id FROM tid) AS orphan FROM scores WHERE entity_type = 'topic' UNION ALL SELECT 'scores', 'organization', entity_id NOT IN (SELECT n_nationkey FROM nation) FROM scores WHERE entity_type = 'competitor'
  UNION ALL SELECT 'scores', 'date', score_date NOT BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' FROM scores) SELECT fact, dimension, count(*) AS rows, CAST(count(*) FILTER (WHERE orphan) AS BIGINT) AS orphans FROM k GROUP BY ALL"""
)
def star_relationships(spark, sf):
    """Keys of the score facts that have no row in their dimension, by relationship."""
    s = stored_scores(spark, sf)
    ids = topic_ids(spark, sf).select(F.col("topic_id").alias("entity_id"), F.lit(True).alias("known"))
    orgs = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.lit(True).alias("known"))
    t = s.where("entity_type = 'topic'").join(F.broadcast(ids), "entity_id", "left").select(F.lit("topic").alias("dimension"), F.col("known").isNull().alias("orphan"))
    o = s.where("entity_type = 'competitor'").join(F.broadcast(orgs), "entity_id", "left").select(F.lit("organization").alias("dimension"), F.col("known").isNull().alias("orphan"))
    d = s.select(F.lit("date").alias("dimension"), (~F.col("score_date").between(day("1995-01-01"), day("2001-12-31"))).alias("orphan"))
    return t.unionByName(o).unionByName(d).groupBy(F.lit("scores").alias("fact"), "dimension").agg(F.count("*").alias("rows"), F.count_if("orphan").alias("orphans"))


GRAIN = "CASE WHEN org_id IS NULL AND topic IS NULL THEN 'overall' WHEN topic IS NULL THEN 'organization' WHEN org_id IS NULL THEN 'topic' ELSE 'both' END"


@query(CUBE + f"SELECT {GRAIN} AS grain, record_type, CAST(sum(records) AS BIGINT) AS records FROM cube GROUP BY ALL")
def dax_records_by_grain(spark, sf):
    """Sums of each of the four grains, which must never be added up."""
    grain = F.when(F.col("org_id").isNull() & F.col("topic").isNull(), "overall").when(F.col("topic").isNull(), "organization").when(F.col("org_id").isNull(), "topic").otherwise("both")
    return cube(spark, sf).groupBy(grain.alias("grain"), "record_type").agg(F.sum("records").alias("records"))


@query(SCORES + "SELECT score_type, entity, round(score_value, 6) AS score FROM scores WHERE score_date = (SELECT max(score_date) FROM scores)")
def dax_scores_latest(spark, sf):
    s = stored_scores(spark, sf)
    last = s.agg(F.max("score_date").alias("last"))
    return s.join(F.broadcast(last), F.col("score_date") == F.col("last")).select("score_type", "entity", r6("score_value", "score"))


# reads that a service offers


@query(SCORES + "SELECT entity_type, entity_id, entity FROM (SELECT 'topic' AS entity_type, topic_id AS entity_id, topic AS entity FROM tid UNION ALL SELECT 'competitor', CAST(n_nationkey AS BIGINT), n_name FROM nation)")
def q_names(spark, sf):
    t = topic_ids(spark, sf).select(F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"), F.col("topic").alias("entity"))
    return t.unionByName(read(spark, sf, "nation").select(F.lit("competitor").alias("entity_type"), F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("entity")))


ASKED = ("3", "nation_7", "NATION_1", "ion_2", "nowhere")


@query(
    f"""WITH asked(reference) AS (VALUES {', '.join(f"('{a}')" for a in ASKED)}), m AS (SELECT reference, n_nationkey AS id, CASE WHEN reference = n_nationkey::VARCHAR THEN 0 WHEN lower(reference) = lower(n_name) THEN 1 WHEN contains(lower(n_name), lower(reference)) THEN 2 END AS how FROM asked CROSS JOIN nation),
b AS (SELECT reference, min(how) AS how FROM m GROUP BY ALL) SELECT reference, CAST(count(m.id) AS BIGINT) AS matches, CASE WHEN count(m.id) = 1 THEN min(m.id) END AS id, CASE WHEN count(m.id) = 0 THEN 'unknown' WHEN count(m.id) > 1 THEN 'ambiguous' ELSE 'found' END AS answer FROM b LEFT JOIN m USING (reference, how) GROUP BY ALL""",
    "",
)
def q_resolve_entity(spark, sf):
    """A reference by id, else by exact name, else by a part of the name; several are ambiguous."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    asked = F.broadcast(spark.createDataFrame([(a,) for a in ASKED], "reference string"))
    low = F.lower("reference")
    how = F.when(F.col("reference") == F.col("id").cast("string"), 0).when(low == F.col("name"), 1).otherwise(2)
    hits = asked.join(n, (F.col("reference") == F.col("id").cast("string")) | F.contains(F.col("name"), low)).select("reference", "id", how.alias("how"))
    best = hits.groupBy("reference", "how").agg(F.count("*").alias("matches"), F.min("id").alias("id")).groupBy("reference").agg(F.min_by(F.struct("matches", "id"), "how").alias("m"))
    j = asked.join(best, "reference", "left")
    count = F.coalesce("m.matches", F.lit(0))
    return j.select("reference", count.alias("matches"), F.when(count == 1, F.col("m.id")).alias("id"), F.when(count == 0, "unknown").when(count > 1, "ambiguous").otherwise("found").alias("answer"))


@query(SCORES + "SELECT entity, list(score_type || '=' || CAST(round(score_value, 0) AS BIGINT) ORDER BY score_type) AS scores FROM scores WHERE score_date = DATE '2001-07-01' GROUP BY ALL")
def q_entity(spark, sf):
    """All current scores of every entity, in one row each."""
    s = stored_scores(spark, sf).where(F.col("score_date") == day(DATES[0]))
    return s.groupBy("entity").agg(F.array_sort(F.collect_list(F.concat("score_type", F.lit("="), whole(F.col("score_value"))))).alias("scores"))


@query(SCORES + "SELECT score_type, entity, rank() OVER (PARTITION BY score_type ORDER BY round(score_value, 6) DESC) AS rank, round(score_value, 6) AS score FROM scores WHERE score_date = DATE '2001-07-01' QUALIFY rank() OVER (PARTITION BY score_type ORDER BY round(score_value, 6) DESC) <= 10")
def q_ranking(spark, sf):
    """The ten best of every kind of score, ties included."""
    s = stored_scores(spark, sf).where(F.col("score_date") == day(DATES[0])).select("score_type", "entity", r6("score_value", "score"))
    return s.withColumn("rank", F.rank().over(W.partitionBy("score_type").orderBy(F.desc("score"))).cast("long")).where("rank <= 10")


@query(INSIGHTS + " SELECT i.title, i.observed_fact, list(record_id ORDER BY record_id) AS records FROM ins i JOIN ev USING (entity_type, entity_id) WHERE insight_type = 'opportunity' GROUP BY ALL")
def q_insight(spark, sf):
    """Insights of one kind with the ids of their evidence."""
    i = insights(spark, sf).where("insight_type = 'opportunity'")
    return i.join(evidence(spark, sf), ["entity_type", "entity_id"]).groupBy("title", "observed_fact").agg(F.array_sort(F.collect_list("record_id")).alias("records"))


WEIGHT_SETS = {"trend": TREND, "innovation": INNOVATION, "opportunity": {"trend": 0.60, "low_competition": 0.25, "agreement": 0.15}}


@query("WITH w(score_type, component, weight) AS (VALUES " + ", ".join(f"('{s}', '{c}', CAST({w} AS DOUBLE))" for s, ws in WEIGHT_SETS.items() for c, w in ws.items()) + "), l AS (SELECT count(*) AS n FROM documents) SELECT score_type, component, weight, n AS texts FROM w CROSS JOIN l", "")
def q_methodology(spark, sf):
    """How scores are made: the weights of every score, and how many texts stand behind."""
    w = spark.createDataFrame([(s, c, float(x)) for s, ws in WEIGHT_SETS.items() for c, x in ws.items()], "score_type string, component string, weight double")
    return F.broadcast(w).crossJoin(read(spark, sf, "documents").agg(F.count("*").alias("texts")))


#: Read-only questions: name, the table each reads, and its largest answer.
TOOLS = (("overview", "orders", 1), ("trends", "part", 50), ("opportunities", "part", 50), ("competitors", "supplier", 50), ("entity", "nation", 1), ("ranking", "part", 50), ("evidence", "orders", 50), ("insights", "documents", 50), ("insight", "documents", 1), ("anomalies", "events", 50), ("evaluation", "events", 1), ("review_queue", "customer", 50), ("methodology", "documents", 50))


@query("WITH t(name, reads, most) AS (VALUES " + ", ".join(f"('{n}', '{t}', {m})" for n, t, m in TOOLS) + "), c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS reads, count(*) AS n FROM {t}" for t in sorted({t for _, t, _ in TOOLS})) + ") SELECT name, reads, CAST(least(n, most) AS BIGINT) AS answers FROM t JOIN c USING (reads)", "")
def q_tools(spark, sf):
    """The questions on offer, and how many answers each has now."""
    t = spark.createDataFrame(list(TOOLS), "name string, reads string, most long")
    counts = None
    for name in sorted({x for _, x, _ in TOOLS}):
        c = read(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("reads"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return counts.join(F.broadcast(t), "reads").select("name", "reads", F.least("n", "most").alias("answers"))


@query("SELECT source, CASE WHEN s > 0 AND l > 0 THEN 'mixed' WHEN s > 0 THEN 'synthetic' WHEN l > 0 THEN 'live' ELSE 'none' END AS origin FROM (SELECT source, count(*) FILTER (WHERE doc_id % 2 = 0 AND n_chars > 100) AS s, count(*) FILTER (WHERE doc_id % 3 = 0 AND lang IS NOT NULL) AS l FROM documents GROUP BY ALL)", "")
def q_origin_label(spark, sf):
    d = read(spark, sf, "documents").groupBy("source").agg(F.count_if((F.col("doc_id") % 2 == 0) & (F.col("n_chars") > 100)).alias("s"), F.count_if((F.col("doc_id") % 3 == 0) & F.col("lang").isNotNull()).alias("l"))
    return d.select("source", F.when((F.col("s") > 0) & (F.col("l") > 0), "mixed").when(F.col("s") > 0, "synthetic").when(F.col("l") > 0, "live").otherwise("none").alias("origin"))


@query("SELECT event_id AS item, ts AS created_at, event_type AS queue_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 20", "")
def q_review_items(spark, sf):
    """The newest pending items."""
    return read(spark, sf, "events").where("event_type <> 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select(F.col("event_id").alias("item"), F.col("ts").alias("created_at"), F.col("event_type").alias("queue_type"))


@query("SELECT asked, CASE WHEN asked IS NULL OR asked < 1 THEN 10 ELSE least(asked, 50) END AS lim FROM (SELECT DISTINCT p_size - 5 AS asked FROM part UNION SELECT DISTINCT p_size * 3 FROM part)", "")
def limit_clamp(spark, sf):
    """A limit that is asked for: ten if absent or not positive, fifty at most."""
    p = read(spark, sf, "part")
    a = p.select((F.col("p_size") - 5).alias("asked")).union(p.select(F.col("p_size") * 3)).distinct()
    return a.select("asked", F.when(F.col("asked").isNull() | (F.col("asked") < 1), 10).otherwise(F.least("asked", F.lit(50))).alias("lim"))


@query(SCORES + "SELECT tool, entity, score FROM (SELECT CASE score_type WHEN 'trend' THEN 'trends' WHEN 'opportunity' THEN 'opportunities' ELSE 'competitors' END AS tool, entity, round(score_value, 6) AS score, row_number() OVER (PARTITION BY score_type ORDER BY round(score_value, 6) DESC, entity) AS rn FROM scores WHERE score_date = DATE '2001-07-01' AND confidence >= 20) WHERE rn <= 10")
def q_tool_lists(spark, sf):
    s = stored_scores(spark, sf).where((F.col("score_date") == day(DATES[0])) & (F.col("confidence") >= 20)).withColumn("score", F.round("score_value", 6))
    tool = F.when(F.col("score_type") == "trend", "trends").when(F.col("score_type") == "opportunity", "opportunities").otherwise("competitors")
    return s.withColumn("rn", F.row_number().over(W.partitionBy("score_type").orderBy(F.desc("score"), "entity"))).where("rn <= 10").select(tool.alias("tool"), "entity", "score")


@query("SELECT doc_id, string_agg(t, ' ' ORDER BY turn) AS text FROM (SELECT conv_id AS doc_id, turn, role || ':' || length(text) AS t FROM conversations) GROUP BY ALL", "")
def ai_reference_texts(spark, sf):
    """Reference texts of one row each: the parts joined by spaces, in order."""
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t")).alias("x"))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("text"))


@query("WITH c AS (SELECT doc_id, sha256('m1' || chr(0) || text) AS key FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT key FROM c WHERE doc_id % 3 = 0) SELECT count(*) FILTER (WHERE key IN (SELECT key FROM k)) AS hits, count(DISTINCT key) FILTER (WHERE key NOT IN (SELECT key FROM k)) AS to_make FROM c", "")
def ai_cache_ops(spark, sf):
    """What a cache of vectors by model and text has, and what is still to be made, each text once."""
    c = read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.concat(F.lit("m1\0"), "text"), 256).alias("key"))
    known = c.where("doc_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    j = c.join(known, "key", "left")
    return j.agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("key"))).alias("to_make"))


def _plan(mode: str, include: list[str], exclude: list[str], top: int):
    """(names kept, automatic slots): exclusions win; MANUAL has no automatic slots, HYBRID fills up, AUTO ignores the names."""
    out = {n.strip().lower() for n in exclude}
    kept = [n for n in include if n.strip().lower() not in out]
    if mode == "MANUAL":
        if not kept:
            raise ValueError("MANUAL needs a name that is not excluded")
        return kept, 0
    return (kept, max(0, top - len(kept))) if mode == "HYBRID" else ([], top)


INCLUDE, EXCLUDE, TOP = ["organization 3", "Organization 5", "organization 7"], ["organization 5", "organization 1"], 8


@query(
    SCORES
    + """, i AS (SELECT entity, score_value, row_number() OVER (ORDER BY score_value DESC, entity) AS rn FROM inn WHERE score_date = DATE '2001-07-01'), m(mode) AS (VALUES ('AUTO'), ('MANUAL'), ('HYBRID')),
p AS (SELECT mode, entity, CASE WHEN mode <> 'AUTO' AND entity IN ('organization 3', 'organization 7') THEN 0 ELSE 1 END AS auto, score_value FROM i CROSS JOIN m WHERE entity NOT IN ('organization 5', 'organization 1')),
r AS (SELECT mode, entity, auto, row_number() OVER (PARTITION BY mode, auto ORDER BY score_value DESC, entity) AS rn FROM p)
SELECT mode, entity, auto = 0 AS named FROM r WHERE auto = 0 OR rn <= CASE mode WHEN 'AUTO' THEN 8 WHEN 'HYBRID' THEN 6 ELSE 0 END"""
)
def score_mode_plan(spark, sf):
    """Who is monitored in each mode: named organizations first, then the best by score in the free slots."""
    i = innovation_scores(spark, sf).where(F.col("score_date") == day(DATES[0])).select("entity", "score_value").where(~F.col("entity").isin(*[x.lower() for x in EXCLUDE]))
    out = None
    for mode in ("AUTO", "MANUAL", "HYBRID"):
        kept, slots = _plan(mode, INCLUDE, EXCLUDE, TOP)
        named = F.col("entity").isin(*[k.lower() for k in kept]) if kept else F.lit(False)
        auto = i.where(~named).orderBy(F.desc("score_value"), "entity").limit(slots)
        rows = i.where(named).select(F.lit(mode).alias("mode"), "entity", F.lit(True).alias("named")).unionByName(auto.select(F.lit(mode).alias("mode"), "entity", F.lit(False).alias("named")))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """WITH g AS (SELECT o_orderpriority AS name, o_orderstatus AS component, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT name, n * CASE WHEN name LIKE '2%' THEN 1.1 WHEN name LIKE '3%' AND component = 'P' THEN -1.0 ELSE 1.0 END / sum(n) OVER (PARTITION BY name) AS weight FROM g)
SELECT name, CASE WHEN min(weight) < 0 THEN 'negative weight' WHEN abs(sum(weight) - 1) > 0.000001 THEN 'weights do not add up to 1' ELSE 'ok' END AS verdict FROM w GROUP BY ALL""",
    "",
)
def score_weight_validation(spark, sf):
    """Weight sets that are not finite, negative, or do not add up to one."""
    n = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("component")).agg(F.count("*").alias("n"))
    odd = F.when(F.col("name").startswith("2"), 1.1).when(F.col("name").startswith("3") & (F.col("component") == "P"), -1.0).otherwise(1.0)
    w = n.withColumn("weight", F.col("n") * odd / F.sum("n").over(W.partitionBy("name")))
    g = w.groupBy("name").agg(F.min("weight").alias("least"), F.sum("weight").alias("all"), F.max(F.isnan("weight")).alias("odd"))
    return g.select("name", F.when(F.col("odd"), "not finite").when(F.col("least") < 0, "negative weight").when(F.abs(F.col("all") - 1) > 1e-6, "weights do not add up to 1").otherwise("ok").alias("verdict"))


@query("SELECT name, len(string_split(name, ' ')) AS words FROM (SELECT DISTINCT p_type AS name FROM part) WHERE name IS NOT NULL", "")
def topic_sync(spark, sf):
    """Topics of the taxonomy with the words of their names."""
    t = read(spark, sf, "part").select(F.col("p_type").alias("name")).distinct().where("name is not null")
    return t.select("name", F.size(X.listed(F.regexp_replace("name", " ", ","))).cast("long").alias("words"))

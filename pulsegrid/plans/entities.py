"""Entity links, topic terms, duplicate records, insights, area threat and robustness."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.operators import cohort as C
from pulsegrid.plans.activity import r6
from pulsegrid.plans.scalars import PAPERS, papers
from pulsegrid.plans.series import FEATURES, topic_features
from pulsegrid.sources.tables import PRELUDE, read, record_orgs, record_topics, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


# duplicates: the lowest id of each key is canonical, within a record type


def _canonical(spark, sf):
    """id, source, record_type, position, kind, canonical, c_source of every key that an earlier record has; one aggregate by key, so a common key is no hot window."""
    k = papers(spark, sf).select("id", "source", "record_type", F.posexplode(X.duplicate_keys(F.col("doi"), F.col("pmid"), F.col("year"), F.col("title"))).alias("position", "k")).select("id", "source", "record_type", "k.kind", "k.key")
    first = k.groupBy("record_type", "kind", "key").agg(F.min(F.struct("id", "source")).alias("c")).select("record_type", "kind", "key", F.col("c.id").alias("canonical"), F.col("c.source").alias("c_source"))
    return k.join(first, ["record_type", "kind", "key"]).where("id <> canonical")


CANONICAL = f"""WITH {PAPERS}, c AS (SELECT *, min(id) OVER (PARTITION BY record_type, kind, key) AS canonical, arg_min(source, id) OVER (PARTITION BY record_type, kind, key) AS c_source FROM keys),
found AS (SELECT id, kind, position, canonical FROM c WHERE id <> canonical AND (kind <> 'title' OR source <> c_source))
"""
ORDER = {"doi": 0, "pmid": 1, "title": 2}


@query(CANONICAL + "SELECT id, arg_min(canonical, position) AS canonical, arg_min(kind, position) AS reason FROM found GROUP BY id")
def dedupe_find(spark, sf):
    """Records with an identifier of an earlier one of their type, the first that tells: doi, pmid, or year and title across sources."""
    found = _canonical(spark, sf).where("kind <> 'title' or source <> c_source")
    at = F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("kind"))
    return found.groupBy("id").agg(F.min_by(F.struct("canonical", "kind"), at).alias("m")).select("id", "m.canonical", F.col("m.kind").alias("reason"))


@query(CANONICAL + "SELECT id, canonical FROM found WHERE kind = 'title'")
def dedupe_across_sources(spark, sf):
    return _canonical(spark, sf).where("kind = 'title' and source <> c_source").select("id", "canonical")


# topics by terms in the fields of a page: whole words, any separator, plural allowed


TERMS = [("articles", ("the", "les", "der")), ("conjunctions", ("and", "und", "et")), ("negations", ("not at", "nicht", "pas")), ("units", ("thing", "tion on", "unter"))]
#: What a match in a field is worth; each further term adds a little, up to a limit, and less than the least is no match (fixed values).
FIELDS, MORE, MOST, LEAST = {"title": 0.9, "lead": 0.7, "body": 0.55}, 0.05, 0.95, 0.5


def _pattern(term: str) -> str:
    """The term as whole words, whatever stands between them, with a plural s."""
    return r"(^|[^a-z0-9_-])" + r"[\s_-]*".join(term.split()) + r"s?([^a-z0-9_-]|$)"


PAGE_FIELDS = "SELECT page_id, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, lower(regexp_replace(regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1), '<[^>]*>', ' ', 'g')) AS lead, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body FROM pages"


@query(
    f"WITH p AS ({PAGE_FIELDS}), t AS ("
    + " UNION ALL ".join(f"SELECT page_id, '{n}' AS topic, " + ", ".join(" + ".join(f"CASE WHEN regexp_matches({f}, '{_pattern(t)}') THEN 1 ELSE 0 END" for t in ts) + f" AS n_{f}" for f in FIELDS) + ", " + " + ".join("CASE WHEN " + " OR ".join(f"regexp_matches({f}, '{_pattern(t)}')" for f in FIELDS) + " THEN 1 ELSE 0 END" for t in ts) + " AS terms FROM p" for n, ts in TERMS)
    + f") SELECT page_id, topic, round(least(CASE {' '.join(f'WHEN n_{f} > 0 THEN CAST({w} AS DOUBLE)' for f, w in FIELDS.items())} END + {MORE} * (terms - 1), {MOST}), 6) AS confidence, CAST(terms AS INTEGER) AS terms FROM t WHERE terms > 0"
)
def topic_match(spark, sf):
    """All topics in one pass over the pages: the best field that has a term, and how many terms any field has; no join with a table of terms."""
    html = F.col("html")
    plain = lambda c: F.lower(F.regexp_replace(c, "<[^>]*>", " "))
    p = read(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).alias("title"), plain(F.regexp_extract(html, "(?s)<p[^>]*>(.*?)</p>", 1)).alias("lead"), plain(html).alias("body"))
    found = []
    for name, terms in TERMS:
        hit = {f: [F.col(f).rlike(_pattern(t)) for t in terms] for f in FIELDS}
        count = sum((F.when(F.greatest(*[hit[f][i] for f in FIELDS]), 1).otherwise(0) for i in range(len(terms))), F.lit(0))
        best = F.coalesce(*[F.when(F.greatest(*hit[f]), F.lit(w)) for f, w in FIELDS.items()])
        found.append(F.struct(F.lit(name).alias("topic"), count.alias("terms"), best.alias("best")))
    d = p.select("page_id", F.explode(F.array(*found)).alias("x")).where("x.terms > 0")
    sure = F.least(F.col("x.best") + MORE * (F.col("x.terms") - 1), F.lit(MOST))
    return d.select("page_id", "x.topic", r6(sure, "confidence"), F.col("x.terms").alias("terms")).where(F.col("confidence") >= LEAST)


# organizations


@query(
    """, m AS (SELECT DISTINCT r.id AS record_id, r.record_type, c_name AS customer, s_name AS supplier FROM records r JOIN orders ON o_orderkey = r.id JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = r.id LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT DISTINCT record_id, customer AS name, CASE record_type WHEN 'clinical_trial' THEN 'sponsor' WHEN 'funding' THEN 'recipient' WHEN 'announcement' THEN 'announcer' END AS relationship FROM m WHERE record_type IN ('clinical_trial', 'funding', 'announcement')
UNION ALL SELECT DISTINCT record_id, supplier, CASE record_type WHEN 'clinical_trial' THEN 'collaborator' WHEN 'patent' THEN 'assignee' WHEN 'announcement' THEN 'partner' END FROM m WHERE supplier IS NOT NULL AND record_type IN ('clinical_trial', 'patent', 'announcement')""",
    prelude=True,
)
def er_mentions(spark, sf):
    """Names of each record by role: who leads it first, then who takes part; publications name nobody."""
    r = records(spark, sf).select(F.col("id").alias("record_id"), "record_type").where(F.col("record_type") != "publication")
    o, c, line, s = (read(spark, sf, t) for t in ("orders", "customer", "lineitem", "supplier"))
    role = lambda i: F.coalesce(*[F.when(F.col("record_type") == k, F.lit(v[i])) for k, v in (("clinical_trial", ("sponsor", "collaborator")), ("patent", (None, "assignee")), ("funding", ("recipient", None)), ("announcement", ("announcer", "partner")))])
    leads = r.join(o, F.col("o_orderkey") == F.col("record_id")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("record_id", F.col("c_name").alias("name"), role(0).alias("relationship"))
    parts = r.join(line, F.col("l_orderkey") == F.col("record_id")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("record_id", F.col("s_name").alias("name"), role(1).alias("relationship")).distinct()
    return leads.unionByName(parts).where("relationship is not null")


LINK = {"A": 0.95, "N": 0.9, "R": 0.7}


@query("SELECT record_id, org_id, relationship, round(confidence * CASE relationship WHEN 'A' THEN 0.95 WHEN 'N' THEN 0.9 ELSE 0.7 END, 6) AS confidence FROM record_orgs", prelude=True)
def er_link_confidence(spark, sf):
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in LINK.items() for x in kv]), F.col("relationship"))
    return record_orgs(spark, sf).select("record_id", "org_id", "relationship", r6(F.col("confidence") * weight, "confidence"))


# area threat and modifiers






@query(
    """, m AS (SELECT org_id, count(DISTINCT id) FILTER (WHERE record_type = 'patent' AND month > DATE '2001-04-01') AS patents, count(DISTINCT record_type) AS sources, count(DISTINCT id) FILTER (WHERE status = 'P') AS phases FROM records JOIN record_orgs ON id = record_id GROUP BY ALL)
SELECT org_id, least(5.0 * least(patents, 2) / 2, 5) AS patent_part, CASE WHEN sources >= 3 THEN 5.0 ELSE 0.0 END AS source_part, CASE WHEN phases > 0 THEN 5.0 ELSE 0.0 END AS phase_part, least(least(5.0 * least(patents, 2) / 2, 5) + CASE WHEN sources >= 3 THEN 5.0 ELSE 0.0 END + CASE WHEN phases > 0 THEN 5.0 ELSE 0.0 END, 15.0) AS total FROM m""".replace("least(5.0 * least(patents, 2) / 2, 5)", "CAST(least(5.0 * least(patents, 2) / 2, 5) AS DOUBLE)").replace("THEN 5.0 ELSE 0.0 END", "THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END").replace(", 15.0)", ", CAST(15 AS DOUBLE))"),
    prelude=True,
)
def score_threat_modifiers(spark, sf):
    """Capped additions: each at most 5, all at most 15."""
    r, o = records(spark, sf), record_orgs(spark, sf)
    j = r.join(o, r["id"] == o["record_id"])
    recent = (F.col("record_type") == "patent") & (F.col("month") > F.lit("2001-04-01").cast("date"))
    m = j.groupBy("org_id").agg(F.count_distinct(F.when(recent, F.col("id"))).alias("patents"), F.count_distinct("record_type").alias("sources"), F.count_distinct(F.when(F.col("status") == "P", F.col("id"))).alias("phases"))
    parts = m.select("org_id", F.least(5.0 * F.least("patents", F.lit(2)) / 2, F.lit(5.0)).alias("patent_part"), F.when(F.col("sources") >= 3, 5.0).otherwise(0.0).alias("source_part"), F.when(F.col("phases") > 0, 5.0).otherwise(0.0).alias("phase_part"))
    return parts.select("*", F.least(F.col("patent_part") + F.col("source_part") + F.col("phase_part"), F.lit(15.0)).alias("total"))


# insights






# robustness: the same scores under changed weights, in one plan


@query(
    FEATURES
    + """, w(k, a, b) AS (VALUES (0, 0.30, 0.25), (1, 0.20, 0.35), (2, 0.40, 0.15), (3, 0.25, 0.30)),
r AS (SELECT k, topic, row_number() OVER (PARTITION BY k ORDER BY round(a * p_velocity + b * p_momentum + 0.20 * p_patent_growth + 0.15 * p_funding_growth + 0.10 * p_consistency, 9) DESC, topic) AS pos FROM p CROSS JOIN w)
SELECT x.k AS weights, CAST(sum(abs(x.pos - y.pos)) AS BIGINT) AS moved, CAST(count(*) FILTER (WHERE x.pos <= 3 AND y.pos <= 3) AS BIGINT) AS kept_top3 FROM r x JOIN r y ON y.k = 0 AND y.topic = x.topic WHERE x.k > 0 GROUP BY ALL""",
    prelude=True,
)
def ev_robust_weights(spark, sf):
    w = spark.createDataFrame([(0, 0.30, 0.25), (1, 0.20, 0.35), (2, 0.40, 0.15), (3, 0.25, 0.30)], "k int, a double, b double")
    f = topic_features(spark, sf).crossJoin(F.broadcast(w))
    s = F.col("a") * F.col("p_velocity") + F.col("b") * F.col("p_momentum") + 0.20 * F.col("p_patent_growth") + 0.15 * F.col("p_funding_growth") + 0.10 * F.col("p_consistency")
    r = f.select("k", "topic", F.row_number().over(W.partitionBy("k").orderBy(F.desc(F.round(s, 9)), "topic")).alias("pos"))
    y = r.where("k = 0").select("topic", F.col("pos").alias("base"))
    g = r.where("k > 0").join(y, "topic").groupBy(F.col("k").alias("weights"))
    return g.agg(F.sum(F.abs(F.col("pos") - F.col("base"))).alias("moved"), F.count_if((F.col("pos") <= 3) & (F.col("base") <= 3)).alias("kept_top3"))


"""Readers over recorded payloads, what sinks write, and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.plans.activity import r6
from pulsegrid.sources import feeds
from pulsegrid.sources.sinks import last_of, replaced, upsert
from pulsegrid.sources.tables import PRELUDE, read, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


# readers; payloads in the sources' shapes are made of the tables


def study_pages(spark, sf):
    """Registry pages of up to ten studies, as the service answers."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    j = o.where(F.col("o_orderpriority").startswith("1")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = F.struct
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    study = s(s(
        s(F.concat(F.lit("NCT"), "o_orderkey").alias("nctId"), F.concat(F.lit("A <b>trial</b> &amp; "), "o_orderkey").alias("briefTitle")).alias("identificationModule"),
        s(F.col("o_orderstatus").alias("overallStatus"), s(day.alias("date")).alias("lastUpdatePostDateStruct")).alias("statusModule"),
        s(s(F.col("c_name").alias("name")).alias("leadSponsor"), F.array(s(F.col("c_mktsegment").alias("name"))).alias("collaborators")).alias("sponsorCollaboratorsModule"),
        s(F.array(F.lit("PHASE1"), F.concat(F.lit("PHASE"), (F.col("o_custkey") % 3 + 1).cast("string"))).alias("phases"), s(F.floor("o_totalprice").cast("int").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        s(F.array(s(F.lit("Spain").alias("country")), s(F.lit("France").alias("country")), s(F.lit("Spain").alias("country"))).alias("locations")).alias("contactsLocationsModule"),
    ).alias("protocolSection"))
    return j.groupBy(F.floor(F.col("o_orderkey") / 10).alias("n")).agg(F.collect_list(study).alias("studies")).select(F.to_json(s("studies", F.concat(F.lit("t"), F.col("n")).alias("nextPageToken"))).alias("page"))


@query("SELECT 'NCT' || o_orderkey AS source_record_id, 'A trial & ' || o_orderkey AS title, CAST(o_orderdate AS DATE) AS published_at, c_name AS sponsor, 'PHASE1/PHASE' || (o_custkey % 3 + 1) AS phase, o_orderstatus AS status, CAST(floor(o_totalprice) AS INTEGER) AS enrollment, 'France,Spain' AS countries FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
def src_clinical_trials(spark, sf):
    t = feeds.clinical_trials(study_pages(spark, sf), "1998-01-01", "2000-01-01")
    return t.select("source_record_id", "title", "published_at", "sponsor", "phase", "status", "enrollment", F.array_join("countries", ",").alias("countries"))


@query("SELECT n, CASE WHEN n % 4 IN (0, 1) THEN 'c' || (n + 1) END AS next FROM (SELECT p_partkey AS n FROM part)")
def src_adapter_base(spark, sf):
    """Where paging goes on: an empty page, or a cursor that does not move, ends it."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"resultList": {"result": ['), F.when(k % 4 == 2, "").otherwise('{"id": "1"}'), F.lit(']}, "nextCursorMark": "c'), F.when(k % 4 == 3, k).otherwise(k + 1), F.lit('"}'))
    p = read(spark, sf, "part").select(k.alias("n"), body.alias("page"), F.concat(F.lit("c"), k).alias("sent"))
    return feeds.next_cursor(p).select("n", "next")


@query("SELECT (CASE WHEN p_partkey % 3 = 0 THEN 'PPR' ELSE 'MED' END) || ':' || p_partkey AS source_record_id, p_name AS title, make_date(2000 + p_size % 20, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 1 END) AS published_at, CASE WHEN p_partkey % 5 = 0 THEN '10.' || p_partkey || '/ab' END AS doi, 'A B;C D' AS authors, p_partkey % 3 = 0 AS preprint FROM part")
def src_europe_pmc(spark, sf):
    s = F.struct
    k = F.col("p_partkey")
    result = s(k.cast("string").alias("id"), F.when(k % 3 == 0, " ppr ").otherwise("MED").alias("source"), F.when(k % 5 == 0, F.concat(F.lit("DOI:10."), k, F.lit("/AB."))).alias("doi"), F.concat(F.lit("<i>"), "p_name", F.lit("</i>")).alias("title"), F.lit("A B, C D.").alias("authorString"), (2000 + F.col("p_size") % 20).cast("string").alias("pubYear"), F.when(k % 2 == 0, F.concat((2000 + F.col("p_size") % 20).cast("string"), F.lit("-03-09"))).alias("firstPublicationDate"))
    pages = read(spark, sf, "part").groupBy(F.floor(k / 25).alias("n")).agg(F.collect_list(result).alias("result")).select(F.to_json(s(s("result").alias("resultList"))).alias("page"))
    return feeds.literature(pages).select("source_record_id", "title", "published_at", "doi", F.array_join("authors", ";").alias("authors"), F.startswith("source_record_id", F.lit("PPR")).alias("preprint"))


def article_pages(spark, sf):
    """Articles as XML; by their number with an electronic date, a numeric issue date, a MedlineDate, a year only, and a day of entry."""
    k = F.col("p_partkey")
    year = (2000 + F.col("p_size") % 20).cast("string")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{name}>"))
    issue = F.when(k % 4 == 0, tag("Year", year)).when(k % 4 == 1, F.concat(tag("Year", year), F.lit("<Month>Mar</Month><Day>7</Day>"))).when(k % 4 == 2, F.concat(tag("Year", year), F.lit("<Month>11</Month>"))).otherwise(tag("MedlineDate", year, " Jul-Aug"))
    online = F.when(k % 5 == 0, F.concat(F.lit("<ArticleDate DateType='Electronic'>"), tag("Year", year), F.lit("<Month>12</Month><Day>5</Day></ArticleDate>"))).otherwise("")
    entered = F.when(k % 3 != 0, F.concat(F.lit("<History><PubMedPubDate PubStatus='pubmed'><Year>1990</Year><Month>1</Month><Day>1</Day></PubMedPubDate><PubMedPubDate PubStatus='entrez'>"), tag("Year", year), F.lit("<Month>6</Month><Day>30</Day></PubMedPubDate></History>"))).otherwise("")
    ids = F.concat(F.lit("<ArticleIdList><ArticleId IdType='pubmed'>x</ArticleId><ArticleId IdType='doi'>10.1/"), k, F.lit("</ArticleId><ArticleId IdType='pmc'>PMC"), k, F.lit("</ArticleId></ArticleIdList>"))
    body = tag("Article", tag("ArticleTitle", F.col("p_name")), "<Abstract><AbstractText Label='AIM'>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><AuthorList><Author><LastName>Roe</LastName><ForeName>Jo</ForeName><AffiliationInfo><Affiliation>Lab</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>", tag("Journal", "<Title>J</Title>", tag("JournalIssue", tag("PubDate", issue))), online)
    cite = tag("MedlineCitation", tag("PMID", k), body, "<MeshHeadingList><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList>")
    return read(spark, sf, "part").select(k.alias("id"), tag("PubmedArticle", cite, tag("PubmedData", entered, ids)).alias("page"))


YEAR = "(2000 + p_size % 20)"
CHOSEN = f"CASE WHEN p_partkey % 5 = 0 THEN make_date({YEAR}, 12, 5) WHEN p_partkey % 4 = 1 THEN make_date({YEAR}, 3, 7) WHEN p_partkey % 4 = 2 THEN make_date({YEAR}, 11, 1) WHEN p_partkey % 4 = 3 THEN make_date({YEAR}, 7, 1) WHEN p_partkey % 3 <> 0 THEN make_date({YEAR}, 6, 30) ELSE make_date({YEAR}, 1, 1) END"


@query(f"SELECT p_partkey::VARCHAR AS source_record_id, p_name AS title, 'AIM: One. Two.' AS abstract, {CHOSEN} AS published_at, 'Jo Roe;Group' AS authors, 'Lab' AS affiliations, 'Mice' AS mesh_terms, '10.1/' || p_partkey AS doi, 'PMC' || p_partkey AS pmcid FROM part")
def src_pubmed(spark, sf):
    a = feeds.articles(article_pages(spark, sf))
    return a.select("source_record_id", "title", "abstract", "published_at", *[F.array_join(c, ";").alias(c) for c in ("authors", "affiliations", "mesh_terms")], "doi", "pmcid")


@query(f"SELECT p_partkey::VARCHAR AS source_record_id, {CHOSEN} AS published_at FROM part")
def src_pubmed_date_choice(spark, sf):
    return feeds.articles(article_pages(spark, sf)).select("source_record_id", "published_at")


@query("SELECT p_partkey::VARCHAR AS source_record_id, CASE p_partkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'day' ELSE 'month' END AS precision FROM part")
def src_pubmed_dates(spark, sf):
    return feeds.articles(article_pages(spark, sf)).select("source_record_id", "precision")


@query("SELECT 'page ' || page_id AS title, make_date(2024, 1 + CAST(page_id % 12 AS INTEGER), 15) AS published_at, url AS link, CASE WHEN page_id % 2 = 0 THEN 'rss' ELSE 'atom' END AS tags FROM pages WHERE page_id % 3 <> 2 AND page_id % 12 BETWEEN 2 AND 7 AND url NOT LIKE '% %'")
def src_rss(spark, sf):
    """RSS items and Atom entries in a window; undated ones are left out."""
    k = F.col("page_id")
    month = F.lpad((1 + k % 12).cast("string"), 2, "0")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    names = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")])
    rss = F.concat(F.lit("<item><title>page "), k, F.lit("</title><link>"), url, F.lit("</link><guid>g"), k, F.lit("</guid><category>rss</category>"), F.when(k % 3 != 2, F.concat(F.lit("<pubDate>Mon, 15 "), F.element_at(names, (1 + k % 12).cast("int")), F.lit(" 2024 10:00:00 GMT</pubDate>"))).otherwise(""), F.lit("</item>"))
    atom = F.concat(F.lit("<entry><title>page "), k, F.lit("</title><id>u"), k, F.lit("</id><link href='"), url, F.lit("'/><category term='atom'/>"), F.when(k % 3 != 2, F.concat(F.lit("<published>2024-"), month, F.lit("-15T10:00:00Z</published>"))).otherwise(""), F.lit("</entry>"))
    items = read(spark, sf, "pages").select(F.when(k % 2 == 0, rss).otherwise(atom).alias("page"), F.lit("f").alias("feed"))
    return feeds.feed(items, "2024-03-01", "2024-09-01").select("title", "published_at", "link", F.array_join("tags", ",").alias("tags"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<p[^>]*>.*?</p>')) AS paragraphs FROM pages")
def src_docs(spark, sf):
    """Documents as parts: how many paragraphs each page has."""
    return read(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?s)(<p[^>]*>.*?</p>)"), F.lit(1))).cast("long").alias("paragraphs"))


@query("SELECT DISTINCT event_type AS source, event_type IN ('click', 'view') AS known FROM events")
def src_registry_lookup(spark, sf):
    """Configured sources whose reader is known; here two kinds of events stand for sources with one."""
    known = F.col("event_type").isin("click", "view")
    return read(spark, sf, "events").select(F.col("event_type").alias("source"), known.alias("known")).distinct()


@query("SELECT p_type AS topic, x.k AS key, x.v AS value FROM (SELECT p_type, unnest([{'k': 'enabled', 'v': 'true'}, {'k': 'name', 'v': p_type}, {'k': 'weight', 'v': '2'}]) AS x FROM (SELECT DISTINCT p_type FROM part))")
def src_yaml_config(spark, sf):
    """Settings written as ``key: value`` lines, comments and blank lines left out."""
    doc = F.concat(F.lit("# settings\nname: "), "p_type", F.lit("\n\nweight: 2  # twice\nenabled: true\n"))
    t = read(spark, sf, "part").select(F.col("p_type").alias("topic"), F.explode(F.split(doc, "\n")).alias("line")).distinct()
    t = t.select("topic", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", "")).alias("line")).where("line <> ''")
    return t.select("topic", F.regexp_extract("line", r"^([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))


def demo(spark, seed: int, rows: int, start: str = "2024-01-01"):
    """Invented records: the same for the same seed, on any number of tasks."""
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt)), F.lit(1_000_000))
    kinds = F.array(*[F.lit(k) for k in ("clinical_trial", "publication", "patent", "funding", "announcement")])
    return spark.range(rows).select(
        "id", F.element_at(kinds, (1 + h("kind") % 5).cast("int")).alias("record_type"), F.date_add(F.lit(start).cast("date"), (h("day") % 365).cast("int")).alias("published_at"),
        F.concat(F.lit("organization "), h("org") % 25).alias("organization"), F.lit(True).alias("is_synthetic"),
    )


@query("")
def src_demo_generator(spark, sf):
    """As many invented records as there are documents; the hash is Spark's own, so there is no twin."""
    return demo(spark, 42, read(spark, sf, "documents").count())


@query("SELECT count(*) AS records, true AS is_synthetic FROM documents")
def src_demo_loader(spark, sf):
    """Invented records as they are loaded: each id once, all marked."""
    d = src_demo_generator(spark, sf)
    return last_of(d, ["id"], "published_at").agg(F.count("*").alias("records"), F.every("is_synthetic").alias("is_synthetic"))


@query("SELECT kind, n >= 0 AS made FROM (SELECT unnest(['announcement', 'clinical_trial', 'funding', 'patent', 'publication']) AS kind, 1 AS n)")
def demo_builders(spark, sf):
    """Every kind of record is among the invented ones."""
    d = src_demo_generator(spark, sf).groupBy(F.col("record_type").alias("kind")).agg(F.count("*").alias("n"))
    return d.select("kind", (F.col("n") >= 0).alias("made"))


# sinks, as what they would write


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN n_chars > 10000 THEN 'length' END], lambda p: p IS NOT NULL), ',') AS problems FROM documents")
def sink_validate_record(spark, sf):
    """What is wrong with each record: required fields, and lengths."""
    p = F.array(F.when(F.col("text").isNull() | (F.trim("text") == ""), "text"), F.when(F.col("lang").isNull(), "lang"), F.when(F.col("n_chars") > 10_000, "length"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.filter(p, lambda x: x.isNotNull()), ",").alias("problems"))


@query("SELECT source, count(*) FILTER (WHERE doc_id % 4 = 0) AS removed, count(*) FILTER (WHERE doc_id % 4 <> 0) AS kept FROM documents GROUP BY ALL")
def sink_reset_synthetic(spark, sf):
    """Invented rows go (every fourth stands for one): what goes and what stays, by source."""
    d = read(spark, sf, "documents").groupBy("source")
    return d.agg(F.count_if(F.col("doc_id") % 4 == 0).alias("removed"), F.count_if(F.col("doc_id") % 4 != 0).alias("kept"))


@query(
    """WITH s AS (SELECT l_orderkey AS id, l_linenumber AS part, l_quantity AS v FROM lineitem WHERE l_orderkey % 3 = 0), i AS (SELECT l_orderkey AS id, l_linenumber AS part, l_quantity + l_linenumber % 2 AS v FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.id IS NULL THEN 'insert' WHEN i.id IS NULL THEN 'keep' WHEN s.v <> i.v THEN 'update' ELSE 'unchanged' END AS action FROM s FULL JOIN (SELECT id, part, max(v) AS v FROM i GROUP BY ALL) i ON s.id = i.id AND s.part = i.part) GROUP BY ALL"""
)
def sink_upsert_detail(spark, sf):
    """Detail rows by record and part."""
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("v"))
    incoming = line.where("id % 2 = 0").withColumn("v", F.col("v") + F.col("part") % 2)
    return upsert(line.where("id % 3 = 0"), incoming, ["id", "part"], ["v"], "v").groupBy("action").agg(F.count("*").alias("n"))


def _runs(name: str):
    """A sink of rows by (date, topic): what a second run does to the first one's, leftovers of its dates included."""

    def run(spark, sf):
        from pulsegrid.plans.activity import topic_series

        s = topic_series(spark, sf, 6).select("month", "topic", "v")
        stored = s.where(F.month("month") % 2 == 0)
        stored = stored.unionByName(s.where(F.month("month") == 7).select("month", F.concat("topic", F.lit(" old")).alias("topic"), "v"))
        incoming = s.where(F.month("month") >= 6).withColumn("v", F.when(F.length("topic") % 2 == 0, F.col("v") + 1).otherwise(F.col("v")))
        return replaced(stored, incoming, ["month", "topic"], ["v"], ["month"])

    run.__name__ = name
    return run


SINK = """, s0 AS (SELECT month, topic, v FROM topic_series WHERE ago < 6), s AS (SELECT * FROM s0 WHERE month(month) % 2 = 0 UNION ALL SELECT month, topic || ' old', v FROM s0 WHERE month(month) = 7), i AS (SELECT month, topic, CASE WHEN length(topic) % 2 = 0 THEN v + 1 ELSE v END AS v FROM s0 WHERE month(month) >= 6)
SELECT coalesce(i.month, s.month) AS month, coalesce(i.topic, s.topic) AS topic, coalesce(i.v, s.v) AS v, CASE WHEN s.month IS NULL THEN 'insert' WHEN i.month IS NULL THEN CASE WHEN s.month IN (SELECT month FROM i) THEN 'delete' ELSE 'keep' END WHEN s.v <> i.v THEN 'update' ELSE 'unchanged' END AS action FROM s FULL JOIN i ON s.month = i.month AND s.topic = i.topic"""
for _name in ("sink_scores", "sink_features", "sink_activity", "sink_forecasts"):
    query(SINK, True)(_runs(_name))


@query(", a AS (SELECT topic, month, v FROM topic_series WHERE ago < 6), s AS (SELECT * FROM a WHERE month(month) < 5) SELECT topic, month, v, CASE WHEN month(month) < 5 THEN 'unchanged' ELSE 'insert' END AS action FROM a", True)
def sink_anomalies(spark, sf):
    """Findings are only ever added: a replay changes nothing, nothing is deleted."""
    from pulsegrid.plans.activity import topic_series

    a = topic_series(spark, sf, 6).select("topic", "month", "v")
    return upsert(a.where(F.month("month") < 5), a, ["topic", "month"], ["v"])


def star(spark, sf):
    """All tables of the star schema by name."""
    from pulsegrid.plans import relational as R
    from pulsegrid.plans import store as S

    tables = {n: getattr(R, n)(spark, sf) for n in ("dim_date", "dim_organization", "dim_topic")} | {"dim_source": S.dim_source(spark, sf)}
    return tables | {n: getattr(S, n)(spark, sf) for n in ("fact_activity", "fact_scores", "fact_score_components", "fact_forecasts", "fact_anomalies", "fact_insights", "fact_evidence", "fact_ingestion_runs", "fact_evaluations")}


@query("")
def sink_star_schema(spark, sf):
    """The thirteen tables with their columns; ``write_star_schema`` writes them, the list of them last."""
    rows = [(n, ",".join(df.columns)) for n, df in star(spark, sf).items()]
    return spark.createDataFrame(rows, "name string, columns string")


@query(", s AS (SELECT topic, sum(v) FILTER (WHERE ago < 3) AS score FROM topic_series GROUP BY ALL), e AS (SELECT topic, list(id ORDER BY id)[1:3] AS ids FROM (SELECT DISTINCT topic, id FROM records JOIN record_topics ON id = record_id WHERE month = DATE '2001-07-01') GROUP BY ALL) SELECT topic, score, array_to_string(ids, ' ') AS evidence, CAST(NULL AS VARCHAR) AS rating FROM s LEFT JOIN e USING (topic)", True)
def sink_expert_sheet(spark, sf):
    """Topics by score with ids of evidence and an empty column for the rating."""
    from pulsegrid.plans.activity import topic_series
    from pulsegrid.sources.tables import record_topics

    s = topic_series(spark, sf, 6).groupBy("topic").agg(F.sum(F.when(F.col("ago") < 3, F.col("v"))).alias("score"))
    r = records(spark, sf).where(F.col("month") == F.lit("2001-07-01").cast("date")).select("id")
    t = record_topics(spark, sf).select("record_id", "topic").distinct()
    first = r.join(t, F.col("id") == F.col("record_id")).withColumn("rn", F.row_number().over(W.partitionBy("topic").orderBy("id"))).where("rn <= 3")
    e = first.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("evidence"))
    return s.join(e, "topic", "left").select("topic", "score", "evidence", F.lit(None).cast("string").alias("rating"))


@query("SELECT source, count(*) AS lines FROM documents GROUP BY ALL")
def sink_jsonl_fixtures(spark, sf):
    """JSON lines of every source, read back."""
    d = read(spark, sf, "documents").select("source", F.to_json(F.struct("doc_id", "lang")).alias("line"))
    return d.where(F.from_json("line", "doc_id long")["doc_id"].isNotNull()).groupBy("source").agg(F.count("*").alias("lines"))


# the state of ingestion


OK = "event_type <> 'error'"


@query(f"SELECT user_id AS source, max(ts) FILTER (WHERE {OK}) AS watermark, coalesce(bool_and({OK}), true) AS complete, CASE WHEN count(*) FILTER (WHERE NOT ({OK})) >= 3 THEN max(ts) FILTER (WHERE NOT ({OK})) + INTERVAL 360 MINUTE END AS circuit_open_until FROM events GROUP BY ALL")
def st_checkpoint_state(spark, sf):
    ok = F.col("event_type") != "error"
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(F.max(F.when(ok, F.col("ts"))).alias("watermark"), F.every(ok).alias("complete"), F.when(F.count_if(~ok) >= 3, F.max(F.when(~ok, F.col("ts"))) + F.expr("interval 360 minutes")).alias("circuit_open_until"))


@query(f"WITH c0 AS (SELECT user_id AS source, max(ts) FILTER (WHERE {OK}) AS w FROM events GROUP BY ALL), c AS (SELECT source, CASE WHEN source % 10 = 0 THEN NULL ELSE w END AS watermark FROM c0), s AS (SELECT user_id AS source, min(ts) AS watermark FROM events WHERE user_id % 2 = 0 GROUP BY ALL) SELECT coalesce(c.source, s.source) AS source, coalesce(c.watermark, s.watermark) AS watermark FROM (SELECT * FROM c WHERE watermark IS NOT NULL) c FULL JOIN s USING (source)")
def st_save_checkpoint(spark, sf):
    """Checkpoints by source after a run; one without a valid watermark is not stored."""
    e = read(spark, sf, "events")
    done = F.max(F.when(F.col("event_type") != "error", F.col("ts")))
    new = e.groupBy(F.col("user_id").alias("source")).agg(F.when(F.first("user_id") % 10 != 0, done).alias("watermark")).where("watermark is not null")
    old = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("source")).agg(F.min("ts").alias("watermark"))
    return upsert(old, new, ["source"], ["watermark"]).select("source", "watermark")


@query("WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, bool_and(event_type <> 'error') AS done FROM events GROUP BY ALL), b AS (SELECT user_id, min(d) FILTER (WHERE NOT done) AS stop FROM s GROUP BY ALL) SELECT s.user_id AS source, max(d) FILTER (WHERE stop IS NULL OR d < stop) AS watermark FROM s JOIN b USING (user_id) GROUP BY ALL")
def st_watermark_advance(spark, sf):
    """The last day before the first one with a failure: a watermark moves over whole slices only."""
    s = read(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.every(F.col("event_type") != "error").alias("done"))
    stop = F.min(F.when(~F.col("done"), F.col("d"))).over(W.partitionBy("user_id"))
    return s.withColumn("stop", stop).groupBy(F.col("user_id").alias("source")).agg(F.max(F.when(F.col("stop").isNull() | (F.col("d") < F.col("stop")), F.col("d"))).alias("watermark"))


@query("SELECT source, CASE WHEN source % 11 = 0 THEN 'disabled' WHEN source % 7 = 0 THEN 'no reader' WHEN source % 5 = 0 THEN 'configuration' WHEN failed >= 3 THEN 'circuit open' WHEN last >= TIMESTAMP '2024-01-30' THEN 'not due' ELSE 'collect' END AS outcome FROM (SELECT user_id AS source, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS last FROM events GROUP BY ALL)")
def st_fetch_source(spark, sf):
    """Why a source is skipped, by the first reason that holds."""
    g = read(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("last"))
    k = F.col("source")
    late = F.col("last") >= F.lit("2024-01-30").cast("timestamp_ntz")
    return g.select("source", F.when(k % 11 == 0, "disabled").when(k % 7 == 0, "no reader").when(k % 5 == 0, "configuration").when(F.col("failed") >= 3, "circuit open").when(late, "not due").otherwise("collect").alias("outcome"))


@query("SELECT event_id, errors - page_errors AS record_errors, inserted + updated + skipped + duplicates + errors - page_errors AS received FROM (SELECT event_id, k % 5 + 1 AS errors, k % 2 AS page_errors, k AS inserted, k // 2 AS updated, k // 3 AS skipped, k // 10 AS duplicates FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events))")
def st_result_counters(spark, sf):
    """Errors of records are those not of pages; what came in is all that became of it."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf, "events").select("event_id", (k % 5 + 1 - k % 2).alias("record_errors"), (k + F.floor(k / 2) + F.floor(k / 3) + F.floor(k / 10)).alias("rest"))
    return e.select("event_id", "record_errors", (F.col("rest") + F.col("record_errors")).alias("received"))


@query("SELECT event_type AS job, event_id AS run, ts AS started, (SELECT max(ts) FROM events WHERE event_type <> 'error') AS last_success FROM events ORDER BY ts DESC, event_id LIMIT 25")
def st_job_history(spark, sf):
    """The newest runs, and the last success."""
    e = read(spark, sf, "events")
    last = e.where("event_type <> 'error'").agg(F.max("ts").alias("last_success"))
    return e.orderBy(F.desc("ts"), "event_id").limit(25).select(F.col("event_type").alias("job"), F.col("event_id").alias("run"), F.col("ts").alias("started")).crossJoin(F.broadcast(last))


#: Answers that are worth another try; seconds of the first wait and the longest one (fixed values).
AGAIN, FIRST_WAIT, LONGEST_WAIT = (408, 425, 429, 500, 502, 503, 504), 1.0, 60.0


@query(f"SELECT code, attempt, code IN {AGAIN} AS again, CASE WHEN code IN {AGAIN} THEN CASE WHEN code = 429 THEN 7.0 ELSE least(60.0, pow(2, attempt)) END END AS wait FROM (SELECT unnest([200, 404, 408, 425, 429, 500, 503]) AS code) CROSS JOIN (SELECT DISTINCT CAST(p_size % 8 AS BIGINT) AS attempt FROM part)")
def st_retry(spark, sf):
    """Whether an answer is tried again and after how many seconds: as the service asks, else doubling up to a minute (before jitter)."""
    codes = F.broadcast(spark.createDataFrame([(c, 7.0 if c == 429 else None) for c in (200, 404, 408, 425, 429, 500, 503)], "code int, asked double"))
    t = read(spark, sf, "part").select((F.col("p_size") % 8).cast("long").alias("attempt")).distinct()
    again = F.col("code").isin(*AGAIN)
    return t.crossJoin(codes).select("code", "attempt", again.alias("again"), F.when(again, F.coalesce("asked", F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2.0), "attempt")))).alias("wait"))


@query("WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS us FROM events), w AS (SELECT *, max(us - (n - 1) * 3600000000) OVER (PARTITION BY user_id ORDER BY n) AS base FROM e) SELECT event_id, CAST(base + (n - 1) * 3600000000 - us AS BIGINT) AS waited_us FROM w")
def st_rate_limit(spark, sf):
    """How long each request waits if a source is asked once an hour at most: a running maximum of when its turn is due, in one window."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    hour = 3_600_000_000
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.row_number().over(by).alias("n"))
    base = F.max(F.col("at") - (F.col("n") - 1) * hour).over(W.partitionBy("user_id").orderBy("n"))
    return e.select("event_id", (base + (F.col("n") - 1) * hour - F.col("at")).cast("long").alias("waited_us"))


@query("WITH r AS (SELECT user_id AS job, event_type = 'error' AS bad, ts, event_id, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), l AS (SELECT job, arg_max(g, (ts, event_id)) AS g, max(ts) AS last FROM r GROUP BY ALL), f AS (SELECT l.job, l.last, count(*) FILTER (WHERE r.bad) AS failures FROM l JOIN r ON r.job = l.job AND r.g = l.g GROUP BY ALL) SELECT job, failures, CASE WHEN failures = 0 THEN last + INTERVAL 1 DAY ELSE last + to_minutes(CAST(least(5 * pow(2, failures - 1), 1440) AS INTEGER)) END AS next_run FROM f")
def st_scheduler(spark, sf):
    """When a job runs next: a day after a success, five minutes and twice as long for each further failure after one, a day at most."""
    e = read(spark, sf, "events")
    last_ok = F.max(F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))).over(W.partitionBy("user_id"))
    after = (F.col("event_type") == "error") & (F.col("ok").isNull() | (F.struct("ts", "event_id") > F.col("ok")))
    g = e.withColumn("ok", last_ok).groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last"), F.count_if(after).alias("failures"))
    minutes = F.when(F.col("failures") == 0, F.lit(1440)).otherwise(F.least(5 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(20))), F.lit(1440.0))).cast("int")
    return g.select("job", "failures", F.col("last") + F.make_dt_interval(mins=minutes)).toDF("job", "failures", "next_run")


@query("SELECT user_id, event_type, min(event_id) AS first_id, count(*) - 1 AS repeats FROM events GROUP BY ALL")
def st_dedupe_in_run(spark, sf):
    """The first of what a run sees again and again, and how often it came back."""
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("repeats"))


@query(
    """SELECT source, CASE WHEN requested THEN 'full' WHEN watermark IS NULL THEN 'full' WHEN NOT complete THEN 'resume' WHEN full_mode THEN CASE WHEN last < TIMESTAMP '2024-01-25' THEN 'full' ELSE 'skip' END ELSE 'incremental' END AS mode,
  CASE WHEN requested OR watermark IS NULL THEN TIMESTAMP '2023-02-05' WHEN NOT complete THEN watermark WHEN full_mode THEN CASE WHEN last < TIMESTAMP '2024-01-25' THEN TIMESTAMP '2023-02-05' END ELSE watermark - INTERVAL 7 DAY END AS start FROM (
  SELECT user_id AS source, max(ts) FILTER (WHERE event_type <> 'error') AS watermark, max(ts) AS last, arg_max(event_type, (ts, event_id)) <> 'error' AS complete, user_id % 6 = 0 AS full_mode, user_id % 17 = 0 AS requested FROM events GROUP BY ALL)"""
)
def st_window_plan(spark, sf):
    """What to collect: all if asked for or never collected, the rest of an unfinished window, all again when that is due, else from a week before the watermark."""
    e = read(spark, sf, "events")
    done = F.max(F.when(F.col("event_type") != "error", F.col("ts")))
    g = e.groupBy(F.col("user_id").alias("source")).agg(done.alias("watermark"), F.max("ts").alias("last"), (F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("complete"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    full_mode, requested, due = F.col("source") % 6 == 0, F.col("source") % 17 == 0, F.col("last") < at("2024-01-25")
    mode = F.when(requested | F.col("watermark").isNull(), "full").when(~F.col("complete"), "resume").when(full_mode & due, "full").when(full_mode, "skip").otherwise("incremental")
    start = F.when(mode == "full", at("2023-02-05")).when(mode == "resume", F.col("watermark")).when(mode == "incremental", F.col("watermark") - F.expr("interval 7 days"))
    return g.select("source", mode.alias("mode"), start.alias("start"))


@query("SELECT name, kind, value, kind <> 'unknown' AS ok FROM (SELECT DISTINCT p_brand AS name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'weight' ELSE 'unknown' END AS kind, length(p_brand) AS value FROM part)")
def feat_settings(spark, sf):
    """Tunables by name; names that are not known are rejected."""
    kind = F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "weight").otherwise("unknown")
    s = read(spark, sf, "part").select(F.col("p_brand").alias("name"), kind.alias("kind"), F.length("p_brand").cast("long").alias("value")).distinct()
    return s.select("name", "kind", "value", (F.col("kind") != "unknown").alias("ok"))


@query("SELECT p_type AS source_type, count(*) AS parts, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM part GROUP BY ALL")
def disc_weights(spark, sf):
    """Weights that are not given: each kind's share."""
    g = read(spark, sf, "part").groupBy(F.col("p_type").alias("source_type")).agg(F.count("*").alias("parts"))
    total = g.agg(F.sum("parts").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("source_type", "parts", r6(F.col("parts") / F.col("all"), "weight"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents WHERE text IS NOT NULL AND n_chars < 200")
def topic_words(spark, sf):
    """Short texts as the words that terms are looked for in."""
    return read(spark, sf, "documents").where("text is not null and n_chars < 200").select("doc_id", X.letters_only(F.col("text")).alias("words"))

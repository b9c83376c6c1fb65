"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.plans.activity import r6, topic_source
from pulsegrid.operators import series as S
from pulsegrid.sources.sinks import number_cell, safe_cell
from pulsegrid.sources.tables import PRELUDE, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('year', o_orderdate) AS DATE) AS y FROM orders")
def fn_period_start(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return read(spark, sf, "orders").select(d.alias("d"), F.trunc(d, "MM").alias("m"), F.trunc(d, "QUARTER").alias("q"), F.trunc(d, "YEAR").alias("y")).distinct()


@query("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH AS DATE) AS later, CAST(date_trunc('month', o_orderdate) - INTERVAL 13 MONTH AS DATE) AS earlier FROM orders")
def fn_add_months(spark, sf):
    m = F.trunc("o_orderdate", "MM")
    return read(spark, sf, "orders").select(m.alias("m"), F.add_months(m, 5).alias("later"), F.add_months(m, -13).alias("earlier")).distinct()


@query("SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), TIMESTAMP '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS month")
def fn_month_range(spark, sf):
    lo = read(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate"), "MM").alias("lo"))
    return lo.select(F.explode(F.expr("sequence(lo, date'2001-07-01', interval 1 month)")).alias("month"))


#: Ways to write an order's date: the format in either engine, and what can be read back of it.
SHAPES = (
    ("yyyy-MM-dd", "%Y-%m-%d", "day"), ("yyyy/MM/dd", "%Y/%m/%d", "day"), ("yyyy", "%Y", "year"), ("yyyy MMM", "%Y %b", "month"), ("dd MMMM yyyy", "%d %B %Y", "day"), ("MMMM dd, yyyy", "%B %d, %Y", "day"),
    ("MMMM yyyy", "%B %Y", "month"), ("yyyy.MM", "%Y.%m", "month"), ("yyyy MMM'-Dec'", "%Y %b-Dec", "month"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "day"), ("yyyy-MM-'31'", "%Y-%m-31", "end"), ("yyyy 'Winter'", "%Y Winter", "winter"),
    ("'Sept' yyyy", "Sept %Y", "september"), ("yyyy 'nonsense'", "%Y nonsense", "year"), ("'nonsense' yyyy", "nonsense %Y", "none"), ("yyyy-'13'-dd", "%Y-13-%d", "none"), ("yyyy MMM dd", "%Y %b %d", "day"), ("'0'yyyy", "0%Y", "none"), ("yyyy-MM-dd'T23:30:00-05:00'", "%Y-%m-%dT23:30:00-05:00", "next"),
)
READ_BACK = {"day": "CAST(d AS DATE)", "year": "CAST(date_trunc('year', d) AS DATE)", "month": "CAST(date_trunc('month', d) AS DATE)", "end": "last_day(d)", "winter": "make_date(year(d), 12, 1)", "september": "make_date(year(d), 9, 1)", "none": "NULL", "next": "CAST(d + INTERVAL 1 DAY AS DATE)"}


def dated():
    f = lambda p: F.date_format("o_orderdate", p)
    raw = F.lit(None).cast("string")
    for n, (p, _, _) in enumerate(SHAPES):
        raw = F.when(F.col("o_orderkey") % len(SHAPES) == n, f(p)).otherwise(raw)
    return raw


DATED = f"SELECT o_orderkey AS id, d, CASE o_orderkey % {len(SHAPES)} " + " ".join(f"WHEN {n} THEN strftime(o_orderdate, '{p}')" for n, (_, p, _) in enumerate(SHAPES)) + f" END AS raw, CASE o_orderkey % {len(SHAPES)} " + " ".join(f"WHEN {n} THEN {READ_BACK[k]}" for n, (_, _, k) in enumerate(SHAPES)) + " END AS day FROM (SELECT *, o_orderdate AS d FROM orders)"


@query(f"SELECT id, raw, day FROM ({DATED})")
def fn_normalize_date(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), dated().alias("raw")).select("id", "raw", X.normalize_date(F.col("raw")).alias("day"))


@query(f"SELECT id, CASE WHEN id % {len(SHAPES)} = 9 THEN d WHEN id % {len(SHAPES)} = {len(SHAPES) - 1} THEN CAST(CAST(d AS DATE) AS TIMESTAMP) + INTERVAL 28 HOUR + INTERVAL 30 MINUTE ELSE CAST(day AS TIMESTAMP) END AS moment FROM ({DATED})")
def fn_to_utc_datetime(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), dated().alias("raw")).select("id", X.to_utc(F.col("raw")).alias("moment"))


@query(
    """SELECT p_partkey AS id, CASE WHEN regexp_matches(d, '^10\\..*/') THEN d END AS doi FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(raw)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''), '\\.+$', '') AS d FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.' || p_partkey || '/AbC.' WHEN 1 THEN 'DOI: 10.' || p_partkey || '/x' WHEN 2 THEN '10.' || p_partkey ELSE ' 10.' || p_partkey || '/Y.. ' END AS raw FROM part))"""
)
def fn_normalize_doi(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10."), k, F.lit("/AbC."))).when(k % 4 == 1, F.concat(F.lit("DOI: 10."), k, F.lit("/x"))).when(k % 4 == 2, F.concat(F.lit("10."), k)).otherwise(F.concat(F.lit(" 10."), k, F.lit("/Y.. ")))
    return read(spark, sf, "part").select(k.alias("id"), X.normalize_doi(raw).alias("doi"))


TITLE = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN len(string_split({TITLE}, ' ')) >= 4 THEN {TITLE} END AS title FROM documents")
def fn_normalize_title(spark, sf):
    """The whole text stands for a title here."""
    return read(spark, sf, "documents").select("doc_id", X.normalize_title(F.col("text")).alias("title"))


@query("SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/\\s?#]+') AND length(url) <= 1024 AND NOT regexp_matches(url, '\\s'), false) AS valid FROM pages")
def fn_valid_url(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.valid_url(F.col("url")).alias("valid"))


CLEAN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _e, _m in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    CLEAN = f"replace({CLEAN}, '{_e}', '{_m}')"
CLEAN = f"trim(regexp_replace({CLEAN}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {CLEAN} AS text FROM pages")
def src_text_helpers(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(
    """SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 239)) || '…' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)"""
)
def fn_clean_external_text(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))
    return read(spark, sf, "documents").select("doc_id", X.clip(t, 240).alias("text"))


#: Phrases put behind each text, by its id; the last few fit no rule.
PHRASES = tuple(p for _, ps in X.ANNOUNCEMENTS for p in ps) + ("opens an office", "seriously b", "Ships A Product")
PHRASE = "([" + ", ".join(f"'{p}'" for p in PHRASES) + f"])[1 + doc_id % {len(PHRASES)}]"


@query(f"SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in X.ANNOUNCEMENTS) + f" ELSE 'other' END AS kind, 0.6 AS confidence FROM (SELECT doc_id, lower(coalesce(text, '') || ' To Co-' || upper({PHRASE})) AS low FROM documents)".replace("0.6 AS", "CAST(0.6 AS DOUBLE) AS"))
def fn_keyword_class(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (1 + F.col("doc_id") % len(PHRASES)).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" To Co-"), F.upper(phrase))
    return read(spark, sf, "documents").select("doc_id", X.first_rule(text, X.ANNOUNCEMENTS, "other").alias("kind"), F.lit(0.6).alias("confidence"))


@query("SELECT o_orderpriority AS kind, round(1 - exp(-count(*) / 25.0), 6) AS confidence FROM orders GROUP BY ALL")
def fn_sample_confidence(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n")).select("kind", r6(X.sample_confidence(F.col("n")), "confidence"))


@query("SELECT o_orderkey AS id, round(CASE WHEN a <= 0 THEN 1.0 ELSE pow(0.5, a / 30.0) END, 6) AS freshness FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-07-01') AS a FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def fn_freshness(spark, sf):
    age = F.date_diff(F.lit("2001-07-01").cast("date"), F.col("o_orderdate").cast("date"))
    return read(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("id"), r6(X.freshness(age), "freshness"))


@query("SELECT source, avg(CASE WHEN text IS NOT NULL AND lang IS NOT NULL THEN 1.0 ELSE 0.0 END) AS completeness, count(lang) AS present FROM documents GROUP BY ALL")
def fn_completeness(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.avg(F.when(F.col("text").isNotNull() & F.col("lang").isNotNull(), 1.0).otherwise(0.0)).alias("completeness"), F.count("lang").alias("present"))


@query(
    """, g AS (SELECT topic, record_type, ln((sum(n) FILTER (WHERE ago <= 2) + 1.0) / (sum(n) FILTER (WHERE ago BETWEEN 3 AND 5) + 1.0)) AS growth, sum(n) AS total FROM topic_source WHERE ago < 14 GROUP BY ALL)
SELECT topic, count(*) FILTER (WHERE growth > 0) AS supporting, count(*) FILTER (WHERE growth < 0) AS contradicting, count(*) FILTER (WHERE growth = 0) AS flat, round(count(*) FILTER (WHERE growth > 0) / count(*), 6) AS agreement, count(*) FILTER (WHERE growth > 0) >= 2 AS multi_source FROM g WHERE total > 0 GROUP BY ALL""",
    prelude=True,
)
def fn_source_agreement(spark, sf):
    s = topic_source(spark, sf, 14)
    live = s.groupBy("topic", "record_type").agg(F.sum("n").alias("total")).where("total > 0")
    g = S.growth(s, ["topic", "record_type"], value="n").join(live, ["topic", "record_type"], "left_semi")
    n = lambda d: F.count_if(F.col("direction") == d)
    return g.groupBy("topic").agg(n("rising").alias("supporting"), n("falling").alias("contradicting"), n("flat").alias("flat"), r6(n("rising") / F.count("*"), "agreement"), (n("rising") >= 2).alias("multi_source"))


@query("SELECT c_custkey AS id, CASE WHEN regexp_matches(raw, '^[=+\\-@\\t\\r]') THEN '''' || raw ELSE raw END AS cell, round(c_acctbal, 6) AS number FROM (SELECT c_custkey, c_acctbal, CASE c_custkey % 3 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_name ELSE c_name END AS raw FROM customer)")
def sink_csv_cells(spark, sf):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), safe_cell(raw).alias("cell"), number_cell(F.col("c_acctbal")).alias("number"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def fn_json_components(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """WITH j AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type FROM events)
SELECT event_id, path, CAST(value AS VARCHAR) AS value FROM (SELECT event_id, 'k' AS path, k::VARCHAR AS value FROM j UNION ALL SELECT event_id, 'run.kind', event_type FROM j UNION ALL SELECT event_id, 'run.parts', k || ', ' || (k + 1) FROM j UNION ALL SELECT event_id, 'run.deep.half', (k // 2)::VARCHAR FROM j)"""
)
def fn_flatten_metrics(spark, sf):
    """Nested metrics as (dotted path, scalar); lists of scalars are joined. Depth 6 at most."""
    from pulsegrid.operators.nested import flatten

    k = F.get_json_object("props", "$.k").cast("long")
    nested = F.to_json(F.struct(k.alias("k"), F.struct(F.col("event_type").alias("kind"), F.array(k, k + 1).alias("parts"), F.struct(F.floor(k / 2).alias("half")).alias("deep")).alias("run")))
    return flatten(read(spark, sf, "events").select("event_id", nested.alias("metrics")), "metrics")


LETTERS = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT page_id, list_filter(names, lambda n: {LETTERS('n')} <> '' AND contains(hay, {LETTERS('n')})) AS kept, list_filter(names, lambda n: {LETTERS('n')} = '' OR NOT contains(hay, {LETTERS('n')})) AS dropped FROM (SELECT page_id, [upper(string_split(url, '/')[3]), '!!', 'Zentavia, Inc.', 'The <p>'] AS names, {LETTERS('html')} AS hay FROM pages)")
def fn_ground_names(spark, sf):
    """Names that a page is said to hold (its host, nothing, an unknown one, one in other marks): those its text has, and the rest."""
    names = F.array(F.upper(F.get(F.split("url", "/"), F.lit(2))), F.lit("!!"), F.lit("Zentavia, Inc."), F.lit("The <p>"))
    p = read(spark, sf, "pages").select("page_id", names.alias("names"), X.grounded(names, F.col("html")).alias("kept"))
    return p.select("page_id", "kept", F.filter("names", lambda n: ~F.array_contains("kept", n)).alias("dropped"))


# records with identifiers, from parts


def papers(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10."), k % 40, F.lit("/AbC."))).when(k % 5 == 1, F.concat(F.lit("10."), k % 40, F.lit("/abc"))).alias("doi"),
        F.when(k % 7 == 0, F.concat(F.lit(" "), k % 60)).when(k % 7 == 1, F.lit(" ")).alias("pmid"), (2000 + F.floor(k / 3) % 2).cast("int").alias("year"), F.concat("p_name", F.lit(" of the "), F.lower("p_type"), F.lit("!")).alias("title"),
        F.element_at(F.array(F.lit("trials"), F.lit("articles"), F.lit("feed")), (1 + k % 3).cast("int")).alias("source"), F.element_at(F.array(F.lit("publication"), F.lit("patent")), (1 + k % 2).cast("int")).alias("record_type"),
    )


PAPERS = """papers AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.' || (p_partkey % 40) || '/AbC.' WHEN 1 THEN '10.' || (p_partkey % 40) || '/abc' END AS doi,
  CASE p_partkey % 7 WHEN 0 THEN ' ' || (p_partkey % 60) WHEN 1 THEN ' ' END AS pmid, 2000 + (p_partkey // 3) % 2 AS year, p_name || ' of the ' || lower(p_type) || '!' AS title,
  (['trials', 'articles', 'feed'])[1 + p_partkey % 3] AS source, (['publication', 'patent'])[1 + p_partkey % 2] AS record_type FROM part),
norm AS (SELECT *, regexp_replace(regexp_replace(lower(doi), '^https?://doi.org/', ''), '[.]+$', '') AS d, nullif(trim(pmid), '') AS p, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM papers),
keys AS (SELECT id, source, record_type, 0 AS position, 'doi' AS kind, d AS key FROM norm WHERE d IS NOT NULL UNION ALL SELECT id, source, record_type, 1, 'pmid', p FROM norm WHERE p IS NOT NULL
  UNION ALL SELECT id, source, record_type, 2, 'title', year || ':' || t FROM norm WHERE len(string_split(t, ' ')) >= 4)"""


@query(f"WITH {PAPERS} SELECT id, kind, key FROM keys")
def fn_duplicate_keys(spark, sf):
    p = papers(spark, sf)
    return p.select("id", F.explode(X.duplicate_keys(F.col("doi"), F.col("pmid"), F.col("year"), F.col("title"))).alias("k")).select("id", "k.kind", "k.key")


@query("SELECT event_id, regexp_replace(regexp_replace(line, '(api_key=)[^ ]+', '\\1***'), '(Bearer )[^ ]+', '\\1***') AS line FROM (SELECT event_id, 'user ' || user_id || ' api_key=k' || event_id || ' sent Bearer t' || user_id || ' ' || props AS line FROM events)")
def fn_redact(spark, sf):
    line = F.concat(F.lit("user "), "user_id", F.lit(" api_key=k"), "event_id", F.lit(" sent Bearer t"), "user_id", F.lit(" "), "props")
    return read(spark, sf, "events").select("event_id", X.redacted(line).alias("line"))


@query("SELECT DISTINCT p_type, lower(trim(p_type)) AS key FROM part")
def fn_name_key(spark, sf):
    return read(spark, sf, "part").select("p_type", X.name_key(F.concat(F.lit(" - "), "p_type", F.lit("!"))).alias("key")).distinct()


@query("SELECT p_partkey AS id, [p_brand, p_type, p_name] AS items FROM part")
def fn_parse_list(spark, sf):
    text = F.concat(F.lit(" "), "p_brand", F.lit(", ;"), "p_type", F.lit("\n"), "p_name", F.lit(","))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.listed(text).alias("items"))


@query("SELECT page_id, sha256('feed' || chr(31) || url || chr(31) || " + CLEAN + ") AS content_hash FROM pages")
def fn_record_hash(spark, sf):
    """The same for any white space and time of fetching; another for any other change of the kept fields."""
    from pulsegrid.sources.feeds import content_hash

    return read(spark, sf, "pages").select("page_id", content_hash(F.lit("feed"), F.concat(F.lit(" "), "url"), X.clean_text(F.col("html"))).alias("content_hash"))


@query("SELECT min(vec_id) AS first_id, label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings GROUP BY ALL")
def ai_embed_stats(spark, sf):
    return read(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.round(F.avg(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda t, x: t + x)), 4).alias("norm"))


DIM = 64


@query(
    f"""WITH c AS (SELECT label, {", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS c{i}" for i in range(DIM))} FROM embeddings GROUP BY ALL), cv AS (SELECT label, [{", ".join(f"c{i}" for i in range(DIM))}] AS v FROM c),
s AS (SELECT e.vec_id, cv.label, list_sum(list_transform(list_zip(e.embedding, cv.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(list_sum(list_transform(cv.v, lambda x: x * x))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS cos FROM embeddings e CROSS JOIN cv)
SELECT vec_id, arg_max(label, cos) AS nearest, round(max(cos), 5) AS similarity, round(1 - max(cos), 5) AS novelty FROM s GROUP BY ALL"""
)
def ai_cosine_nearest(spark, sf):
    """Each vector's nearest label centroid; there is one centroid for each label, so the reference side is small."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIM)]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    s = e.select("vec_id", "v").crossJoin(F.broadcast(c)).select("vec_id", "label", (dot("v", "c") / F.sqrt(dot("c", "c")) / F.sqrt(dot("v", "v"))).alias("cos"))
    return s.groupBy("vec_id").agg(F.max_by("label", "cos").alias("nearest"), F.round(F.max("cos"), 5).alias("similarity"), F.round(1 - F.max("cos"), 5).alias("novelty"))


@query("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE date_trunc('month', o_orderdate) < DATE '2001-08-01'")
def fn_complete_months(spark, sf):
    """Months that have records and are over by the day of the analysis."""
    from pulsegrid.sources.tables import AS_OF

    month = F.trunc("o_orderdate", "MM")
    return read(spark, sf, "orders").where(month < F.trunc(F.lit(AS_OF), "MM")).select(month.alias("month")).distinct()


#: Buckets that words are hashed into.
BUCKETS = 64
HEX = "(instr('0123456789abcdef', substr(md5(w), {0}, 1)) - 1)"


@query(
    f"""WITH w AS (SELECT doc_id, list_transform(list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda w: ({HEX.format(1)} * 16 + {HEX.format(2)}) % {BUCKETS}) AS b FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, list_transform(range({BUCKETS}), lambda k: CAST(len(list_filter(b, lambda x: x = k)) AS DOUBLE)) AS v FROM w)
SELECT doc_id, list_position(v, list_max(v)) AS strongest, round(list_max(v) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 6) AS weight, len(list_filter(v, lambda x: x > 0)) AS filled FROM v"""
)
def ai_embed(spark, sf):
    """Unit vectors of word counts in hashed buckets: the strongest component, its weight, and how many are filled."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    bucket = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % BUCKETS))
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.array(bucket)).alias("b"))
    v = d.select("doc_id", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter("b", lambda x: x == k)).cast("double")))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    return v.select("doc_id", F.array_position("v", F.array_max("v")).cast("int").alias("strongest"), r6(F.array_max("v") / F.nullif(norm, F.lit(0.0)), "weight"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("filled"))

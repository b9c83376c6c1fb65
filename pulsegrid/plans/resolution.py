"""Organization names and their resolution, over suppliers as known organizations and customers as mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import names as N
from pulsegrid.operators import resolution as R
from pulsegrid.operators.graph import written
from pulsegrid.plans.activity import r6
from pulsegrid.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# names that vary with a row's key, the same way in both engines

STEMS = ("Zentavia", "Orvexa", "Nexoria", "Kalimed", "Mirador", "Talvion", "Luméra", "Verion", "Solbian", "Hexalto", "Brixton", "Quantis")
SECOND = ("Alder", "Birch", "Cedar", "Dune", "Ember", "Fjord", "Grove", "Harbor", "Iris", "Jade", "Kestrel", "Lark", "Maple", "North", "Oak", "Pine", "Quill", "Reed", "Sage", "Tern", "Umber", "Vale", "Wren", "Yarrow", "Zephyr")
WORDS = ("Pharma", "Therapeutics", "Bio", "Labs", "Oncology", "University", "Hospital", "Foundation", "Institute", "Works")
ENDS = (" Inc", " Ltd.", " GmbH", "", " & Co., Ltd", ", S.A.", "")


def pick(values: tuple[str, ...], at: str, spark: bool) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({items}), cast(1 + ({at}) % {len(values)} as int))" if spark else f"([{items}])[1 + ({at}) % {len(values)}]"


def known_name(key: str, spark: bool) -> str:
    tens = f"cast(floor(({key}) / {len(STEMS)}) as bigint)"
    return f"concat({pick(STEMS, key, spark)}, ' ', {pick(SECOND, tens, spark)}, ' ', {pick(WORDS, f'({key}) * 7', spark)}, {pick(ENDS, key, spark)})"


def raw_name(key: str, spark: bool) -> str:
    """A mention: a known name as it is, in capitals, shortened, with a letter missing, under another line of business, or new."""
    base = f"(({key}) % 97 + 1)"
    tens = f"cast(floor({base} / {len(STEMS)}) as bigint)"
    two = f"concat({pick(STEMS, base, spark)}, ' ', {pick(SECOND, tens, spark)})"
    kinds = [
        known_name(base, spark),
        f"upper(concat({two}, ' ', {pick(WORDS, base + ' * 7', spark)}))",
        f"concat('The ', {known_name(base, spark)}, ' Holdings')",
        two,
        f"concat(substr({known_name(base, spark)}, 1, 2), substr({known_name(base, spark)}, 4))",
        f"concat({pick(STEMS, key, spark)}, 'x ', {pick(SECOND, key, spark)}, ' ', {pick(WORDS, key, spark)})",
        pick(STEMS, key, spark),
        f"concat({two}, ' Oncolgy')",
    ]
    return f"CASE ({key}) % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"


def known(spark, sf):
    return read(spark, sf, "supplier").selectExpr("s_suppkey as org_id", known_name("s_suppkey", True) + " as name")


def mentions(spark, sf):
    return read(spark, sf, "customer").selectExpr("c_custkey as id", raw_name("c_custkey", True) + " as raw")


def resolved(spark, sf):
    """The links of all mentions, as a table."""
    return written(R.resolve(mentions(spark, sf), known(spark, sf)), "resolved")


SPACE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
LEGAL_RE = "(?: (?:" + "|".join(N.LEGAL) + "))+$"


def cleaned_sql(x: str) -> str:
    return SPACE(f"regexp_replace(replace(strip_accents(lower({SPACE(x)})), '&', ' and '), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


SHORT_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in N.SHORT.items()) + "}"


def named_sql(source: str, out: str) -> str:
    """Two steps of a WITH list: the rows of ``source`` (with raw) and their normalized, full, compact and sorted names and keys."""
    return f"""{out}_c AS (SELECT *, {cleaned_sql('raw')} AS clean FROM {source}),
{out}_n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(clean, '{LEGAL_RE}', ''), '(?: and)+$', ''), '^the ', '') AS normalized FROM {out}_c),
{out}_f AS (SELECT *, array_to_string(list_transform(string_split(normalized, ' '), lambda w: coalesce({SHORT_MAP}[w], w)), ' ') AS "full" FROM {out}_n WHERE normalized <> ''),
{out} AS (SELECT *, string_split("full", ' ') AS words, array_to_string(list_sort(string_split("full", ' ')), ' ') AS sorted,
  [lower({SPACE('raw')}), normalized, "full", regexp_replace(normalized, '[^a-z0-9]', '', 'g'), regexp_replace("full", '[^a-z0-9]', '', 'g')] AS ks FROM {out}_f)"""


KNOWN_SQL = f"known0 AS (SELECT s_suppkey AS org_id, {known_name('s_suppkey', False)} AS raw FROM supplier), " + named_sql("known0", "known")
RAW_SQL = f"raws AS (SELECT c_custkey AS id, {raw_name('c_custkey', False)} AS raw FROM customer), mention0 AS (SELECT DISTINCT raw FROM raws), " + named_sql("mention0", "mention")
METHODS = tuple(N.KEY_CONFIDENCE)
KEYS_SQL = f"""mkeys AS (SELECT raw, position, ([{', '.join(f"'{m}'" for m in METHODS)}])[position + 1] AS method, key FROM (SELECT raw, unnest(range(5)) AS position, unnest(ks) AS key, ks FROM mention) WHERE key <> '' AND list_position(ks, key) = position + 1)"""


@query(f"""WITH {KNOWN_SQL} SELECT org_id AS id, normalized AS name, "full" AS expanded, ks[4] AS compact, ks[5] AS full_compact FROM known""")
def fn_normalize_org(spark, sf):
    k = R.named(known(spark, sf).withColumnRenamed("name", "raw"))
    return k.select(F.col("org_id").alias("id"), F.col("normalized").alias("name"), F.col("full").alias("expanded"), N.compact(F.col("normalized")).alias("compact"), N.compact(F.col("full")).alias("full_compact"))


@query(f"WITH {RAW_SQL} SELECT raw, sorted AS words FROM mention")
def fn_sorted_words(spark, sf):
    return R.named(mentions(spark, sf).select("raw").distinct()).select("raw", F.col("sorted").alias("words"))


@query(f"WITH {RAW_SQL}, {KEYS_SQL} SELECT raw, CAST(position AS INTEGER) AS position, method, key FROM mkeys")
def fn_match_keys(spark, sf):
    m = R.named(mentions(spark, sf).select("raw").distinct())
    return m.select("raw", F.explode("keys").alias("k")).select("raw", "k.position", "k.method", "k.key")


LAST_WORD = "regexp_replace(string_split(" + SPACE("lower(raw)") + ", ' ')[-1], '^[.,]+|[.,]+$', '', 'g')"


@query(
    f"""WITH {RAW_SQL} SELECT raw, CASE WHEN regexp_matches(raw, '\\p{{L}}') AND upper(raw) <> raw AND lower(raw) <> raw THEN 1 ELSE 0 END AS mixed, CASE WHEN regexp_matches(raw, '\\b[A-Za-z]{{1,4}}\\.') THEN 0 ELSE 1 END AS spelled_out,
  CASE WHEN {LAST_WORD} IN ({', '.join(f"'{w}'" for w in N.LEGAL)}) THEN 0 ELSE 1 END AS plain, length(raw) AS length FROM mention0"""
)
def fn_display_quality(spark, sf):
    m = mentions(spark, sf).select("raw").distinct()
    return m.select("raw", N.display_quality(F.col("raw")).alias("q")).select("raw", "q.mixed", "q.spelled_out", "q.plain", F.col("q.length").cast("long").alias("length"))


def _classify_sql(x: str) -> str:
    t = SPACE(f"lower({x})")
    cases = [(w, k, c, f"matched ''{w}''") for words, k, c in N.KINDS for w in words]
    out = " ".join(f"WHEN regexp_matches({t}, '\\b{w}') THEN {{'kind': '{k}', 'confidence': CAST({c} AS DOUBLE), 'reason': '{reason}'}}" for w, k, c, reason in cases)
    last = f"trim(string_split({t}, ' ')[-1], '.')"
    out += f" WHEN contains({t}, ' ') AND {last} IN ({', '.join(repr(w) for w in N.COMPANY_ENDS)}) THEN {{'kind': 'company', 'confidence': CAST(0.6 AS DOUBLE), 'reason': 'shortened company name ''' || {last} || ''''}}"
    out += " " + " ".join(f"WHEN regexp_matches({t}, '\\b{w}') THEN {{'kind': 'nonprofit', 'confidence': CAST(0.5 AS DOUBLE), 'reason': 'matched ''{w}'''}}" for w in N.RESEARCH)
    ending = f"regexp_extract({cleaned_sql(x)}, ' ({'|'.join(N.LEGAL)})$', 1)"
    out += f" WHEN {ending} <> '' THEN {{'kind': 'company', 'confidence': CAST(0.75 AS DOUBLE), 'reason': 'legal suffix ''' || {ending} || ''''}}"
    return f"CASE {out} ELSE {{'kind': 'unknown', 'confidence': CAST(0.3 AS DOUBLE), 'reason': 'no identifying words'}} END"


@query(f"WITH {RAW_SQL}, k AS (SELECT raw, {_classify_sql('raw')} AS c FROM mention0) SELECT raw, c.kind AS kind, c.confidence AS confidence, c.reason AS reason FROM k")
def fn_classify_org(spark, sf):
    return mentions(spark, sf).select("raw").distinct().select("raw", N.classify_org(F.col("raw")).alias("c")).select("raw", "c.*")


_ANY = "|".join(w for g in (N.COMPANY, N.UNIVERSITY, N.HOSPITAL, N.NONPROFIT, N.GOVERNMENT, N.RESEARCH, N.GATHERINGS) for w in g)


@query(f"WITH {RAW_SQL} SELECT raw, regexp_matches({SPACE('lower(raw)')}, '\\b(?:{_ANY})') OR regexp_matches({cleaned_sql('raw')}, ' (?:{'|'.join(N.LEGAL)})$') AS organization FROM mention0")
def fn_looks_like_org(spark, sf):
    return mentions(spark, sf).select("raw").distinct().select("raw", N.looks_like_org(F.col("raw")).alias("organization"))


@query(
    f"""WITH s AS (SELECT s_suppkey AS id, {known_name('s_suppkey', False)} AS a, {known_name('s_suppkey + 5', False)} AS b FROM supplier),
p AS (SELECT id, list_filter([regexp_replace(trim(a, ' .'), '^(.*)$', '\\1'), trim(b, ' .')], lambda x: regexp_matches({SPACE('lower(x)')}, '\\b(?:{_ANY})') OR regexp_matches({cleaned_sql('x')}, ' (?:{'|'.join(N.LEGAL)})$')) AS named, trim(a, ' .') AS first FROM s)
SELECT id, unnest(CASE WHEN len(named) > 0 THEN named ELSE [first] END) AS name FROM p"""
)
def fn_split_affiliation(spark, sf):
    """Two names among departments, addresses and places: the parts that look like organizations."""
    s = read(spark, sf, "supplier")
    text = F.expr(f"concat('Dept. of Things, ', {known_name('s_suppkey', True)}, ', 12345 Elm Street, Boston Road, MA, USA; ', {known_name('s_suppkey + 5', True)}, ', U.K.; write to a.b@c.org')")
    return s.select(F.col("s_suppkey").alias("id"), F.explode(N.split_affiliation(text)).alias("name"))


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: a bit of a 128-bit number for each character of ``a``."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = lambda c: f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, CAST(i AS INTEGER), 1) = {c} THEN 1::HUGEINT << CAST(i - 1 AS INTEGER) ELSE 0::HUGEINT END))::HUGEINT"
    steps = f"list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask('c')}))"
    return f"(length({a}) - bit_count(list_reduce({steps}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"


def ratio_sql(a: str, b: str) -> str:
    return f"(2.0 * {lcs_sql(a, b)} / (length({a}) + length({b})))"


@query(f"SELECT a.n_name AS a, b.n_name AS b, round(CAST({ratio_sql('a.n_name', 'b.n_name')} AS DOUBLE), 6) AS ratio FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def fn_indel_ratio(spark, sf):
    n = read(spark, sf, "nation").select("n_name", "n_regionkey")
    pairs = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey")
    return pairs.select("a", "b", r6(N.indel_ratio("a", "b"), "ratio"))


BY_KEYS = f"""{KNOWN_SQL}, {RAW_SQL}, {KEYS_SQL}, kkeys AS (SELECT DISTINCT org_id, unnest(ks) AS key FROM known),
khits AS (SELECT raw, position, method, list_sort(list(DISTINCT org_id)) AS candidates FROM mkeys JOIN kkeys USING (key) WHERE key <> '' GROUP BY ALL),
keyed AS (SELECT raw, arg_min(method, position) AS method, arg_min(candidates, position) AS candidates FROM khits GROUP BY ALL)"""


@query(f"WITH {BY_KEYS} SELECT raw, method, candidates[1] AS org_id, len(candidates) AS candidates FROM keyed")
def er_by_keys(spark, sf):
    m, k = R.named(mentions(spark, sf).select("raw").distinct()), R.named(known(spark, sf).withColumnRenamed("name", "raw"))
    return R.by_keys(m, k).select("raw", "method", F.get("candidates", F.lit(0)).alias("org_id"), F.size("candidates").cast("long").alias("candidates"))


PREFIXES = """prefixes AS (SELECT m.raw, list_sort(list(DISTINCT k.org_id)) AS starts FROM mention m JOIN known k ON len(m.words) <= 2 AND len(k.words) > len(m.words) AND k.words[1:len(m.words)] = m.words GROUP BY ALL)"""


@query(f"WITH {KNOWN_SQL}, {RAW_SQL}, {PREFIXES} SELECT raw, starts[1] AS org_id, len(starts) AS candidates FROM prefixes")
def join_prefix_tokens(spark, sf):
    m, k = R.named(mentions(spark, sf).select("raw").distinct()), R.named(known(spark, sf).withColumnRenamed("name", "raw"))
    return R.by_prefix(m, k).select("raw", F.get("candidates", F.lit(0)).alias("org_id"), F.size("candidates").cast("long").alias("candidates"))


#: The twin holds every name against every organization whose length allows the similarity.
FUZZY = f"""texts AS (SELECT DISTINCT sorted AS a FROM mention), pairs AS (SELECT a, org_id, {ratio_sql('a', 'sorted')} AS score FROM texts JOIN known ON 2.0 * least(length(a), length(sorted)) >= 0.8 * (length(a) + length(sorted))),
best AS (SELECT a, arg_max(org_id, [CAST(score AS DOUBLE), -org_id]) AS "like", max(score) AS score FROM pairs WHERE score >= 0.8 GROUP BY a)"""


@query(f"""WITH {KNOWN_SQL}, {RAW_SQL}, {FUZZY} SELECT raw, "like" AS org_id, round(CAST(score AS DOUBLE), 6) AS score FROM mention JOIN best ON sorted = a""")
def join_fuzzy_best(spark, sf):
    """The most similar known name of every mention, from 0.8 on: rarest grams first, no pair is lost."""
    m, k = R.named(mentions(spark, sf).select("raw").distinct()), R.named(known(spark, sf).withColumnRenamed("name", "raw"))
    return R.by_similarity(m, k).select("raw", "org_id", r6("score"))


DIVISION_LIST = "[" + ", ".join(f"'{w}'" for w in N.DIVISIONS) + "]"


def compatible_sql(raw: str, kind: str) -> str:
    c = _classify_sql(raw)
    return f"(({c}).kind = 'unknown' OR {kind} = 'unknown' OR ({c}).confidence < 0.8 OR ({c}).kind = {kind})"


def differ_sql(a: str, b: str) -> str:
    return f"len(list_filter({DIVISION_LIST}, lambda w: list_contains({a}, w) <> list_contains({b}, w))) > 0"


RESOLVE = f"""{BY_KEYS}, {PREFIXES}, {FUZZY}, kinds AS (SELECT org_id, words AS org_words, ({_classify_sql('raw')}).kind AS kind FROM known),
j AS (SELECT m.raw, m."full", m.words, k.method, k.candidates, CASE WHEN k.raw IS NULL THEN p.starts END AS starts, CASE WHEN k.raw IS NULL THEN b."like" END AS "like", b.score FROM mention m LEFT JOIN keyed k ON k.raw = m.raw LEFT JOIN prefixes p ON p.raw = m.raw LEFT JOIN best b ON b.a = m.sorted),
r AS (SELECT j.*, CASE WHEN len(candidates) = 1 THEN method WHEN len(candidates) > 1 THEN 'ambiguous' WHEN len(starts) = 1 AND {compatible_sql('j.raw', 's.kind')} THEN 'prefix' WHEN len(starts) > 1 THEN 'ambiguous'
  WHEN score >= 0.92 AND "like" IS NOT NULL AND NOT {differ_sql('j.words', 'f.org_words')} AND {compatible_sql('j.raw', 'f.kind')} THEN 'fuzzy' WHEN "like" IS NOT NULL THEN 'near' ELSE 'created' END AS how
  FROM j LEFT JOIN kinds s ON s.org_id = starts[1] AND len(starts) = 1 LEFT JOIN kinds f ON f.org_id = "like"),
resolved AS (SELECT raw, "full", CASE how WHEN 'near' THEN 'created' ELSE how END AS method, CASE WHEN how = 'prefix' THEN starts[1] WHEN how = 'fuzzy' THEN "like" WHEN how IN ('ambiguous', 'near', 'created') THEN NULL ELSE candidates[1] END AS org_id,
  CASE how {' '.join(f"WHEN '{m}' THEN CAST({c} AS DOUBLE)" for m, c in N.KEY_CONFIDENCE.items())} WHEN 'prefix' THEN 0.75 WHEN 'fuzzy' THEN CAST(score AS DOUBLE) WHEN 'ambiguous' THEN 0.4 WHEN 'near' THEN 0.6 ELSE 0.9 END AS confidence, how IN ('prefix', 'ambiguous', 'near') AS review FROM r)"""


@query(f"WITH {RESOLVE} SELECT raw, method, org_id, round(CAST(confidence AS DOUBLE), 6) AS confidence, review FROM resolved")
def er_resolve(spark, sf):
    return R.resolve(mentions(spark, sf), known(spark, sf)).select("raw", "method", "org_id", r6("confidence"), "review")


@query(f"WITH {KNOWN_SQL}, {RAW_SQL}, kinds AS (SELECT DISTINCT ({_classify_sql('raw')}).kind AS kind FROM known) SELECT raw, kind, {compatible_sql('raw', 'kind')} AS compatible FROM mention0 CROSS JOIN kinds")
def er_compatible(spark, sf):
    """Every distinct name against every kind of organization; there are six kinds."""
    kinds = known(spark, sf).select(N.classify_org(F.col("name"))["kind"].alias("kind")).distinct()
    return mentions(spark, sf).select("raw").distinct().crossJoin(F.broadcast(kinds)).select("raw", "kind", R.compatible(F.col("raw"), F.col("kind")).alias("compatible"))


@query(f"""WITH {RESOLVE} SELECT "full" AS name, count(*) AS spellings, min(raw) AS first_spelling, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY "full") AS org_id FROM resolved WHERE org_id IS NULL GROUP BY "full" """)
def er_create(spark, sf):
    """New organizations, one for each expanded name, with ids after the known ones. A replay makes the same ones."""
    new = resolved(spark, sf).where("org_id is null").groupBy(F.col("full").alias("name")).agg(F.count("*").alias("spellings"), F.min("raw").alias("first_spelling"))
    last = known(spark, sf).agg(F.max("org_id").alias("last"))
    # ids in name order without one task for all: counts of a name's first letter, then places within it
    first = new.withColumn("lead", F.substring("name", 1, 1))
    from pyspark.sql import Window as W

    before = first.groupBy("lead").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("lead").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("lead").orderBy("name"))).join(F.broadcast(before), "lead").crossJoin(F.broadcast(last))
    return placed.select("name", "spellings", "first_spelling", (F.col("last") + F.col("before") + F.col("place")).alias("org_id"))


@query(f"""WITH {RESOLVE} SELECT 'organization_match' AS queue_type, "full" AS subject, count(*) AS spellings, min(raw) AS raw_name, 'pending' AS status FROM resolved WHERE review GROUP BY "full" """)
def er_review_queue(spark, sf):
    """One item for each name to review, however many spellings led to it."""
    r = resolved(spark, sf).where("review")
    return r.groupBy(F.col("full").alias("subject")).agg(F.count("*").alias("spellings"), F.min("raw").alias("raw_name")).select(F.lit("organization_match").alias("queue_type"), "subject", "spellings", "raw_name", F.lit("pending").alias("status"))


@query(
    f"""WITH {KNOWN_SQL}, x AS (SELECT a.org_id, b.org_id AS other, len(b.words) < len(a.words) AND a.words[1:len(b.words)] = b.words OR len(a.words) < len(b.words) AND b.words[1:len(a.words)] = a.words AS start,
  len(a.words) > 1 AND len(b.words) > 1 AND a.words[1] = b.words[1] AND NOT list_contains({DIVISION_LIST}, a.words[1]) AS lead FROM known a JOIN known b ON a.org_id <> b.org_id AND a.words[1] = b.words[1])
SELECT org_id, min(other) AS parent, CASE WHEN arg_min(start, other) THEN 'one name is the start of the other' ELSE 'both names start with the same word' END AS reason FROM x WHERE start OR lead GROUP BY org_id"""
)
def er_suggest_parent(spark, sf):
    return R.suggest_parents(known(spark, sf))


@query(f"WITH {RAW_SQL}, {KNOWN_SQL} SELECT raw, {differ_sql('m.words', 'k.words')} AS apart FROM raws r JOIN mention m USING (raw) JOIN known k ON k.org_id = r.id % 97 + 1")
def set_symmetric_tokens(spark, sf):
    m = R.named(mentions(spark, sf)).withColumn("org_id", F.col("id") % 97 + 1)
    k = R.named(known(spark, sf).withColumnRenamed("name", "raw")).select("org_id", F.col("words").alias("org_words"))
    return m.join(k, "org_id").select("raw", N.distinguishing(F.col("words"), F.col("org_words")).alias("apart"))


MANUAL = ("zentavia birch therapeutics", "ORVEXA ALDER FOUNDATION LTD", "Nobody Knows This Inc", "Nexoria Alder Bio")


@query(
    f"WITH mention0(raw) AS (VALUES {', '.join(f'({n!r})' for n in MANUAL)}), {named_sql('mention0', 'mention')}, {KNOWN_SQL}, {KEYS_SQL}, kkeys AS (SELECT DISTINCT org_id, unnest(ks) AS key FROM known), "
    "h AS (SELECT raw, position, min(org_id) AS org_id FROM mkeys JOIN kkeys USING (key) WHERE key <> '' GROUP BY ALL) SELECT m.raw AS name, arg_min(org_id, position) AS org_id, count(org_id) = 0 AS missing FROM mention m LEFT JOIN h USING (raw) GROUP BY ALL"
)
def disc_manual_match(spark, sf):
    """Configured names by their first matching key; names that match nothing are reported."""
    m = R.named(spark.createDataFrame([(n,) for n in MANUAL], "raw string"))
    hits = R.by_keys(m, R.named(known(spark, sf).withColumnRenamed("name", "raw")))
    return m.select("raw").join(hits, "raw", "left").select(F.col("raw").alias("name"), F.get("candidates", F.lit(0)).alias("org_id"), F.col("candidates").isNull().alias("missing"))


@query(
    f"""WITH {RESOLVE}, a AS (SELECT org_id, raw, count(*) AS mentions FROM raws JOIN resolved USING (raw) WHERE org_id IS NOT NULL GROUP BY ALL)
SELECT org_id, count(*) AS aliases, CAST(sum(mentions) AS BIGINT) AS mentions, arg_max(raw, [mentions, CASE WHEN regexp_matches(raw, '\\p{{L}}') AND upper(raw) <> raw AND lower(raw) <> raw THEN 1 ELSE 0 END, CASE WHEN regexp_matches(raw, '\\b[A-Za-z]{{1,4}}\\.') THEN 0 ELSE 1 END, CASE WHEN {LAST_WORD} IN ({', '.join(f"'{w}'" for w in N.LEGAL)}) THEN 0 ELSE 1 END, length(raw), hash_order]) AS display
FROM (SELECT *, row_number() OVER (ORDER BY raw DESC) AS hash_order FROM a) GROUP BY org_id"""
)
def er_alias_counts(spark, sf):
    """Spellings of each organization, their mentions, and the one to show: most mentioned, then most presentable, then first by name."""
    linked = resolved(spark, sf).where("org_id is not null").select("raw", "org_id")
    a = mentions(spark, sf).groupBy("raw").agg(F.count("*").alias("mentions")).join(linked, "raw")
    best = a.withColumn("rank", F.struct("mentions", N.display_quality(F.col("raw")).alias("q")))
    top = best.groupBy("org_id").agg(F.count("*").alias("aliases"), F.sum("mentions").alias("mentions"), F.max("rank").alias("rank"))
    shown = best.join(top.select("org_id", "rank"), ["org_id", "rank"]).groupBy("org_id").agg(F.min("raw").alias("display"))
    return top.join(shown, "org_id").select("org_id", "aliases", "mentions", "display")


@query(
    f"""WITH {RESOLVE}, stored AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0)
SELECT id, raw, coalesce(org_id, -1) AS org_id, round(CAST(confidence * 0.95 AS DOUBLE), 3) AS confidence, 'normalized' AS status, CAST(floor(id / 500) AS BIGINT) AS batch FROM raws JOIN resolved USING (raw) WHERE id NOT IN (SELECT id FROM stored)"""
)
def norm_run(spark, sf):
    """Pending mentions with their links, in batches of 500 ids; stored links are skipped, so a run may be repeated."""
    stored = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    todo = mentions(spark, sf).join(stored, "id", "left_anti")
    linked = resolved(spark, sf)
    return todo.join(linked, "raw").select("id", "raw", F.coalesce("org_id", F.lit(-1).cast("long")).alias("org_id"), F.round(F.col("confidence") * 0.95, 3).alias("confidence"), F.lit("normalized").alias("status"), F.floor(F.col("id") / 500).alias("batch"))


@query("SELECT c_custkey AS id, 'new' AS status FROM customer")
def norm_reset(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("status"))

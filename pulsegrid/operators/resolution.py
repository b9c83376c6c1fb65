"""Linking raw organization names to known organizations in one plan: keys, prefixes, similar names, review queue.

Raw names are made distinct first, so what is joined does not grow with mentions.
Names that are new become organizations by their expanded form; the order in which
they come does not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import names as N
from pulsegrid.operators.graph import written

#: Similarity from which names are merged, and from which they are reviewed; words of a name that may be a prefix.
MERGE, REVIEW, PREFIX_WORDS = 0.92, 0.80, 2
#: Confidence from which a kind told by a name forbids another kind.
STRONG_KIND = 0.8


def named(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with normalized, full, words (of full), sorted and keys of its names; rows without a usable name go."""
    df = df.withColumn("normalized", N.normalize_org(F.col(raw))).where("normalized <> ''")
    df = df.withColumn("full", N.expanded(F.col("normalized")))
    return df.withColumns({"words": F.split("full", " "), "sorted": N.sorted_words(F.col("full")), "keys": N.match_keys(F.col(raw), F.col("normalized"), F.col("full"))})


def by_keys(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """raw, method, candidates (ascending ids): the first key, in order, that any organization has."""
    tried = mentions.select("raw", F.explode("keys").alias("k")).select("raw", "k.position", "k.method", "k.key")
    index = known.select("org_id", F.explode("keys.key").alias("key")).distinct()
    hits = tried.join(index, "key").groupBy("raw", "position", "method").agg(F.array_sort(F.collect_set("org_id")).alias("candidates"))
    return hits.groupBy("raw").agg(F.min_by(F.struct("method", "candidates"), "position").alias("m")).select("raw", "m.method", "m.candidates")


def by_prefix(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """raw, candidates: organizations whose name begins with this short name and goes on."""
    starts = known.select("org_id", "words", F.explode(F.sequence(F.lit(1), F.lit(PREFIX_WORDS))).alias("n")).where("n < size(words)")
    starts = starts.select("org_id", F.array_join(F.slice("words", 1, F.col("n")), " ").alias("full"))
    short = mentions.where(F.size("words") <= PREFIX_WORDS).select("raw", "full")
    return short.join(starts, "full").groupBy("raw").agg(F.array_sort(F.collect_set("org_id")).alias("candidates"))


def _grams(text: Column) -> Column:
    """Pairs of neighbouring characters, numbered where they repeat."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda q: q == p)).cast("string")))


def similar(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, score) of all pairs of texts, from ``left`` (a) and ``right`` (b), whose subsequence ratio is at least ``floor`` (over 2/3).

    Each edit parts at most one pair of neighbours, so texts of la and lb
    characters share (la + lb) / 2 - 1 - 1.5 (1 - floor) (la + lb) grams at least.
    Hence each of two similar texts has a shared gram among its rarest ones, and
    only those are joined on; short texts meet by length. Nothing is lost.
    """

    def rare(df: DataFrame, count: DataFrame) -> DataFrame:
        g = df.select("text", F.explode(F.array_distinct(_grams(F.col("text")))).alias("gram")).join(count, "gram", "left")
        order = W.partitionBy("text").orderBy(F.coalesce("n", F.lit(0)), "gram")
        n = F.length("text")
        least = F.ceil((1.5 * floor - 1) * 2 * n / (2 - floor) - 1)
        return g.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n - F.greatest(least, F.lit(1))).select("text", "gram")

    a, b = (df.select(F.col(c).alias("text")).distinct() for df, c in ((left, "a"), (right, "b")))
    count = b.select("text", F.explode(F.array_distinct(_grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    # texts of up to this many characters need not share a gram
    short = math.ceil(2 * (2 - floor) / (2 * (1.5 * floor - 1))) + 1
    met = rare(a, count).select(F.col("text").alias("a"), "gram").join(rare(b, count).select(F.col("text").alias("b"), "gram"), "gram").select("a", "b")
    size = F.length("text")
    reach = a.where(size <= short).select(F.col("text").alias("a"), F.explode(F.sequence(F.floor(size * floor / (2 - floor)), F.ceil(size * (2 - floor) / floor))).alias("n"))
    brief = reach.join(b.select(F.col("text").alias("b"), size.cast("long").alias("n")), "n").select("a", "b")
    pairs = met.union(brief).where(2 * F.least(F.length("a"), F.length("b")) >= floor * (F.length("a") + F.length("b"))).distinct()
    return pairs.withColumn("score", N.indel_ratio("a", "b")).where(F.col("score") >= floor)


def by_similarity(mentions: DataFrame, known: DataFrame, floor: float = REVIEW) -> DataFrame:
    """raw, org_id, score: the most similar organization from ``floor`` on, the smallest id among equals."""
    found = similar(mentions.select(F.col("sorted").alias("a")), known.select(F.col("sorted").alias("b")), floor)
    best = found.join(known.select(F.col("sorted").alias("b"), "org_id"), "b").groupBy("a").agg(F.max_by(F.struct("org_id", "score"), F.struct("score", -F.col("org_id"))).alias("m"))
    return mentions.select("raw", F.col("sorted").alias("a")).join(best, "a").select("raw", "m.org_id", "m.score")


def compatible(raw: Column, kind: Column) -> Column:
    """Kinds that a name tells with confidence must agree with the organization's."""
    told = N.classify_org(raw)
    return (told["kind"] == "unknown") | (kind == "unknown") | (told["confidence"] < STRONG_KIND) | (told["kind"] == kind)


def resolve(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """raw, full, method, org_id, confidence, review: how each distinct raw name is linked.

    One key match links; several make a new organization to review. Then a single
    longer name that begins with it links for review, several are ambiguous. Then
    the most similar name links from MERGE on, unless a word of a line of business
    or the kind speaks against it; from REVIEW on the name is new, for review.
    Anything else is new. A null org_id stands for the new organization of that name.
    """
    # read by every step, so worked out once
    m = written(named(mentions.select("raw").distinct()), "mentions")
    k = written(named(known.select("org_id", F.col("name").alias("raw"))), "known")
    kinds = k.select("org_id", N.classify_org(F.col("raw"))["kind"].alias("kind"), F.col("words").alias("org_words"))
    keyed = by_keys(m, k)
    rest = m.join(keyed, "raw", "left_anti")
    starts = by_prefix(rest, k).select("raw", F.col("candidates").alias("starts"))
    fuzzy = by_similarity(rest, k).select("raw", F.col("org_id").alias("like"), "score")
    j = m.select("raw", "full", "words").join(keyed, "raw", "left").join(starts, "raw", "left").join(fuzzy, "raw", "left")
    of = lambda column, p: kinds.select(F.col("org_id").alias(column), F.col("kind").alias(f"{p}_kind"), F.col("org_words").alias(f"{p}_words"))
    j = j.withColumn("start", F.when(F.size("starts") == 1, F.get("starts", F.lit(0)))).join(of("start", "start"), "start", "left").join(of("like", "like"), "like", "left")
    fits = F.col("start").isNotNull() & compatible(F.col("raw"), F.col("start_kind"))
    merge = (F.col("score") >= MERGE) & ~N.distinguishing(F.col("words"), F.col("like_words")) & compatible(F.col("raw"), F.col("like_kind"))
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in N.KEY_CONFIDENCE.items() for x in pair]), F.col("method"))
    link = lambda method, org, confidence, review: F.struct(method.alias("method"), org.cast("long").alias("org_id"), confidence.cast("double").alias("confidence"), F.lit(review).alias("review"))
    no = F.lit(None)
    out = (
        F.when(F.size("candidates") == 1, link(F.col("method"), F.get("candidates", F.lit(0)), sure, False))
        .when(F.size("candidates") > 1, link(F.lit("ambiguous"), no, F.lit(0.4), True))
        .when(fits, link(F.lit("prefix"), F.col("start"), F.lit(0.75), True))
        .when(F.size("starts") > 1, link(F.lit("ambiguous"), no, F.lit(0.4), True))
        .when(merge, link(F.lit("fuzzy"), F.col("like"), F.col("score"), False))
        .when(F.col("like").isNotNull(), link(F.lit("created"), no, F.lit(0.6), True))
        .otherwise(link(F.lit("created"), no, F.lit(0.9), False))
    )
    return j.select("raw", "full", out.alias("m")).select("raw", "full", "m.*")


def suggest_parents(known: DataFrame) -> DataFrame:
    """org_id, parent, reason: the lowest other id whose name begins this one, is begun by it, or shares its first word."""
    k = named(known.select("org_id", F.col("name").alias("raw"))).select("org_id", "full", "words")
    first_two = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("org_id")), 1, 2).alias("ids"))
    exact = first_two(k, "full")
    cut = lambda at: F.array_join(F.slice("words", 1, at), " ")
    starts = k.select("org_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))).alias("n")).where("n < size(words)").select("org_id", cut(F.col("n")).alias("start"))
    first = F.get("words", F.lit(0))
    leading = first_two(k.where(F.size("words") > 1).select("org_id", first.alias("lead")).where(~F.col("lead").isin(*N.DIVISIONS)), "lead")
    other = F.expr("get(filter(ids, x -> x <> org_id), 0)")
    shorter = starts.join(exact.withColumnRenamed("full", "start"), "start").select("org_id", other.alias("other"), F.lit(True).alias("start"))
    longer = k.join(first_two(starts, "start").withColumnRenamed("start", "full"), "full").select("org_id", other.alias("other"), F.lit(True).alias("start"))
    same = k.where(F.size("words") > 1).withColumn("lead", first).join(leading, "lead").select("org_id", other.alias("other"), F.lit(False).alias("start"))
    found = shorter.union(longer).union(same).where("other is not null").groupBy("org_id").agg(F.min(F.struct("other", (~F.col("start")).alias("word"))).alias("m"))
    return found.select("org_id", F.col("m.other").alias("parent"), F.when(F.col("m.word"), "both names start with the same word").otherwise("one name is the start of the other").alias("reason"))

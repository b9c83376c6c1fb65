"""Text, date and identifier functions on columns: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, their short forms, and the month that a season stands for.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = {"sept": 9}
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
#: Years that a date may have.
YEARS = (1900, 2100)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def month_number(word: Column) -> Column:
    """Of a month's name, its first three letters or a season; null for anything else."""
    names = {m: n for n, m in enumerate(MONTHS, 1)} | {m[:3]: n for n, m in enumerate(MONTHS, 1)} | SHORT_MONTHS | SEASONS
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(word))


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date with the day clipped to the month's end; null outside YEARS or the twelve months."""
    ok = year.between(*YEARS) & month.between(1, 12)
    first = F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1))
    d = F.greatest(F.least(F.coalesce(day, F.lit(1)), F.dayofmonth(F.last_day(first))), F.lit(1))
    return F.when(ok, F.date_add(first, d - 1))


def normalize_date(text: Column) -> Column:
    """A date from whatever tokens the text has, told apart by their kind.

    A first token of digits with - / or . between them is year, month and day; a
    time of day after it may bring a zone and is taken to UTC. Otherwise words of
    letters are months (of a range the first) or seasons, four digits a year, one or
    two a day: year first, with what follows if it is a month, or year last, after
    a month. What is missing is 1. Anything else is null.
    """
    zone = F.current_timezone()

    def split(t: Column) -> Column:
        tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace(t, r"\s*-\s*[A-Za-z]+\.?", ""), r"[.,]+(?: |$)", " "), " "), lambda w: w != "")
        return F.struct(t.alias("t"), F.split(F.regexp_extract(t, "^([0-9./-]+)(?:[T ].*)?$", 1), "[-/.]").alias("numbers"), tokens.alias("tokens"))

    def told(x: Column) -> Column:
        first = lambda pattern: F.get(F.filter(x["tokens"], lambda w: w.rlike(pattern)), F.lit(0))
        kind = F.array_join(F.transform(x["tokens"], lambda w: F.when(w.rlike("^[0-9]{4}$"), "y").when(w.rlike("^[0-9]{1,2}$"), "d").when(w.rlike("^[A-Za-z]+$"), "w").otherwise("?")), "")
        number = lambda i: F.when(F.length(F.get(x["numbers"], F.lit(i))).between(1, 4), F.get(x["numbers"], F.lit(i)).cast("int"))
        short = lambda i: F.coalesce(F.length(F.get(x["numbers"], F.lit(i))).between(1, 2), F.lit(i == 2) & (F.size(x["numbers"]) == 2))
        numeric = (F.length(F.get(x["numbers"], F.lit(0))) == 4) & F.size(x["numbers"]).isin(2, 3) & short(1) & short(2)
        stamp = F.when(x["t"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:"), F.to_utc_timestamp(F.try_to_timestamp(x["t"]), zone).cast("date"))
        year, day, month = first("^[0-9]{4}$").cast("int"), first("^[0-9]{1,2}$").cast("int"), month_number(first("^[A-Za-z]+$"))
        parts = {"kind": kind, "stamp": stamp, "numeric": numeric, "n0": number(0), "n1": number(1), "n2": number(2), "year": year, "month": month, "day": day}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def chosen(x: Column) -> Column:
        """Year, month and day by what the tokens are."""
        date = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        one, kind = F.lit(1), x["kind"]
        return (
            F.when(x["stamp"].isNotNull(), date(F.year(x["stamp"]), F.month(x["stamp"]), F.dayofmonth(x["stamp"])))
            .when(x["numeric"], date(x["n0"], x["n1"], x["n2"]))
            .when(kind == "y", date(x["year"], one, one))
            .when(kind.rlike("^yw"), date(x["year"], F.coalesce(x["month"], one), F.when(x["month"].isNotNull() & kind.rlike("^ywd"), x["day"])))
            .when(kind.isin("wy", "dwy", "wdy", "dwdy"), date(x["year"], x["month"], x["day"]))
        )

    steps = bound(bound(bound(F.trim(F.regexp_replace(text, r"\s+", " ")), split), told), chosen)
    return bound(steps, lambda x: _made(x["y"], x["m"], x["d"]))


def to_utc(text: Column) -> Column:
    """The moment a text names, without zone, in UTC: of a timestamp as it is, of a date its midnight."""
    t = F.trim(text)
    moment = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:"), F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()))
    return F.coalesce(moment.cast("timestamp_ntz"), normalize_date(text).cast("timestamp_ntz"))


def normalize_doi(text: Column) -> Column:
    """Without prefixes and trailing dots, lower case; null unless it begins with 10. and has a slash."""
    d = F.regexp_replace(F.lower(F.trim(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    d = F.regexp_replace(d, r"\.+$", "")
    return F.when(d.rlike(r"^10\..*/"), d)


def normalize_title(text: Column) -> Column:
    """Letters a-z and digits with single spaces; null under four words."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))
    return F.when(F.size(F.split(t, " ")) >= 4, t)


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/\s?#]+") & (F.length(url) <= 1024) & ~url.rlike(r"\s"), F.lit(False))


def clean_text(html: Column) -> Column:
    """Tags to spaces, the common entities undone, white space collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


#: What a short announcement is about, by the phrases it holds; the first rule that holds counts (fixed values).
ANNOUNCEMENTS = [
    ("acquisition", ("to acquire", "acquisition of", "has acquired", "merger", "to be acquired")),
    ("licensing", ("license agreement", "licensing agreement", "exclusive license", "out-license", "in-license")),
    ("regulatory", ("fda approval", "fda clearance", "breakthrough therapy", "orphan drug designation", "ema approval", "marketing authorization")),
    ("clinical_milestone", ("topline results", "primary endpoint", "enrolled its first patient", "dosed the first patient", "phase 3 trial met", "interim analysis")),
    ("funding", ("series a", "series b", "series c", "raised $", "financing round", "ipo", "private placement")),
    ("partnership", ("strategic partnership", "collaboration agreement", "joint venture", "partner with", "to co-develop")),
]


def first_rule(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """The first rule of which a phrase occurs in the text."""
    low, out = F.lower(text), F.lit(otherwise)
    for name, phrases in reversed(rules):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def sample_confidence(n: Column) -> Column:
    return 1 - F.exp(-n / 25.0)


def freshness(age_days: Column, half_life: float = 30.0) -> Column:
    """1 for the future, 0 for unknown, halved every half-life."""
    return F.coalesce(F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life)), F.lit(0.0))


def letters_only(text: Column) -> Column:
    """Lower case, everything but a-z and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def grounded(names: Column, text: Column) -> Column:
    """Those of the names that the text holds, whatever the case and marks."""
    hay = letters_only(text)
    return F.filter(names, lambda n: (letters_only(n) != "") & F.contains(hay, letters_only(n)))


def duplicate_keys(doi: Column, pmid: Column, year: Column, title: Column) -> Column:
    """Array of (kind, key) in the order they are tried; what a record lacks gives no key."""
    keys = F.array(
        F.struct(F.lit("doi").alias("kind"), normalize_doi(doi).alias("key")),
        F.struct(F.lit("pmid").alias("kind"), F.nullif(F.trim(pmid), F.lit("")).alias("key")),
        F.struct(F.lit("title").alias("kind"), F.concat(year.cast("string"), F.lit(":"), normalize_title(title)).alias("key")),
    )
    return F.filter(keys, lambda k: k["key"].isNotNull())


def redacted(text: Column) -> Column:
    """Values after words that name a secret, and bearer tokens, as ***."""
    t = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)[\"']?\s*[=:]\s*[\"']?)[^\s\"',&]+", "$1***")
    return F.regexp_replace(t, r"(?i)(bearer\s+)[^\s\"',]+", "$1***")


def name_key(text: Column) -> Column:
    """The form under which a configured name is looked up: lower case, marks and spaces as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def listed(text: Column) -> Column:
    """The items of a comma, semicolon or line list, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, "[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")

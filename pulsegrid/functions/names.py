"""Organization names: folding, legal endings, match keys, kinds, similarity. Built-in expressions but for the subsequence ratio."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Legal forms, short forms, words of a line of business, and words that tell a kind of organization.
LEGAL = (
    "inc", "incorporated", "ltd", "limited", "llc", "lp", "llp", "plc", "corp", "corporation", "co", "company", "gmbh", "mbh", "ag", "kgaa", "kg", "sa", "sas", "sarl", "spa", "srl", "nv", "bv",
    "ab", "as", "asa", "oy", "oyj", "aps", "kk", "pte", "pty", "pvt", "sdn", "bhd", "cv", "ou", "doo", "dd", "sro", "jsc", "pjsc", "ulc", "holdings", "holding",
)
SHORT = {
    "pharma": "pharmaceuticals", "pharms": "pharmaceuticals", "pharm": "pharmaceuticals", "pharmaceutical": "pharmaceuticals", "tx": "therapeutics", "thera": "therapeutics", "ther": "therapeutics",
    "therapeutic": "therapeutics", "bio": "biosciences", "biosci": "biosciences", "bioscience": "biosciences", "biotech": "biotechnology", "lab": "laboratories", "labs": "laboratories",
    "laboratory": "laboratories", "gen": "genetics", "genetic": "genetics", "sci": "sciences", "science": "sciences", "tech": "technologies", "technology": "technologies", "med": "medical",
    "medicine": "medical", "res": "research", "inst": "institute", "intl": "international", "natl": "national", "univ": "university", "dept": "department", "ctr": "center", "centre": "center",
    "hosp": "hospital", "st": "saint", "svcs": "services", "svc": "services",
}
DIVISIONS = (
    "oncology", "neurology", "immunology", "genetics", "diagnostics", "devices", "vaccines", "laboratories", "biosciences", "biotechnology", "ventures", "capital", "consumer", "animal", "veterinary",
    "digital", "services", "solutions", "manufacturing", "research", "development", "international", "global", "americas", "europe", "asia", "japan", "china", "india", "canada", "australia",
    "sciences", "technologies", "therapeutics", "pharmaceuticals", "medical", "health", "healthcare", "group",
)
UNIVERSITY = ("university", "univ", "universite", "universitat", "universidad", "universita", "universiteit", "college", "polytechnic", "hochschule", "ecole", "academy", "school of", "faculty of")
HOSPITAL = ("hospital", "hopital", "krankenhaus", "clinic", "klinik", "clinica", "medical center", "medical centre", "medical ctr", "health system", "infirmary", "cancer center", "cancer centre", "policlinico")
GOVERNMENT = ("ministry", "research council", "council of", "national institute", "national institutes", "federal", "government", "authority", "bureau", "commission", "public health", "administration", "agency")
NONPROFIT = ("foundation", "charity", "charitable", "association", "society", "nonprofit")
COMPANY = ("pharmaceutical", "pharma", "therapeutics", "biosciences", "bioscience", "biotech", "laboratories", "labs", "diagnostics", "medicines", "medtech", "genomics", "genetics", "biologics", "biopharma")
RESEARCH = ("institute", "research institute", "research center", "research centre")
COMPANY_ENDS = ("bio", "tx", "gen", "dx", "rx", "sci", "labs", "pharma")
GATHERINGS = ("center", "centre", "group", "consortium", "network")
#: Confidence of each kind of organization told by a word, in the order they are tried.
KINDS = ((UNIVERSITY, "university", 0.9), (HOSPITAL, "hospital", 0.9), (GOVERNMENT, "government", 0.85), (NONPROFIT, "nonprofit", 0.8), (COMPANY, "company", 0.8))
#: Confidence of a match by each kind of key, in the order they are tried.
KEY_CONFIDENCE = {"exact": 1.0, "normalized": 0.98, "expanded": 0.95, "compact": 0.92, "expanded_compact": 0.9}


def _folds() -> tuple[str, str]:
    """Characters that compatibility decomposition turns into one other character, once marks are dropped; from the rule, not a table."""
    came, went = [], []
    for code in (*range(0xA1, 0x2FFF), *range(0xF900, 0xFB00), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            came.append(c)
            went.append(plain)
    return "".join(came), "".join(went)


CAME, WENT = _folds()
#: Letters that fold to two.
DOUBLE = (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "..."), ("™", "tm"))


def folded(text: Column) -> Column:
    """Lower case without accents or compatibility forms; combining marks go."""
    t = F.lower(text)
    for a, b in DOUBLE:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(t, CAME, WENT), r"\p{Mn}+", "")


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned(name: Column) -> Column:
    """Folded, & as and, other marks as spaces."""
    return spaced(F.regexp_replace(F.replace(folded(spaced(name)), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " "))


def legal_endings(name: Column) -> Column:
    """The legal forms at the end of a name, as an array; at least one word stays."""
    return F.filter(F.split(F.trim(F.regexp_extract(cleaned(name), "((?: (?:" + "|".join(LEGAL) + "))+)$", 1)), " "), lambda w: w != "")


def normalize_org(name: Column) -> Column:
    """Cleaned, without legal forms and a then trailing ``and``, without a leading ``the``."""
    n = F.regexp_replace(cleaned(name), "(?: (?:" + "|".join(LEGAL) + "))+$", "")
    return F.regexp_replace(F.regexp_replace(n, "(?: and)+$", ""), "^the ", "")


def expanded(normalized: Column) -> Column:
    """Short forms written out, word by word."""
    words = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    return F.array_join(F.transform(F.split(normalized, " "), lambda w: F.coalesce(F.element_at(words, w), w)), " ")


def compact(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-z0-9]", "")


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, " "), lambda w: w != "")), " ")


def match_keys(raw: Column, normalized: Column, full: Column) -> Column:
    """Array of (position, method, key): the keys to try in order, each key once, at its first place."""
    keys = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("method"), k.alias("key")) for i, (m, k) in enumerate(zip(KEY_CONFIDENCE, (F.lower(spaced(raw)), normalized, full, compact(normalized), compact(full)), strict=True))])
    first = F.transform(keys, lambda k: F.struct(k["position"].alias("position"), k["method"].alias("method"), k["key"].alias("key"), F.array_position(F.transform(keys, lambda x: x["key"]), k["key"]).alias("first")))
    return F.transform(F.filter(first, lambda k: (k["key"] != "") & (k["first"] == k["position"] + 1)), lambda k: F.struct(k["position"].alias("position"), k["method"].alias("method"), k["key"].alias("key")))


def display_quality(text: Column) -> Column:
    """(mixed case, no abbreviated word, no legal ending, length): the larger, the more presentable."""
    letters = text.rlike(r"\p{L}")
    last = F.regexp_replace(F.element_at(F.split(spaced(F.lower(text)), " "), -1), "^[.,]+|[.,]+$", "")
    return F.struct(
        (letters & (F.upper(text) != text) & (F.lower(text) != text)).cast("int").alias("mixed"),
        (~text.rlike(r"\b[A-Za-z]{1,4}\.")).cast("int").alias("spelled_out"),
        (~last.isin(*LEGAL)).cast("int").alias("plain"),
        F.length(text).alias("length"),
    )


def found_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words that begins at a word's start; null if none does."""
    return F.coalesce(*[F.when(text.rlike(rf"\b{w}"), w) for w in words])


def classify_org(name: Column) -> Column:
    """(kind, confidence, reason) by ordered rules."""
    text = spaced(F.lower(name))
    last = F.regexp_replace(F.element_at(F.split(text, " "), -1), r"^\.+|\.+$", "")
    kind = lambda k, c, reason: F.struct(F.lit(k).alias("kind"), F.lit(c).cast("double").alias("confidence"), reason.alias("reason"))
    quoted = lambda before, w: F.concat(F.lit(before + " '"), w, F.lit("'"))
    endings = legal_endings(name)
    rules = [(found_word(text, words).isNotNull(), kind(k, c, quoted("matched", found_word(text, words)))) for words, k, c in KINDS]
    rules.append((F.contains(text, F.lit(" ")) & last.isin(*COMPANY_ENDS), kind("company", 0.6, quoted("shortened company name", last))))
    rules.append((found_word(text, RESEARCH).isNotNull(), kind("nonprofit", 0.5, quoted("matched", found_word(text, RESEARCH)))))
    rules.append((F.size(endings) > 0, kind("company", 0.75, quoted("legal suffix", F.element_at(endings, -1)))))
    out = kind("unknown", 0.3, F.lit("no identifying words"))
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def looks_like_org(name: Column) -> Column:
    text = spaced(F.lower(name))
    words = [w for group in (COMPANY, UNIVERSITY, HOSPITAL, NONPROFIT, GOVERNMENT, RESEARCH, GATHERINGS) for w in group]
    return text.rlike(r"\b(?:" + "|".join(words) + ")") | (F.size(legal_endings(name)) > 0)


#: What marks a part of an affiliation as an address, and names of places that are no organization.
ADDRESS = r"(?i)\b(department|dept|division|school|faculty|institute of|p\.?o\.? box|street|str\.|avenue|road|building|floor|suite|campus|[0-9]{4,}|[a-z]{1,2}[0-9]{1,2} ?[0-9][a-z]{2})\b"
PLACES = ("usa", "u.s.a", "united states", "uk", "u.k", "united kingdom", "england", "scotland", "wales", "germany", "deutschland", "france", "italy", "spain", "japan", "china", "india", "canada", "australia", "switzerland", "netherlands", "belgium", "sweden", "denmark", "norway", "finland", "ireland", "israel", "korea", "singapore", "brazil", "mexico", "poland", "austria", "portugal", "greece", "turkey", "russia")


def split_affiliation(text: Column, most: int = 3) -> Column:
    """Organization names in an affiliation: parts between ; | and commas, legal endings joined back, addresses and places dropped.

    Up to ``most`` parts that look like organizations, else the first part.
    """
    plain = F.regexp_replace(text, r"[\w.+-]+@[\w-]+\.[\w.]+", " ")
    # a comma before a legal ending is no border
    dotted = "|".join(r"\.?".join(w) for w in LEGAL)
    held = F.regexp_replace(plain, r"(?i),(\s*(?:" + dotted + r")\.?\s*)(?=[,;|]|\.?\s*$)", "\u0001$1")
    parts = F.transform(F.split(held, "[;|,]"), lambda p: F.replace(F.regexp_replace(p, r"^[ .]+|[ .]+$", ""), F.lit("\u0001"), F.lit(",")))
    usable = F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike("[A-Za-z]{3}") & ~p.rlike(ADDRESS) & ~F.lower(p).isin(*PLACES))
    named = F.filter(usable, looks_like_org)
    return F.when(F.size(named) > 0, F.slice(named, 1, most)).otherwise(F.slice(usable, 1, 1))


def distinguishing(words_a: Column, words_b: Column) -> Column:
    """Whether two names' words differ by a word that tells a line of business."""
    apart = F.array_union(F.array_except(words_a, words_b), F.array_except(words_b, words_a))
    return F.arrays_overlap(apart, F.array(*[F.lit(w) for w in DIVISIONS]))


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2 * longest common subsequence / sum of lengths; 1 for two empty texts, null if either is null."""
    for left, right in batches:
        yield pd.Series([None if a is None or b is None else 1.0 if not a and not b else 2 * _subsequence(a, b) / (len(a) + len(b)) for a, b in zip(left, right, strict=True)], dtype="float64")

"""Personal data: patterns propose spans, check sums confirm, nearby words adjust.

Only DataFrame functions run: one pass over the texts, no shuffle. The base
kinds (email, ip, card, phone) are always reported as they match. The method
adds kinds that need more: ``iban`` must pass mod-97; ``shortcard`` (13 to 15
digits passing Luhn) and ``idno`` (three, two and four digits) must be made
likely by words near them. ``scores`` gives every span's score: what its kind
and its check sum are worth, and more or less for the words around it.

An account number is as long as its country's are and ends where a word ends; what
follows it may look alike.

Results: a null or empty text has no spans. Rows are told one by one: rows with equal
or null ids and repeated rows are each returned, an empty table gives an empty
result, other columns are not read. Places are running sums in two steps and
contexts come from pieces, so a long text with many spans takes time in
proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.spans import around, matches, pieces, told

#: Patterns by kind. A run that can't start a match is not tried again at each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of 13 digits and more: shorter ones are no card of any kind.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The head of an account number; what may follow is looked at, not taken, as words after it look alike.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+))"
IDNO = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Characters of an account number by country (fixed values).
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words that make a kind likelier, what a match is worth without them and with them, and what is reported.
CONTEXT = {
    "email": ("mail|contact|write|correo|courriel|kontakt", 0.9, 1.0),
    "ip": ("server|host|addr|login|client|ip ", 0.6, 0.9),
    "card": ("card|visa|master|amex|credit|debit|payment|tarjeta|carte|karte", 0.8, 1.0),
    "phone": ("phone|call|tel|mobile|fax|whatsapp|telefon", 0.6, 0.9),
    "iban": ("iban|account|bank|konto|compte|cuenta|transfer", 0.8, 1.0),
    "shortcard": ("card|visa|master|amex|credit|debit|payment|tarjeta|carte|karte", 0.4, 0.8),
    "idno": ("ssn|social|security|tax|passport|identity|insurance", 0.3, 0.8),
}
REPORTED = 0.5

_DIGITS = "regexp_replace(x.hit, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn."""
    n = f"char_length({digits})"
    d = f"cast(substring({digits}, {n} - i, 1) as int)"
    return f"(aggregate(sequence(0, {n} - 1), 0, (t, i) -> t + case when i % 2 = 0 then {d} when {d} >= 5 then 2 * {d} - 9 else 2 * {d} end) % 10 = 0)"


def mod97(code: str) -> str:
    """SQL: whether an account number passes mod-97 (the first four characters go last, letters count from 10)."""
    moved = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    at = f"instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring({moved}, i, 1)) - 1"
    return f"(aggregate(sequence(1, char_length({code})), 0, (t, i) -> if({at} < 10, t * 10 + {at}, t * 100 + {at}) % 97) = 1)"


def accounts(found: str) -> str:
    """SQL: account numbers of the heads in ``found``, as long as their country's are, to a word's end, if they pass mod-97."""
    lengths = "map(" + ", ".join(f"'{c}', {n}" for c, n in LENGTHS.items()) + ")"
    code = "replace(concat(x.hit, x.part), ' ', '')"
    whole = f"transform(filter({found}, x -> element_at({lengths}, substring(x.hit, 1, 2)) <= char_length({code})), x -> struct(x.s as s, concat(x.hit, x.part) as raw, element_at({lengths}, substring(x.hit, 1, 2)) as n))"
    # where the n-th character that is no space stands
    at = "aggregate(sequence(1, char_length(x.raw)), struct(0 as seen, 0 as at), (a, i) -> if(a.seen = x.n, a, struct(a.seen + if(substring(x.raw, i, 1) = ' ', 0, 1) as seen, i as at)), a -> a.at)"
    cut = f"transform({whole}, x -> struct(x.s as s, {at} as n, x.raw as raw))"
    clean = "replace(substring(x.raw, 1, x.n), ' ', '')"
    good = f"filter({cut}, x -> substring(x.raw, x.n + 1, 1) in ('', ' ') and {mod97(clean)})"
    return f"transform({good}, x -> struct(x.s as s, x.s + x.n as e, substring(x.raw, 1, x.n) as hit, '' as part))"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, scores of every text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "idno": IDNO}
    d = d.select("doc_id", "text", *[matches("text", p, 1 if k == "iban" else 0).alias(f"m_{k}") for k, p in patterns.items()])
    part = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
    right = {
        "email": "true",
        "ip": f"forall(split(x.hit, '[.]'), p -> p rlike '{part}')",
        "card": f"char_length({_DIGITS}) between 16 and 19 and {luhn(_DIGITS)}",
        "phone": f"char_length({_DIGITS}) between 8 and 15",
        "iban": "true",
        "shortcard": f"char_length({_DIGITS}) between 13 and 15 and {luhn(_DIGITS)}",
        "idno": "true",
    }
    source = {k: "card" if k == "shortcard" else k for k in right}
    d = d.select("doc_id", "text", *[F.expr(f"filter({accounts('m_iban') if k == 'iban' else f'm_{source[k]}'}, x -> {ok})").alias(f"v_{k}") for k, ok in right.items()])
    d = d.withColumn("pieces", pieces("text", " + ".join(f"size(v_{k})" for k in right) + " > 0"))
    # a context word begins where a word begins: a hotel is no tel
    scored = [
        F.expr(f"transform(v_{k}, x -> struct(x.s as s, x.e as e, if({around('pieces')} rlike '(?<![a-z])(?:{words})', {high}D, {low}D) as score))").alias(f"v_{k}")
        for k, (words, low, high) in CONTEXT.items()
    ]
    d = d.select("doc_id", *scored)
    base, added = ["email", "ip", "card", "phone"], ["iban", "shortcard", "idno"]
    d = d.select("doc_id", *[f"v_{k}" for k in base], *[F.expr(f"filter(v_{k}, x -> x.score >= {REPORTED}D)").alias(f"v_{k}") for k in added])
    joined = lambda kinds, f: "array_join(concat(" + ", ".join(f(k) for k in kinds) + "), ',')"
    spans = lambda kinds: joined(kinds, lambda k: told(k, f"v_{k}"))
    return d.select(
        "doc_id",
        *[F.size(f"v_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(spans(base)), 256).alias("base_sha256"),
        F.expr(spans(base + added)).alias("spans"),
        F.expr(joined(base + added, lambda k: f"transform(v_{k}, x -> cast(x.score as string))")).alias("scores"),
        *[F.size(f"v_{k}").cast("long").alias(f"n_{k}") for k in added],
    )


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

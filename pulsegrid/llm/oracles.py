"""DuckDB SQL with the same rows as the operators that SQL can express.

RE2 has neither look-around nor possessive repetition: the plain forms of the
patterns find the same matches (only slower on long runs).
"""

from __future__ import annotations

import re

from pulsegrid.llm import decontaminate, pii, secrets


def plain(pattern: str) -> str:
    """A pattern without possessive marks, quoted for SQL."""
    return re.sub(r"(?<=[+}])\+", "", pattern).replace("'", "''")


def spans(pattern: str, group: int = 0) -> str:
    """SQL for the list of {s, e, hit, part} of the matches in ``text``."""
    p = plain(pattern)
    hits, parts, gaps = f"regexp_extract_all(text, '{p}', 0)", f"regexp_extract_all(text, '{p}', {group})", f"string_split_regex(text, '{p}')"
    before = f"CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({hits}[1:i-1], lambda h: length(h))), 0) AS INTEGER)"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': {before}, 'e': {before} + CAST(length({hits}[i]) AS INTEGER), 'hit': {hits}[i], 'part': {parts}[i]}})"


def secrets_sql() -> str:
    kinds = secrets.KINDS
    found = " UNION ALL ".join(
        f"SELECT row, {place} AS place, '{k}' AS kind, x.s AS s, x.e AS e, sha256(x.part) AS value, len(list_distinct(string_split(x.part, ''))) AS characters FROM (SELECT row, unnest({spans(p, g)}) AS x FROM d) WHERE length(x.part) >= {least}"
        for place, (k, (p, g, least)) in enumerate(kinds.items())
    )
    base = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in secrets.BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS owner FROM documents),
f AS ({found}),
per AS (SELECT row, {base}, coalesce({text} FILTER (WHERE place < {len(secrets.BASE)}), '') AS base, coalesce({text}, '') AS spans FROM f GROUP BY ALL),
v AS (SELECT DISTINCT row, value, characters FROM f),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM v JOIN d USING (row) GROUP BY ALL),
j AS (SELECT row, count(*) FILTER (WHERE owners = 1 AND characters >= {secrets.RANDOM_CHARACTERS}) AS n_live, count(*) FILTER (WHERE owners >= {secrets.COPIED_OWNERS}) AS n_copied, max(owners) AS max_owners FROM v JOIN held USING (value) GROUP BY ALL)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(max_owners, 0) AS max_owners
FROM d LEFT JOIN per USING (row) LEFT JOIN j USING (row)"""


def decontaminate_sql() -> str:
    k, units = decontaminate.WINDOW, ", ".join(f"'{u}'" for u in decontaminate.UNITS)

    def template(table: str, key: str) -> str:
        return f"""
SELECT {key}, words, list_transform(range(1, len(core) + 1), lambda i: CASE WHEN regexp_matches(core[i], '^[0-9][0-9.,:/]*%?$') THEN '<n>' WHEN i > 1 AND regexp_matches(core[i - 1], '^[0-9][0-9.,:/]*$') AND lower(core[i]) IN ({units}) THEN '<u>'
  WHEN i > 1 AND regexp_matches(core[i], '^\\p{{Lu}}') AND NOT regexp_matches(words[i - 1], '[.!?:;]\\W*$') THEN '<p>' ELSE lower(core[i]) END) AS template
FROM (SELECT {key}, words, list_transform(words, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}%]+$', '', 'g')) AS core
  FROM (SELECT {key}, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)) WHERE len(words) > 0"""

    window = f"array_to_string(template[pos + 1:pos + {k}], chr(31))"
    slots = f"list_filter(list_transform(range(CAST(pos + 1 AS BIGINT), least(pos + {k}, len(words)) + 1), lambda j: {{'kind': template[j], 'value': regexp_replace(words[j], '[^\\p{{L}}\\p{{N}}]', '', 'g')}}), lambda s: s.kind IN ('<n>', '<u>', '<p>'))"
    return f"""
WITH i0 AS ({template("benchmark", "item_id")}), d0 AS ({template("documents", "doc_id")}),
iw AS (SELECT item_id, pos AS item_at, {window} AS w, {slots} AS slots FROM (SELECT *, unnest(range(0, greatest(len(words) - {k}, 0) + 1)) AS pos FROM i0)),
iu AS (SELECT * FROM iw WHERE len(slots) <= {decontaminate.MOST_SLOTS}),
n AS (SELECT item_id, count(DISTINCT item_at) AS n_windows FROM iu GROUP BY ALL),
dw AS (SELECT doc_id, pos, {window} AS w, {slots} AS slots FROM (SELECT *, unnest(range(0, greatest(len(words) - {k}, 0) + 1)) AS pos FROM d0)),
met AS (SELECT doc_id, item_id, item_at, pos - item_at AS shift, iu.slots AS a, dw.slots AS b FROM dw JOIN iu USING (w)),
pairs AS (SELECT DISTINCT doc_id, item_id, shift, a[j].kind AS kind, a[j].value AS x, b[j].value AS y FROM (SELECT *, unnest(range(1, len(a) + 1)) AS j FROM met)),
al AS (SELECT doc_id, item_id, shift, count(DISTINCT (kind, x)) = count(*) AS consistent, bool_or(x <> y) AS changed FROM pairs GROUP BY ALL),
ok AS (SELECT doc_id, item_id, item_at, coalesce(changed, false) AS changed FROM met LEFT JOIN al USING (doc_id, item_id, shift) WHERE coalesce(consistent, true)),
p AS (SELECT doc_id, item_id, item_at, bool_and(changed) AS changed FROM ok GROUP BY ALL),
f AS (SELECT doc_id, item_id, count(*) AS got, bool_or(changed) AS reworded FROM p GROUP BY ALL)
SELECT doc_id, item_id, got / n_windows AS coverage, got AS n_windows, reworded FROM f JOIN n USING (item_id) WHERE got / n_windows >= {decontaminate.COVERED}"""


def personal_data_sql() -> str:
    simple = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9]){12,}",
        "phone": pii.PHONE,
        "iban": r"\b[A-Z]{2}[0-9]{2}",
        "idno": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(x.hit, '[^0-9]', '', 'g')"
    luhn = f"coalesce(list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) + 1] END)), 1) % 10 = 0"
    code = "replace(x.hit, ' ', '')"
    moved = f"(substr({code}, 5) || substr({code}, 1, 4))"
    at = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({moved}, i, 1)) - 1)"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({code}) + 1), lambda i: CAST({at} AS BIGINT))), lambda t, v: CASE WHEN v < 10 THEN (t * 10 + v) % 97 ELSE (t * 100 + v) % 97 END) = 1"
    right = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.hit, '.'), lambda p: NOT regexp_matches(p, '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$'))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": mod97,
        "shortcard": f"length({digits}) BETWEEN 13 AND 15 AND {luhn}",
        "idno": "true",
    }
    near = "lower(substr(text, greatest(x.s - 48, 0) + 1, least(x.s, 48)) || ' ' || substr(text, x.e + 1, 48))"
    found = " UNION ALL ".join(
        f"SELECT row, {place} AS place, '{k}' AS kind, x.s AS s, x.e AS e, CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{pii.CONTEXT[k][0]})') THEN CAST({pii.CONTEXT[k][2]} AS DOUBLE) ELSE CAST({pii.CONTEXT[k][1]} AS DOUBLE) END AS score FROM m_{'card' if k == 'shortcard' else k} WHERE {ok}"
        for place, (k, ok) in enumerate(right.items())
    )
    # account numbers: the head with what may follow it, cut where the country's length ends, if a word ends there
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.LENGTHS.items()) + "}"
    part = "(x.hit || regexp_extract(substr(text, x.e + 1, 61), '^((?:\\x20?[A-Z0-9]){11,30})', 1))"
    ends = "list_filter(range(15, length(part) + 1), lambda i: length(replace(substr(part, 1, CAST(i AS INTEGER)), ' ', '')) = n)[1]"
    account = f"""heads AS (SELECT row, text, x, {part} AS part, {lengths}[x.hit[1:2]] AS n FROM (SELECT row, text, unnest({spans(simple['iban'])}) AS x FROM d)),
tails AS (SELECT row, text, x.s AS s, part, CAST({ends} AS INTEGER) AS n FROM heads WHERE length(part) > 14),
m_iban AS (SELECT row, text, {{'s': s, 'e': s + n, 'hit': substr(part, 1, n)}} AS x FROM tails WHERE n IS NOT NULL AND substr(part, n + 1, 1) IN ('', ' '))"""
    matched = ", ".join(account if k == "iban" else f"m_{k} AS (SELECT row, text, unnest({spans(p)}) AS x FROM d)" for k, p in simple.items())
    base, added = ["email", "ip", "card", "phone"], ["iban", "shortcard", "idno"]
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in base + added)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), {matched},
f AS (SELECT * FROM ({found}) WHERE place < 4 OR score >= {pii.REPORTED}),
per AS (SELECT row, {counts}, {text} FILTER (WHERE place < 4) AS base, {text} AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY place, s) AS scores FROM f GROUP BY ALL)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base + added)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN per USING (row)"""


ORACLES = {"op3_pii": personal_data_sql(), "op5_decontaminate": decontaminate_sql(), "op7_secrets": secrets_sql()}

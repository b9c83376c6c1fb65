"""Operators that stand on more than one query: dates, names, similarity joins, clusters, quantiles, sinks."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import names as N
from pulsegrid.functions import text as X
from pulsegrid.operators import activity as A
from pulsegrid.operators import resolution as R
from pulsegrid.operators.density import clusters
from pulsegrid.operators.graph import connected
from pulsegrid.operators.nested import flatten
from pulsegrid.operators.quantiles import quantiles
from pulsegrid.sources import sinks

D = dt.date
DATES = {
    "2026-03-15": D(2026, 3, 15), "2026-03": D(2026, 3, 1), "2026": D(2026, 1, 1), "2026/03/15": D(2026, 3, 15), "2026-3-5": D(2026, 3, 5), "2026-08-20T10:30:00Z": D(2026, 8, 20),
    "2026-08-20T10:30:00+00:00": D(2026, 8, 20), "2026-05-01T23:00:00-05:00": D(2026, 5, 2), "2024 Mar 5": D(2024, 3, 5), "2024 Mar": D(2024, 3, 1), "2024 Mar-Apr": D(2024, 3, 1), "2024 Mar - Apr": D(2024, 3, 1),
    "2023 Winter": D(2023, 12, 1), "2023 Spring": D(2023, 3, 1), "Sept 2025": D(2025, 9, 1), "March 2026": D(2026, 3, 1), "15 March 2026": D(2026, 3, 15), "March 15, 2026": D(2026, 3, 15), "Mar. 15, 2026": D(2026, 3, 15),
    "  2026-03-15  ": D(2026, 3, 15), "2026-02-30": D(2026, 2, 28), "2024-02-31": D(2024, 2, 29), "2026-03-15 10:00": D(2026, 3, 15), "2024 Marchpane": D(2024, 1, 1),
    "": None, "   ": None, "garbage": None, "not a date": None, "1850": None, "2500": None, "2026-13-01": None, "Marchpane 2024": None, "42": None, "2026-0315": None, None: None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", X.normalize_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == DATES


def test_names_and_kinds(spark):
    names = {
        "Zentavia Pharma, Inc.": ("zentavia pharma", "zentavia pharmaceuticals", "company"),
        "The ÉCOLE & Cie S.A.": ("ecole and cie s a", "ecole and cie s a", "unknown"),
        "ＡＣＭＥ Ｌａｂｓ GmbH & Co. KG": ("acme labs gmbh", "acme laboratories gmbh", "company"),
        "Straße Institute": ("strasse institute", "strasse institute", "nonprofit"),
        "Bioethics Works": ("bioethics works", "bioethics works", "unknown"),
        "Nexoria Gen": ("nexoria gen", "nexoria genetics", "company"),
        "Holdings": ("holdings", "holdings", "unknown"),
        "Mercy Hospital Foundation": ("mercy hospital foundation", "mercy hospital foundation", "hospital"),
        "Orvexa Ltd": ("orvexa", "orvexa", "company"),
    }
    df = spark.createDataFrame([(n,) for n in names], "raw string")
    got = df.withColumn("n", N.normalize_org(F.col("raw"))).select("raw", "n", N.expanded(F.col("n")).alias("full"), N.classify_org(F.col("raw"))["kind"].alias("kind")).collect()
    assert {r["raw"]: (r["n"], r["full"], r["kind"]) for r in got} == names
    text = "Fixture Oncology, Inc., Boston, MA, USA. a@b.org; Dept. of Medicine, University of Harrowgate, 12345 Elm Street"
    assert spark.createDataFrame([(text,)], "t string").select(N.split_affiliation(F.col("t")).alias("x")).first()["x"] == ["Fixture Oncology, Inc", "University of Harrowgate"]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_similar_texts_equal_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choices("abcde fg", k=rnd.randint(1, 24))).strip() or "a" for _ in range(120)]
    left = [b[: rnd.randrange(len(b) + 1)] + rnd.choice("abcxy") + b[rnd.randrange(len(b)) :] for b in base] + base[:30]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r["a"], r["b"]): r["score"] for r in R.similar(frame(left, "a"), frame(base, "b"), 0.8).collect()}
    want = {(a, b): s for a, b in itertools.product(set(left), set(base)) if (s := 2 * subsequence(a, b) / (len(a) + len(b))) >= 0.8}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want) and len(want) > 100


def test_resolution_order(spark):
    known = spark.createDataFrame([(1, "Zentavia Pharmaceuticals"), (2, "Orvexa Biosciences Inc"), (3, "Kalimed Research"), (4, "Kalimed Oncology")], "org_id long, name string")
    says = {
        "ZENTAVIA PHARMA INC": ("expanded", 1, False), "Zentavia": ("prefix", 1, True), "Kalimed": ("ambiguous", None, True), "Orvexa Bioscience": ("expanded", 2, False),
        "Orvexa Biosciencs Foundation": ("created", None, False), "Zentavia Pharmaceuticls": ("created", None, True), "Zentaviaa Pharmaceuticals": ("fuzzy", 1, False), "Orvexa Laboratories": ("created", None, False), "Nobody": ("created", None, False),
    }
    got = R.resolve(spark.createDataFrame([(n,) for n in [*says, " ", None, "Nobody"]], "raw string"), known).collect()
    assert {r["raw"]: (r["method"], r["org_id"], r["review"]) for r in got} == says


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    v = np.concatenate([c + 0.35 * rng.normal(size=(n, 16)) for c, n in zip(centres, (60, 30, 8, 4, 3, 1), strict=True)] + [rng.normal(size=(25, 16))])
    ids = rng.permutation(len(v)) + 10
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 1 - 0.35
    core = near.sum(1) >= 5
    root = {int(i): int(i) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(v)), 2):
        if core[i] and core[j] and near[i, j]:
            a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
            root[b] = a
    want = {int(ids[i]): (find(int(ids[i])) if core[i] else min((find(int(ids[j])) for j in np.flatnonzero(near[i] & core)), default=None), bool(core[i])) for i in range(len(v))}
    rows = [(int(i), [float(y) for y in x]) for i, x in zip(ids, v, strict=True)] + [(1, None), (2, [0.0] * 16)]
    got = clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.35, 5).collect()
    assert {r["id"]: (r["cluster"], r["core"]) for r in got} == want | {1: (None, False), 2: (None, False)}
    assert clusters(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0.35, 5).collect() == []


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(90)] + [(200, 200 + rnd.randrange(50)) for _ in range(80)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(91)) and all(c == 200 for i, c in got.items() if i >= 200)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.lognormal(size=5001)] + [("b", 2.0)] * 40 + [("c", float(i)) for i in range(10)] + [("d", None), ("c", None)]
    got = {r["k"]: (r["lo"], r["mid"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"lo": 0.05, "mid": 0.5}).collect()}
    for k in "abc":
        want = np.quantile([v for x, v in rows if x == k and v is not None], [0.05, 0.5])
        assert np.allclose(got[k], want)
    assert "d" not in got


def test_dense_series_and_links(spark):
    spine = [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]
    counts = spark.createDataFrame([("t", "a", D(2024, 2, 1), 3), ("t", "a", D(2020, 2, 1), 9), ("u", None, None, 0)], "topic string, kind string, month date, n long")
    got = {(r["topic"], r["kind"], r["ago"]): r["n"] for r in A.dense(counts, ["topic"], "kind", ("a", "b"), spine, ["n"]).collect()}
    assert len(got) == 12 and got["t", "a", 1] == 3 and sum(got.values()) == 3
    lines = spark.createDataFrame([(1, 5, "x", 0.5, "t", "m", 0.9), (1, 5, "x", 0.7, "t", "m", 0.8), (1, 5, "y", 0.1, "u", "m", 1.0)], "record_id long, org_id int, relationship string, c_org double, topic string, method string, c_topic double")
    r = A.record_links(lines).first()
    assert [(o["org_id"], round(o["w"], 9)) for o in r["orgs"]] == [(5, 0.8)] and {t["topic"]: t["w"] for t in r["topics"]} == {"t": 0.9, "u": 1.0}


def test_nested_metrics(spark):
    text = '{"a": {"b": {"c": 1}, "l": [1, 2]}, "t": true, "s": "x", "n": null}'
    got = {r["path"]: r["value"] for r in flatten(spark.createDataFrame([(1, text)], "id int, m string"), "m").collect()}
    assert got == {"a.b.c": "1", "a.l": "1, 2", "t": "true", "s": "x", "n": None}


def test_sinks(spark, tmp_path):
    stored = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "e", "c")], "id int, day string, v string")
    incoming = spark.createDataFrame([(1, "d", "a"), (4, "d", "x"), (4, "d", "y")], "id int, day string, v string")
    got = {(r["id"], r["v"], r["action"]) for r in sinks.replaced(stored, incoming, ["id", "day"], ["v"], ["day"]).collect()}
    assert {(1, "a", "unchanged"), (2, "b", "delete"), (3, "c", "keep")} < got and len(got) == 4
    last = spark.createDataFrame([(1, 2, "late"), (1, 1, "early")], "id int, at int, v string")
    assert sinks.upsert(stored.select("id", "v"), last.select("id", "at", "v"), ["id"], ["v"], "at").where("id = 1").first()["v"] == "late"
    sinks.write_lines({"s": stored}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/s").count() == 3


def test_scales_by_name():
    from pulsegrid.plans.checks import method

    with pytest.raises(ValueError, match="unknown scale"):
        method("nothing")

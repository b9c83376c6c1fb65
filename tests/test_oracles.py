"""Every registered query against its SQL twin, and the rules that SQL can't state."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from pulsegrid import registry
from pulsegrid.operators import forecast as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    sql = registry.ORACLES[name]
    want = duck.sql(f"select {', '.join(cols)} from ({sql})")
    assert sorted(duck.sql(sql).columns) == cols
    assert ordered(df.select(*cols).collect()) == ordered(want.fetchall())


#: Topics and the last moment of the orders that they are linked with.
ODD_TOPICS = {
    "one": {"A": "2100-01-01"},
    "alike": {"A": "2100-01-01", "B": "2100-01-01"},
    "one is old": {"A": "2100-01-01", "B": "2100-01-01", "C": "1996-01-01"},
    "none": {},
}


@pytest.mark.parametrize("topics", ODD_TOPICS.values(), ids=ODD_TOPICS)
def test_rank_correlations_of_odd_topics(spark, sf_dir, tmp_path, topics):
    con = duckdb.connect()
    con.execute("create table kinds (p_type varchar, until timestamp, k bigint)")
    for k, (name, until) in enumerate(topics.items(), 1):
        con.execute("insert into kinds values (?, ?, ?)", [name, until, k])
    for t in TABLES:
        rows = f"select * from '{sf_dir}/{t}.parquet'"
        if t == "part":
            rows = f"select s.* replace (k as p_partkey, kinds.p_type as p_type) from (select * from '{sf_dir}/part.parquet' limit 1) s, kinds"
        if t == "lineitem":
            rows = f"select l.* replace (k as l_partkey) from '{sf_dir}/lineitem.parquet' l join '{sf_dir}/orders.parquet' on o_orderkey = l_orderkey join kinds on o_orderdate < until"
        con.execute(f"copy ({rows}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("ev_lowsample", "m_spearman", "m_rank_stability"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
        assert ordered(df.collect()) == ordered(want), name


def test_models(spark, sf_dir):
    rows = registry.QUERIES["fc_models"](spark, sf_dir).collect()
    assert {r["model"] for r in rows} == {"holt", "holt_winters", "arima"} and all(r["predicted"] >= 0 for r in rows)


def test_smoothing_follows_a_line_and_a_season():
    line = np.arange(30.0)
    assert abs(P.holt_values(line, 1)[0][0] - 30) < 2
    wave = np.tile(np.arange(12.0), 4)
    assert np.abs(P.holt_values(wave, 12, 12)[0] - np.arange(12)).max() < 2
    assert np.allclose(P.arima(np.full(20, 5.0), 3), 5) and np.allclose(P.arima(line, 3), [30, 31, 32], atol=0.5)


def test_models_are_chosen_by_their_backtest(spark):
    rows = [("wave", f"{2020 + i // 12}-{i % 12 + 1:02d}-01", float(i % 12)) for i in range(48)] + [("flat", f"{2020 + i // 12}-{i % 12 + 1:02d}-01", 5.0) for i in range(30)] + [("short", f"2020-{i + 1:02d}-01", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "topic string, m string, v double").selectExpr("topic", "date(m) as month", "v")
    got = {(r["topic"], r["step"]): r for r in P.selected(df, "topic").collect()}
    assert got["wave", 1]["model"] == "seasonal_naive" and [got["wave", h]["predicted"] for h in (1, 2)] == [0.0, 1.0]
    assert got["flat", 1]["model"] == "naive" and got["flat", 1]["metric"] == 0.0
    assert got["short", 1]["model"] == "naive" and got["short", 1]["metric"] is None


def test_kendall_equals_all_pairs():
    import pandas as pd

    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 40):
        a, b = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float)
        i, j = np.triu_indices(n, 1)
        s, t = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        below = math.sqrt((s * s).sum() * (t * t).sum())
        got = next(iter(P.kendall([pd.DataFrame({"x": [[{"a": x, "b": y} for x, y in zip(a, b, strict=True)]]})])))["kendall"][0]
        assert math.isnan(got) if not below else math.isclose(got, (s * t).sum() / below, abs_tol=1e-12)


def test_percentile_rules(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators.cohort import percentile

    def of(values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").withColumn("c", F.lit(1))
        return [round(r["p"], 4) for r in df.select("i", percentile(F.col("v"), ["c"]).alias("p")).orderBy("i").collect()]

    assert of([1, 2, 3]) == [16.6667, 50.0, 83.3333]
    assert of([5, 5, 9]) == [33.3333, 33.3333, 83.3333]
    assert of([4]) == [50.0] and of([2, 2]) == [50.0, 50.0] and of([1, float("nan"), 3]) == [50.0] * 3


def test_upsert_replays_change_nothing(spark):
    from pulsegrid.sources.sinks import upsert

    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n"), (4, "n")], "id int, v string")
    once = upsert(a, b, ["id"], ["v"])
    assert {r["id"]: (r["v"], r["action"]) for r in once.collect()} == {1: ("x", "keep"), 2: ("z", "update"), 3: (None, "unchanged"), 4: ("n", "insert")}
    assert {r["action"] for r in upsert(once.drop("action"), b, ["id"], ["v"]).collect()} == {"keep", "unchanged"}


def test_star_schema_marks_completion_last(spark, tmp_path):
    from pulsegrid.sources.sinks import write_star_schema

    df = spark.createDataFrame([(1, "=1+1", float("inf"), True)], "id int, name string, x double, flag boolean")
    write_star_schema({"dim": df}, str(tmp_path))
    row = spark.read.option("header", True).csv(f"{tmp_path}/dim").collect()[0]
    assert (row["name"], row["x"], row["flag"]) == ("'=1+1", None, "1") and (tmp_path / "_complete").exists()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from pulsegrid.streaming import windows as S

    src = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(src))
    S.run_available(S.tumbling(S.events(spark, str(src))), "tumbled", str(tmp_path / "ck"))
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("tumbled").collect()}
    batch = S.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value"))
    assert got == {(r["start"], r["event_type"], r["n"]) for r in batch.collect()}

"""Density clusters of vectors by cosine distance, exact, without lists of all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.graph import connected, written

#: Vectors that name the cells (a bounded sample; any choice gives the same clusters), and vectors of a block.
PIVOTS, BLOCK = 64, 512


def _unit(rows) -> np.ndarray:
    v = np.vstack([np.asarray(x, float) for x in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clusters(df: DataFrame, id_col: str, vec_col: str, reach: float, least: int) -> DataFrame:
    """id, cluster (smallest core id; null for noise), core of every vector; null, zero and odd vectors are noise.

    A vector lives in the cell of its nearest pivot. Angles obey the triangle
    inequality, so it can be within reach only of vectors in cells whose pivot is no
    farther than the cell's radius and the reach together; it visits these. Blocks
    of a cell's inhabitants and visitors meet: once to count neighbours, once to
    join cores, of which each meeting gives a spanning forest only.
    """
    angle = float(np.arccos(1 - reach))
    e = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null").dropDuplicates(["id"])
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = written(e.where(sound), "vectors")
    pivots = [r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    if not pivots:
        return e.select("id", F.lit(None).cast("long").alias("cluster"), F.lit(False).alias("core"))
    centres = _unit(pivots)

    def homes(parts):
        for p in parts:
            if len(p):
                a = np.arccos(np.clip(_unit(p["v"]) @ centres.T, -1, 1))
                yield pd.DataFrame({"id": p["id"], "v": p["v"], "home": a.argmin(1).astype("int32"), "away": a.min(1), "angles": list(a)})

    placed = written(good.mapInPandas(homes, "id long, v array<double>, home int, away double, angles array<double>"), "cells")
    radius = placed.groupBy("home").agg(F.max("away").alias("radius"))
    near = F.transform("angles", lambda a, i: F.struct(i.alias("cell"), a.alias("angle")))
    visits = placed.select("id", "v", F.explode(near).alias("x")).select("id", "v", F.col("x.cell").alias("cell"), "x.angle")
    visits = visits.join(F.broadcast(radius.withColumnRenamed("home", "cell")), "cell").where(F.col("angle") <= F.col("radius") + angle + 1e-9)

    def blocks(rows: DataFrame, name: str, *more: str) -> DataFrame:
        count = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        rows = rows.join(F.broadcast(count), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "n"))
        return rows.groupBy("cell", F.col("block").alias(f"{name}_block")).agg(*[F.collect_list(F.struct("id", "v", *more)).alias(name)])

    def meeting(inside: DataFrame, outside: DataFrame) -> DataFrame:
        return blocks(inside, "ins").join(blocks(outside, "outs"), "cell").select("ins", "outs")

    inside = placed.select("id", "v", F.col("home").alias("cell"))

    def count(parts):
        for p in parts:
            for ins, outs in zip(p["ins"], p["outs"], strict=True):
                hit = _unit([x["v"] for x in outs]) @ _unit([x["v"] for x in ins]).T >= 1 - reach - 1e-12
                yield pd.DataFrame({"id": [x["id"] for x in outs], "n": hit.sum(1)})

    degree = meeting(inside, visits.select("id", "v", "cell")).mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    cores = written(degree.select("id", (F.col("n") >= least).alias("core")), "cores")

    def join(parts):
        for p in parts:
            for ins, outs in zip(p["ins"], p["outs"], strict=True):
                hit = _unit([x["v"] for x in outs]) @ _unit([x["v"] for x in ins]).T >= 1 - reach - 1e-12
                a, b = (np.array([x["id"] for x in s]) for s in (outs, ins))
                kept = []
                root: dict[int, int] = {}

                def find(x, root=root):
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                for i in np.flatnonzero(hit.any(1)):
                    to = b[hit[i]]
                    for y in to:
                        r, s = find(int(a[i])), find(int(y))
                        if r != s:
                            root[max(r, s)] = min(r, s)
                            kept.append((int(a[i]), int(y)))
                if kept:
                    yield pd.DataFrame(kept, columns=["a", "b"])

    told = lambda rows: rows.join(cores, "id")
    links = written(meeting(told(inside).where("core"), told(visits.select("id", "v", "cell")).where("core")).mapInPandas(join, "a long, b long"), "links")
    named = connected(links)
    solid = cores.where("core").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = written(_borders(told(inside).where("core").join(solid, "id"), told(visits.select("id", "v", "cell")).where("not core"), blocks, reach), "borders")
    out = solid.withColumn("core", F.lit(True)).unionByName(border.groupBy("id").agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False)))
    return e.select("id").join(out, "id", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def _borders(cores: DataFrame, others: DataFrame, blocks, reach: float) -> DataFrame:
    """id, cluster: for vectors that are no cores, the smallest cluster that a meeting offers."""

    def run(parts):
        for p in parts:
            for ins, outs in zip(p["ins"], p["outs"], strict=True):
                hit = _unit([x["v"] for x in outs]) @ _unit([x["v"] for x in ins]).T >= 1 - reach - 1e-12
                cluster = np.array([x["cluster"] for x in ins])
                some = hit.any(1)
                if some.any():
                    least = np.where(hit, cluster, np.iinfo(np.int64).max).min(1)
                    yield pd.DataFrame({"id": np.array([x["id"] for x in outs])[some], "cluster": least[some]})

    met = blocks(cores, "ins", "cluster").join(blocks(others, "outs"), "cell").select("ins", "outs")
    return met.mapInPandas(run, "id long, cluster long")

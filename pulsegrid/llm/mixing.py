"""Mixing sources to target weights by balanced sampling with the cube method.

Sources get their share of the wanted words by weight; none is used more than
``most`` times over, and what it can't take is shared again among the others.
That fixes how often a document of a source is taken on average: a whole part,
and a fraction that becomes an inclusion probability. The cube method rounds
these fractions: among any three undecided documents it moves the probabilities
along a direction that changes neither the expected words nor the expected
number of documents, until one of them is decided. This flight runs in blocks of
a source (so a source of any size spreads over tasks), large documents first.
Each block leaves its few undecided and its smallest documents to the landing,
where the same moves decide the largest first, the last two at most are rounded
to the sum nearest to the target, and small documents change places while that
brings it nearer still.

Draws depend on document ids and sizes only, so reruns agree.

Results: a null or empty text has size 0. A null source is a source of its own,
the last. A source without words has target 0 and takes none. Rows with equal
ids are decided separately.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.stages import cut
from pulsegrid.llm.textops import mix, slices, words

#: Weights of the sources in order, repeating; words wanted as a share of all; most times a source is used over; documents in a block; smallest documents of a block that are left for the landing.
WEIGHTS, SHARE, MOST, BLOCK_ROWS, KEPT = (5, 2, 1), 1.5, 2.0, 4096, 64


def _sizes(batches):
    for batch in batches:
        last = batch.num_columns - 1
        for i, j, data, offsets in slices(batch.column(last)):
            n = np.diff(words(data, offsets)[2])
            yield pa.RecordBatch.from_arrays([*[c[i:j] for c in batch.columns[:last]], pa.array(n.astype(np.int64))], names=["doc_id", "source", "size"])


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also ``target``: words by weight, never more than ``most`` times the source.

    Sharing the excess again until none is above its limit fills the sources in
    the order of limit / weight, so running sums tell which of them are full.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    t = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    everything = W.partitionBy()
    filled = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.select("*", (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"), F.sum("w").over(everything).alias("all_w"), F.coalesce(F.sum("cap").over(filled), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(filled), F.lit(0.0)).alias("w_before"))
    full = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("total") - F.col("cap_before"))
    t = t.select("*", full.alias("full"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0.0)))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.when(~F.col("full"), level)).alias("target"))


def flight(sizes: np.ndarray, p: np.ndarray, seed: int, land: bool = False) -> np.ndarray:
    """Probabilities after the flight: sums of p and of p * size are kept, at most two stay undecided.

    When landing, the side of a move is not drawn: it is the one that decides the largest document.
    """
    p = p.astype(np.float64).copy()
    draws = np.random.default_rng(seed).random(len(p) + 1).tolist()
    undecided = [i for i in range(len(p)) if 1e-12 < p[i] < 1 - 1e-12]
    vals, size = p.tolist(), sizes.astype(np.float64).tolist()
    hand: list[int] = []
    step = 0
    for i in undecided:
        hand.append(i)
        while len(hand) == 3:
            a, b, c = hand
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for x, d in zip(hand, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - vals[x]) / d), min(down, vals[x] / d)
                elif d < 0:
                    up, down = min(up, -vals[x] / d), min(down, (vals[x] - 1) / d)
            if land:
                hits = [max((size[x] for x, d in zip(hand, u, strict=True) if d and abs((1 - vals[x] if d * side > 0 else vals[x]) / abs(d) - far) <= 1e-9 * far), default=0.0) for side, far in ((1, up), (-1, down))]
                move = up if hits[0] >= hits[1] else -down
            else:
                move = up if draws[step % len(draws)] * (up + down) < down else -down
            step += 1
            for x, d in zip(hand, u, strict=True):
                vals[x] = min(1.0, max(0.0, vals[x] + move * d))
                if vals[x] < 1e-9:
                    vals[x] = 0.0
                elif vals[x] > 1 - 1e-9:
                    vals[x] = 1.0
            hand = [x for x in hand if 0.0 < vals[x] < 1.0]
    return np.array(vals)


def landing(sizes: np.ndarray, p: np.ndarray, owed: float) -> np.ndarray:
    """The undecided few, rounded to the sum of words nearest to what is expected of all (``owed``: words still missing)."""
    sizes = np.asarray(sizes, np.float64)
    at = np.flatnonzero((p > 0) & (p < 1))
    out = np.where(p >= 1, 1.0, 0.0)
    best = min(itertools.product((0, 1), repeat=len(at)), key=lambda x: (abs(float((sizes[at] * x).sum()) - owed), sum(x), x))
    out[at] = best
    # exchange among the smallest of the landing's documents while that brings the sum nearer
    pool = np.argsort(sizes, kind="stable")[:256]
    over = float((sizes[at] * out[at]).sum()) - owed
    for _ in range(4):
        ins, outs = pool[out[pool] == 1], pool[out[pool] == 0]
        if not len(ins) or not len(outs):
            break
        gain = np.abs(over - (sizes[ins][:, None] - sizes[outs][None, :]))
        i, j = np.unravel_index(int(gain.argmin()), gain.shape)
        if gain[i, j] >= abs(over):
            break
        over -= float(sizes[ins[i]] - sizes[outs[j]])
        out[ins[i]], out[outs[j]] = 0.0, 1.0
    return out


def _decide(last: bool):
    def run(key, table):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        sizes, p = table.column("size").to_numpy(), table.column("p").to_numpy()
        known = np.nan_to_num(ids.astype(np.float64), nan=-1.0).astype(np.int64).view(np.uint64)
        tie = mix(known, 17)
        order = np.lexsort((p, known, tie, -sizes))
        source, block = key[0].as_py(), key[1].as_py()
        name = source.encode() if source is not None else b"\xff"
        got, seed = p[order].astype(np.float64), zlib.crc32(name) * 1_000_003 + int(block) * 31 + len(ids)
        if last:
            got = flight(sizes[order], got, seed, land=True)
            got = landing(sizes[order], got, float((p * sizes).sum() - (sizes[order] * (got >= 1)).sum()))
        else:  # the smallest documents wait for the landing
            got[: max(0, len(got) - KEPT)] = flight(sizes[order][: max(0, len(got) - KEPT)], got[: max(0, len(got) - KEPT)], seed)
        out = np.empty_like(got)
        out[order] = got
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = cut(texts.mapInArrow(_sizes, "doc_id long, source string, size long"), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = cut(targets(totals, weights, share, most).withColumnRenamed("source", "s").join(totals.select(F.col("source").alias("s2"), "rows"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # one row for each source: how many copies all get, and the probability of one more
    whole = F.floor(times + 1e-12)
    goals = goals.select("s", "source_size", "target", "rows", whole.alias("base"), F.greatest(times - whole, F.lit(0.0)).alias("p"))
    joined = sized.join(goals, sized["source"].eqNullSafe(goals["s"])).drop("s")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    rows = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(5)), blocks).cast("long")).drop("rows")
    schema = "doc_id long, source string, size long, source_size long, target double, base long, p double, block long"
    rows = rows.select(*[x.split()[0] for x in schema.split(", ")])
    # an empty text takes no words either way, so it is not drawn
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0)))
    decided, undecided = rows.where("p <= 0"), rows.where("p > 0")
    state = cut(undecided.groupBy("source", "block").applyInArrow(_decide(False), schema), "flight")
    open_ = "p > 0 and p < 1"
    while True:
        decided = decided.union(state.where(f"not ({open_})"))
        left = state.where(open_)
        most_left = left.groupBy("source").count().agg(F.max("count")).first()[0]
        if not most_left:
            break
        if most_left > BLOCK_ROWS:
            again = left.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "block"), F.lit(-(-most_left // BLOCK_ROWS))))
            state = cut(again.select(*rows.columns).groupBy("source", "block").applyInArrow(_decide(False), schema), "flight")
        else:
            state = cut(left.withColumn("block", F.lit(-1).cast("long")).groupBy("source", "block").applyInArrow(_decide(True), schema), "landing")
    copies = F.col("base") + F.when(F.col("p") >= 1, 1).otherwise(0)
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), "source")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

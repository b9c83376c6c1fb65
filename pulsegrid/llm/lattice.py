"""Near-duplicate vectors by lattice hashing.

Each table projects a vector at random into a few 8-dimensional blocks and
decodes every block to its nearest point of the E8 lattice; the points together
are the vector's cell. A vector also probes the neighbouring cells that lie
nearest beyond its block borders. Pairs that meet in a cell and whose 128 sign
bits are close enough are verified by cosine in double precision.

A crowded cell (over ``CROWD`` vectors) names a hub, its smallest id. Vectors
within half the threshold angle of a hub form its ball: any two of them are
linked, by the triangle inequality of angles, so a ball of any size costs one
comparison for each member. What is left may still crowd a cell and names hubs
again, for a few rounds. Balls then meet other vectors and balls as one entry
each. Only vectors within one and a half threshold angles of a ball's hub can be
linked with a member; these meet the members in blocks, of which counts and one
edge to the ball come out, never the pairs.

Results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never meet. Rows
with equal ids count as one vector if their values are equal too.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stages import components, cut
from pulsegrid.llm.textops import mix, released

#: Tables, 8-dimensional blocks in each, scale of the projection in lattice units, neighbouring cells probed, vectors above which a cell is crowded.
TABLES, BLOCKS, SCALE, PROBES, CROWD = 14, 3, 1.1, 4, 48
#: Vectors that are worked on at once, vectors of a block, and rounds in which crowded cells name hubs.
ROWS, BLOCK, HUB_ROUNDS = 2048, 512, 3


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and move the worst coordinate where the sum is odd."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of both."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _point_key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key for lattice points (their doubles are whole)."""
    key = np.full(len(points), salt, np.uint64)
    for c in range(8):
        key = mix(key ^ (2 * points[:, c]).astype(np.int64).view(np.uint64), c + 1)
    return key


class Hashing:
    """Projections for one dimension; the same on every worker."""

    def __init__(self, dim: int):
        rng = np.random.default_rng(20_240 + dim)
        self.project = rng.normal(size=(dim, TABLES * BLOCKS * 8)) * (SCALE / math.sqrt(8))
        self.signs = rng.normal(size=(dim, 128))
        self.dim = dim

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(">i8").astype(np.int64)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each table, and the probed neighbours."""
        y = unit @ self.project
        own, near = np.zeros((len(unit), TABLES), np.uint64), np.zeros((len(unit), TABLES, PROBES), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(TABLES):
                keys, points, far = [], [], []
                for b in range(BLOCKS):
                    x = y[:, 8 * (t * BLOCKS + b) :][:, :8]
                    p = nearest_e8(x)
                    keys.append(_point_key(p, 1000 * self.dim + 10 * t + b))
                    points.append(p)
                    far.append((x - p) @ ROOTS.T)
                cell = lambda ks: mix(sum(ks[1:], ks[0]), t)  # noqa: B023, E731
                own[:, t] = cell(keys)
                every = np.concatenate(far, 1)
                best = np.argpartition(-every, PROBES - 1, axis=1)[:, :PROBES]
                for q in range(PROBES):
                    block, root = best[:, q] // 240, ROOTS[best[:, q] % 240]
                    moved = []
                    for b in range(BLOCKS):
                        hit = block == b
                        k = keys[b].copy()
                        k[hit] = _point_key(points[b][hit] + root[hit], 1000 * self.dim + 10 * t + b)
                        moved.append(k)
                    near[:, t, q] = cell(moved)
        return own, near.reshape(len(unit), -1)


def _hashed(batches):
    known: dict[int, Hashing] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = part.column(1).to_pylist()
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, r in enumerate(rows):
                if r and None not in r:
                    v = np.array(r, np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        v = v / top
                        by_dim.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
            for dim, found in by_dim.items():
                h = known.setdefault(dim, Hashing(dim))
                index = [i for i, _ in found]
                unit = np.stack([v for _, v in found])
                own, near = h.cells(unit)
                s = h.sketch(unit)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index)), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(s[:, 0]), pa.array(s[:, 1]), lists(own), lists(near)],
                    names=["vec_id", "unit", "s1", "s2", "own", "near"],
                )


def _cosines(batches):
    """(a, b, unit_a, unit_b) -> (a, b, cosine) in double precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out = np.empty(batch.num_rows)
        for at in range(0, batch.num_rows, ROWS):
            x, y = (batch.column(c).slice(at, ROWS).to_pylist() for c in ("unit_a", "unit_b"))
            size = np.array([len(v) for v in x])
            if (size == size[0]).all() and all(len(v) == size[0] for v in y):
                p, q = (np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for v in (x, y))
                out[at : at + len(x)] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
            else:
                out[at : at + len(x)] = [float(np.frombuffer(v) @ np.frombuffer(w)) if len(v) == len(w) else -1.0 for v, w in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "cosine"])


def _with_cosine(pairs: DataFrame, units: DataFrame) -> DataFrame:
    side = lambda x: units.select(F.col("vec_id").alias(x), F.col("unit").alias(f"unit_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "unit_a", "unit_b").mapInArrow(_cosines, "a long, b long, cosine double")


def _block_links(threshold: float):
    """Blocks of vectors (us) and of a ball's members (ws): how many of the others each is linked with, and for us the ball, if any."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                us, ws = batch.column("us")[row].values, batch.column("ws")[row].values
                (u, x), (w, y) = ((z.field("vec_id").to_numpy(), np.frombuffer(b"".join(z.field("unit").to_pylist()), np.float64).reshape(len(z), -1)) for z in (us, ws))
                cosine = x @ y.T
                hit = cosine >= threshold
                for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-9), strict=True):  # as a pair by itself is judged
                    hit[i, j] = (x[i] * y[j]).sum() / math.sqrt((x[i] * x[i]).sum() * (y[j] * y[j]).sum()) >= threshold
                n_u, n_w = hit.sum(1), hit.sum(0)
                a, b = np.flatnonzero(n_u), np.flatnonzero(n_w)
                ball = pa.array([batch.column("ball")[row].as_py()] * len(a) + [None] * len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u[a], w[b]])), pa.array(np.concatenate([n_u[a], n_w[b]]).astype(np.int64)), ball], names=["vec_id", "n", "ball"])

    return released(run)


def _most_bits(angle: float) -> int:
    """Sign bits of 128 that may differ at an angle: the mean and 4.5 deviations."""
    p = min(angle / math.pi, 0.5)
    return math.ceil(128 * p + 4.5 * math.sqrt(128 * p * (1 - p)))


def similar_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links at cosine >= ``threshold``."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    hashed = cut(given.where("vec_id is not null").dropDuplicates(["vec_id", "v"]).mapInArrow(_hashed, "vec_id long, unit binary, s1 long, s2 long, own array<long>, near array<long>"), "hashed")
    theta = math.acos(threshold)

    # balls: a third of all rows may crowd into one cell; it costs each of them one comparison with the hub
    balls = None
    for _ in range(HUB_ROUNDS):
        free = hashed if balls is None else hashed.join(balls, "vec_id", "left_anti")
        own = free.select("vec_id", F.explode("own").alias("cell"))
        crowds = cut(own.groupBy("cell").agg(F.count("*").alias("n"), F.min("vec_id").alias("hub")).where(F.col("n") > CROWD).select("cell", "hub"), "crowds")
        if crowds.isEmpty():
            break
        asked = own.join(crowds, "cell").select(F.col("vec_id").alias("a"), F.col("hub").alias("b")).distinct()
        near_hub = _with_cosine(asked, hashed).where(F.col("cosine") >= math.cos(theta / 2) + 1e-9)
        found = cut(near_hub.groupBy(F.col("a").alias("vec_id")).agg(F.min("b").alias("ball")), "balls")
        # a hub by itself is no ball
        found = found.join(found.groupBy("ball").count().where("count > 1"), "ball", "left_semi").select("vec_id", "ball")
        balls = cut(found if balls is None else balls.union(found), "balls")
    if balls is None:
        balls = hashed.select("vec_id", F.col("vec_id").alias("ball")).where("false")
    tagged = hashed.join(balls, "vec_id", "left")
    sizes = balls.groupBy("ball").agg(F.count("*").alias("size"))

    # entries: a lone vector, or a ball under its hub's sign bits, once in each cell
    hub_bits = balls.select("ball").distinct().join(hashed.select(F.col("vec_id").alias("ball"), "s1", "s2"), "ball")
    lone = tagged.where("ball is null").select(F.col("vec_id").alias("entry"), F.lit(0).alias("round"), "s1", "s2", "own", "near")
    in_ball = tagged.where("ball is not null").select("ball", "own", "near")
    ball_cells = lambda c: in_ball.select("ball", F.explode(c).alias("cell")).distinct().join(hub_bits, "ball").select("cell", F.col("ball").alias("entry"), F.lit(1).alias("round"), "s1", "s2")
    lone_cells = lambda c: lone.select(F.explode(c).alias("cell"), "entry", "round", "s1", "s2")
    home = lone_cells("own").union(ball_cells("own"))
    visit = home.union(lone_cells("near")).union(ball_cells("near"))
    bits = "bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2)"
    allowed = f"case x.round + y.round when 0 then {_most_bits(theta)} when 1 then {_most_bits(1.5 * theta)} else {_most_bits(2 * theta)} end"
    met = (
        home.alias("x")
        .join(visit.alias("y"), F.expr(f"x.cell = y.cell and (x.entry != y.entry or x.round != y.round) and {bits} <= {allowed}"))
        .select(F.expr("if(struct(x.entry, x.round) < struct(y.entry, y.round), struct(x.entry as e, x.round as r), struct(y.entry as e, y.round as r))").alias("p"), F.expr("if(struct(x.entry, x.round) < struct(y.entry, y.round), struct(y.entry as e, y.round as r), struct(x.entry as e, x.round as r))").alias("q"))
        .distinct()
    )
    met = cut(met.select(F.col("p.e").alias("a"), F.col("p.r").alias("round_a"), F.col("q.e").alias("b"), F.col("q.r").alias("round_b")), "met")
    plain = met.where("round_a + round_b = 0").select("a", "b")
    # where a ball is involved, its hub decides who can be linked with any member; a hub may itself sit in another ball
    wide = met.where("round_a + round_b > 0").select(F.expr("if(round_b = 1, b, a)").alias("ball"), F.expr("if(round_b = 1, a, b)").alias("entry"), F.expr("if(round_b = 1, round_a, round_b)").alias("round"))
    housed = balls.join(balls.select(F.col("ball").alias("vec_id")).distinct(), "vec_id", "left_semi").where("vec_id != ball")
    # each two balls once, whichever way they met
    both = wide.where("round = 1").select("ball", "entry").union(housed.select(F.col("vec_id").alias("ball"), F.col("ball").alias("entry")))
    both = both.select(F.greatest("ball", "entry").alias("ball"), F.least("ball", "entry").alias("entry")).where("ball != entry").distinct()
    member = balls.select(F.col("ball").alias("entry"), F.col("vec_id").alias("a"))
    guests = wide.where("round = 0").select(F.col("entry").alias("a"), F.col("ball").alias("b")).union(both.join(member, "entry").select("a", F.col("ball").alias("b"))).distinct()
    guests = cut(_with_cosine(guests, hashed).where(F.col("cosine") >= math.cos(min(1.5 * theta, math.pi)) - 1e-9).select(F.col("b").alias("ball"), F.col("a").alias("vec_id")), "guests")
    units = hashed.select("vec_id", "unit", F.octet_length("unit").alias("size")).dropDuplicates(["vec_id", "size"])

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        count = rows.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        rows = rows.join(count, "ball").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).join(units, "vec_id")
        return rows.groupBy("ball", "size", F.col("block").alias(f"block_{name}")).agg(F.collect_list(F.struct("vec_id", "unit")).alias(name))

    hosts = balls.join(guests.select("ball").distinct(), "ball", "left_semi")
    told = blocks(guests, "us").join(blocks(hosts, "ws"), ["ball", "size"]).select("ball", "us", "ws")
    told = cut(told.mapInArrow(_block_links(threshold), "vec_id long, n long, ball long").groupBy("vec_id", "ball").agg(F.sum("n").alias("n")), "told")
    links = cut(_with_cosine(plain, hashed).where(F.col("cosine") >= threshold).select("a", "b").distinct(), "links")
    edges = links.union(balls.select(F.col("ball").alias("a"), F.col("vec_id").alias("b"))).union(told.where("ball is not null").select(F.col("ball").alias("a"), F.col("vec_id").alias("b")))
    outside = links.select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n")).union(told.groupBy("vec_id").agg(F.sum("n").alias("n")))
    outside = outside.groupBy("vec_id").agg(F.sum("n").alias("n"))
    # a hub that sits in another ball meets its own ball's members as a guest
    inside = balls.join(sizes, "ball").select("vec_id", (F.col("size") - 1).alias("m"))
    labels = components(edges).withColumnRenamed("id", "vec_id")
    out = given.select("vec_id").join(outside, "vec_id", "left").join(inside, "vec_id", "left").join(labels, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_lattice(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""MinHash near-duplicates by chosen-path set similarity join.

A document's set is its distinct k-word shingles. Equal sets collapse to one
representative first, so groups of copies cost one row each. Then independent
trees split the representatives: a node holds those that chose the same minwise
tokens on the way down. Below the first level every path has tokens of its own
at every level, so paths agree independently; they are made for the
representatives in large nodes only. Nodes of up to LEAF members are compared
exhaustively.

Large nodes of the first level are thinned before they branch. All its members meet its hub (the
member nearest to its most usual tokens). Those linked with the hub, its core,
are one component, so they leave the tree. As Jaccard distance is a metric, only
members within twice the linking distance of the hub can be linked with the
core; these meet it in blocks at the end, if they are not connected by then.
What is left of the node branches. Families of copies thus cost rows in
proportion to their size, and no link is given up.

Every link is confirmed on full sets; sketches of 8-bit hashes only spare
hopeless comparisons (a pair at the very threshold fails them with probability
about 1e-5). Links between texts that are known to be connected are not confirmed
again: the result is made of components.

Results: a null or empty text, or one of only spaces, has an empty set and is
linked with nothing. Rows with a null id are returned unlinked, with a null
component and kept = true. Rows that share an id and differ in their texts may be linked
through one another. Repeated rows are returned as often as they come; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stages import components, cut, free, merged, scope
from pulsegrid.llm.textops import SLICE_BYTES, mix, released, shingle_sets, slices

#: Minwise tokens kept per document, trees (each starts from its own token), levels, and branches at each level below the first.
POOL, TREES, LEVELS, BRANCHES = 32, 16, 6, (1, 2, 2, 2, 2)
#: Members of a node that is compared exhaustively, and least members of a core.
LEAF, SMALL = 256, 48
#: Hubs whose sketches are broadcast; more are shuffled.
BROADCAST_HUBS = 10_000
#: Members of a core, and of what is near to it, that meet as one block.
BLOCK = 256
#: Members whose tokens name a large node's most usual ones, by which its hub is chosen.
VOTERS = 64
#: Positions of the wide sketch, by one-permutation hashing of the set, and of the fine one that is made for what meets in blocks only.
WIDE, FINE = 256, 2048
#: Sketch positions that must agree before full sets are compared: this many deviations below the mean at the similarity asked for.
DEVIATIONS = 4.2
#: Rows that are confirmed together.
ROWS = 128


def _fixed(values: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _binary(column, width: int, dtype) -> np.ndarray:
    """The bytes of a binary column without nulls as rows of ``width`` items, in place."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0]
    return np.frombuffer(data, np.uint8, len(column) * width * np.dtype(dtype).itemsize, first).view(dtype).reshape(-1, width)


def _wide_sketches(h: np.ndarray, so: np.ndarray, width: int = WIDE) -> np.ndarray:
    """A byte for each of ``width`` ranges of the hash: of the smallest item in it, 0 if there is none. The items are sorted, so that is the first."""
    wide = np.zeros((len(so) - 1, width), np.uint8)
    if len(h):
        cell = np.repeat(np.arange(len(so) - 1) * width, np.diff(so)) + (h >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        wide.ravel()[cell[first]] = (mix(h[first], 77) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return wide


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                h, so = shingle_sets(data, offsets, k)
                n = np.diff(so)
                full = np.flatnonzero(n)
                at = so[:-1][full]
                keys = np.zeros((2, len(n)), np.uint64)
                pool = np.zeros((len(n), POOL), np.uint32)
                if len(full):
                    for t in range(2):
                        keys[t, full] = np.add.reduceat(mix(h, 900 + t), at)
                    for t in range(POOL):
                        pool[full, t] = np.minimum.reduceat(mix(h, t), at) & np.uint64(0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), _fixed(pool), _fixed((pool & 255).astype(np.uint8)), _fixed(_wide_sketches(h, so))],
                    names=["doc_id", "n_shingles", "k1", "k2", "pool", "sketch", "wide"],
                )

    return released(run)


def _fine_sketches(k: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], _fixed(_wide_sketches(*shingle_sets(data, offsets, k), FINE))], names=["rep", "fine"])

    return released(run)


def _paths(level: int) -> int:
    return TREES * math.prod(BRANCHES[: level - 1])


def _first_nodes(batches):
    """(rep, pool) -> the node of each tree at the first level."""
    for batch in batches:
        pool = _binary(batch.column("pool"), POOL, np.uint32).astype(np.uint64)
        for t in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(mix(pool[:, t], t).view(np.int64)), pa.array(np.full(len(pool), t, np.int32)), batch.column("rep")], names=["node", "path", "rep"])


def _level_tokens(k: int, level: int):
    """For each text a minwise token for every path of a level, of a hash that nothing else uses."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), SLICE_BYTES >> 2):
                h, so = shingle_sets(data, offsets, k)
                full = np.flatnonzero(np.diff(so))
                if not len(full):
                    continue
                tokens = np.empty((len(full), _paths(level)), np.uint32)
                for t in range(tokens.shape[1]):
                    tokens[:, t] = np.minimum.reduceat(mix(h, 10_000 * level + t), so[:-1][full]) & np.uint64(0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(full)), _fixed(tokens)], names=["rep", "tokens"])

    return released(run)


def _next_nodes(level: int):
    """(node, path, rep, tokens) -> each node's branches, by the token that the branch's path has at this level."""

    def run(batches):
        for batch in batches:
            path, node = batch.column("path").to_numpy(), batch.column("node").to_numpy().view(np.uint64)
            tokens = _binary(batch.column("tokens"), _paths(level), np.uint32)
            for b in range(BRANCHES[level - 2]):
                own = path * BRANCHES[level - 2] + b
                down = mix(node ^ mix(tokens[np.arange(len(tokens)), own].astype(np.uint64), 40 + level), 60 + level + 10 * b)
                yield pa.RecordBatch.from_arrays([pa.array(down.view(np.int64)), pa.array(own.astype(np.int32)), batch.column("rep")], names=["node", "path", "rep"])

    return run


def _plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: float) -> np.ndarray:
    """Sizes allow the similarity, and the sketches' agreement does not speak against it."""
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    p = percent / 100
    told, agree = ((a | b) != 0).sum(1), ((a == b) & (a != 0)).sum(1)
    # told of the union's items are seen, drawn without replacement
    unseen = np.clip(1 - told * (1 + p) / np.maximum(1, n_a + n_b), 0.02, 1)
    return ok & (agree >= p * told - DEVIATIONS * np.sqrt(p * (1 - p) * told * unseen) - 1)


def _leaf_pairs(percent: int):
    """All plausible pairs of each node, and how many positions of their sketches agree."""

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            if not len(flat):
                continue
            size = np.diff(members.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(size)])
            rep, n = (flat.field(x).to_numpy() for x in ("rep", "n"))
            sketch = _binary(flat.field("sketch"), WIDE, np.uint8)
            for m in np.unique(size):
                first = at[:-1][size == m]
                a, b = np.triu_indices(m, 1)
                step = max(1, 20_000 // max(1, len(a)))
                for x in range(0, len(first), step):
                    f = first[x : x + step]
                    left, right = (f[:, None] + a).ravel(), (f[:, None] + b).ravel()
                    x, y = sketch[left], sketch[right]
                    ok = _plausible(x, y, n[left], n[right], percent) & (rep[left] != rep[right])
                    p, q, agree = rep[left[ok]], rep[right[ok]], ((x[ok] == y[ok]) & (x[ok] != 0)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])

    return released(run)


def _row_pairs(percent: int, near: float):
    """Rows that hold both sides with wide sketches: the pairs that may be near, how many positions agree, and whether they may be linked."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                c = {x: batch.column(x).slice(at, 8192) for x in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")}
                x, y = _binary(c["sketch_a"], WIDE, np.uint8), _binary(c["sketch_b"], WIDE, np.uint8)
                n_a, n_b = c["n_a"].to_numpy(), c["n_b"].to_numpy()
                core = _plausible(x, y, n_a, n_b, percent)
                ok = core | _plausible(x, y, n_a, n_b, near) if near < percent else core
                agree = pa.array(((x == y) & (x != 0)).sum(1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([c["a"], c["b"], agree, pa.array(core)], names=["a", "b", "agree", "core"]).filter(pa.array(ok))

    return released(run)


PAIR_ROWS = "a long, b long, agree int, core boolean"


def _block_pairs(percent: int):
    """Two blocks, of members with their components: the plausible pairs that are not connected yet."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                us, ws = batch.column("us")[row].values, batch.column("ws")[row].values
                (u, n_u, part_u), (w, n_w, part_w) = ([x.field(c).to_numpy() for c in ("rep", "n", "part")] for x in (us, ws))
                x, y = _binary(us.field("sketch"), WIDE, np.uint8), _binary(ws.field("sketch"), WIDE, np.uint8)
                fine_x, fine_y = _binary(us.field("fine"), FINE, np.uint8), _binary(ws.field("fine"), FINE, np.uint8)
                i, j = np.nonzero((part_u[:, None] != part_w) & (100 * np.minimum(n_u[:, None], n_w) >= percent * np.maximum(n_u[:, None], n_w)))
                for at in range(0, len(i), 8192):
                    p, q = i[at : at + 8192], j[at : at + 8192]
                    ok = _plausible(x[p], y[q], n_u[p], n_w[q], percent)
                    p, q = p[ok], q[ok]
                    ok = np.concatenate([_plausible(fine_x[p[z : z + 1024]], fine_y[q[z : z + 1024]], n_u[p[z : z + 1024]], n_w[q[z : z + 1024]], percent) for z in range(0, max(len(p), 1), 1024)])
                    a, b = u[p[ok]], w[q[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return released(run)


def _profiles(batches):
    """(node, sketches of its voters) -> the most usual byte of each position."""
    for batch in batches:
        told = []
        for row in range(batch.num_rows):
            votes = _binary(batch.column("votes")[row].values, POOL, np.uint8)
            counts = np.zeros((POOL, 256), np.int32)
            np.add.at(counts, (np.arange(POOL)[None, :], votes), 1)
            told.append(counts.argmax(1).astype(np.uint8))
        profile = _fixed(np.array(told, np.uint8).reshape(-1, POOL))
        yield pa.RecordBatch.from_arrays([batch.column("node"), profile], names=["node", "profile"])


def _agreement(batches):
    for batch in batches:
        agree = (_binary(batch.column("sketch"), POOL, np.uint8) == _binary(batch.column("profile"), POOL, np.uint8)).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), pa.array(agree.astype(np.int32))], names=["node", "rep", "agree"])


def _confirm(k: int, percent: int):
    """Rows with both whole texts: those whose full sets reach the similarity."""

    def sets(texts):
        for _, _, data, offsets in slices(texts):
            h, so = shingle_sets(data, offsets, k)
            yield from (h[so[x] : so[x + 1]] for x in range(len(so) - 1))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, ok = batch.slice(at, ROWS), []
                for p, q in zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True):
                    if not len(p) or not len(q):
                        ok.append(False)
                        continue
                    if len(p) > len(q):
                        p, q = q, p
                    place = np.searchsorted(q, p)
                    place[place == len(q)] = len(q) - 1
                    shared = int((q[place] == p).sum())
                    ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return released(run)


def _verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity, as a table; only the texts in pairs are shuffled."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    chosen = texts.join(wanted, "doc_id", "left_semi")
    side = lambda x: chosen.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return cut(met.mapInArrow(_confirm(k, percent), "a long, b long"), "links")


def _sized(nodes: DataFrame) -> DataFrame:
    """Nodes of more than one member, with their size. Sizes are a table of their own, so that a large node's rows may be dealt to several tasks."""
    sizes = cut(nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return cut(nodes.join(sizes, "node"), "sized")


def _leaf(sized: DataFrame) -> DataFrame:
    return sized.where(F.col("size") <= LEAF).select("node", "rep")


def _compared(leaves: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, agree: plausible pairs of all nodes of up to LEAF members, whatever their level."""
    rows = leaves.join(reps.select("rep", "n", F.col("wide").alias("sketch")), "rep")
    members = rows.groupBy("node").agg(F.collect_list(F.struct("rep", "n", "sketch")).alias("members")).select("members")
    return cut(members.mapInArrow(_leaf_pairs(percent), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")


def _hubs(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, hub): the member that agrees most with the node's most usual tokens, the smallest such. Voters are the same in all trees, so a family's nodes agree on its hub."""
    rows = cut(large.join(reps.select("rep", "sketch"), "rep").select("node", "rep", "size", "sketch"), "members")
    votes = rows.where(F.pmod(F.xxhash64("rep"), "size") < VOTERS).groupBy("node").agg(F.collect_list("sketch").alias("votes"))
    told = rows.join(votes.mapInArrow(_profiles, "node long, profile binary"), "node").select("node", "rep", "sketch", "profile").mapInArrow(_agreement, "node long, rep long, agree int")
    return cut(told.groupBy("node").agg(F.max_by("rep", F.struct("agree", -F.col("rep"))).alias("hub")), "hubs")


def _met(us: DataFrame, ws: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Plausible pairs of us and ws (group, rep) within a group that are not connected yet, block by block, by fine sketches of these members."""
    who = us.select(F.col("rep").alias("doc_id")).union(ws.select("rep")).distinct()
    fine = cut(texts.join(who, "doc_id", "left_semi").mapInArrow(_fine_sketches(k), "rep long, fine binary"), "fine")
    told = reps.select("rep", "n", F.col("wide").alias("sketch")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).join(fine, "rep")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        count = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        rows = rows.join(count, "group").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).join(told, "rep")
        return rows.groupBy("group", F.col("block").alias(f"block_{name}")).agg(F.collect_list(F.struct("rep", "n", "part", "sketch", "fine")).alias(name))

    return blocks(us, "us").join(blocks(ws, "ws"), "group").select("us", "ws").mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_id of ``docs``: links at 100 * intersection >= percent * union.

    ``set_id`` names the class of equal sets: the smallest id in it. The tables
    written on the way are removed, but for the two that the result is read from.
    """
    with scope() as written:
        rows, classes = _classed(docs, id_col, text_col, k, percent)
        free(*(t for t in written if t is not rows and t is not classes))
    out = rows.where("n_shingles > 0 and doc_id is not null").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component_id", "set_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    out = out.union(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"), "set_id")


def _classed(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's set, and every set's class and component, as tables."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_signatures(k), "doc_id long, n_shingles long, k1 long, k2 long, pool binary, sketch binary, wide binary"), "signed")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    reps = linked.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("pool", "sketch", "wide")))
    reps = cut(reps.withColumnRenamed("n_shingles", "n"), "reps")
    # the first level; its large nodes are thinned
    sized = _sized(reps.select("rep", "pool").mapInArrow(_first_nodes, "node long, path int, rep long"))
    leaves, core, near, last = _leaf(sized), None, None, None
    rest = sized.where(F.col("size") > LEAF).drop("size")
    if not rest.isEmpty():
        hubs = _hubs(sized.where(F.col("size") > LEAF), reps)
        small = (lambda df: F.broadcast(df)) if hubs.count() <= BROADCAST_HUBS else (lambda df: df)
        side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"sketch_{x}"))
        spokes = rest.join(small(hubs), "node").where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        centre = cut(side("b").join(hubs.select(F.col("hub").alias("b")).distinct(), "b", "left_semi"), "centres")
        star = cut(spokes.join(side("a"), "a").join(small(centre), "b").mapInArrow(_row_pairs(percent, 2 * percent - 100), PAIR_ROWS), "star")
        worth = star.where("core").groupBy("b").count().where(F.col("count") >= SMALL).select("b")
        core = _verified(texts, star.where("core").join(worth, "b", "left_semi"), k, percent)
        centres = cut(core.select(F.col("b").alias("hub")).distinct(), "centres")
        near = star.join(centres, star["b"] == centres["hub"], "left_semi").select("a", "b").join(core, ["a", "b"], "left_anti")
        gone = core.select(F.col("a").alias("rep"), F.col("b").alias("hub")).union(centres.select(F.col("hub").alias("rep"), "hub"))
        rest = cut(rest.join(small(hubs), "node").join(gone, ["rep", "hub"], "left_anti").select("node", "path", "rep"), "rest")

    # the levels below, as long as a node is large; nodes of all levels have names of their own
    sized = _sized(rest)
    for level in range(2, LEVELS + 1):
        rest = sized.where(F.col("size") > LEAF)
        leaves = leaves.union(_leaf(sized))
        if rest.isEmpty():
            break
        chosen = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
        # a table, so that a task never runs two Python workers at once
        tokens = cut(chosen.mapInArrow(_level_tokens(k, level), "rep long, tokens binary"), "tokens")
        sized = _sized(cut(rest.join(tokens, "rep").mapInArrow(_next_nodes(level), "node long, path int, rep long"), "nodes"))
    else:
        leaves = leaves.union(_leaf(sized))
        last = sized.where(F.col("size") > LEAF).select(F.col("node").alias("group"), "rep")

    pairs = _compared(leaves, reps, percent)
    # the likeliest link of every text comes first; the others are confirmed only where they join what is still apart
    ends = pairs.select("a", "b", "agree", F.col("a").alias("x")).union(pairs.select("a", "b", "agree", "b"))
    best = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("agree", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    edges = _verified(texts, cut(best, "best"), k, percent)
    labels = components(edges if core is None else edges.union(core))
    part = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"part_{x}"))
    apart = lambda rows: rows.join(part("a"), "a", "left").join(part("b"), "b", "left").where("coalesce(part_a, a) != coalesce(part_b, b)").select("a", "b")
    open_pairs = [apart(pairs).join(edges, ["a", "b"], "left_anti")]
    if core is not None:
        # what is near to a core and not connected with it meets the core's members
        us = cut(apart(near).select(F.col("b").alias("group"), F.col("a").alias("rep")), "loose")
        ws = core.select(F.col("b").alias("group"), F.col("a").alias("rep"))
        ws = ws.union(ws.select("group", F.col("group").alias("rep")).distinct()).join(us.select("group").distinct(), "group", "left_semi")
        open_pairs.append(_met(us, ws, labels, reps, texts, k, percent))
    if last is not None:
        open_pairs.append(_met(last, last, labels, reps, texts, k, percent))
    met = open_pairs[0]
    for more in open_pairs[1:]:
        met = met.union(more)
    open_pairs = cut(met.distinct(), "open")
    if not open_pairs.isEmpty():
        labels = merged(labels, _verified(texts, open_pairs, k, percent))
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.col("rep").alias("set_id"), F.coalesce("component", "rep").alias("component_id"))
    return cut(signed.select("doc_id", "n_shingles", "k1", "k2"), "rows"), cut(classes, "classes")


def op1_near_dup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")

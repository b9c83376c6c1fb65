"""Cutting lineage with written tables, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset a temporary one, if all of Spark runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return _own_folder[app]


#: Bytes of an Arrow batch: what goes to a Python worker at once, and stays with the JVM's buffers.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session from now on sends small Arrow batches, unless it was told a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(BATCH, "4m")
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pulsegrid/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: it survives lost executors and is computed once."""
    path = new_folder(bounded(df).sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope():
    """The tables that ``cut`` writes meanwhile, so that all but a result's own may be removed at the end."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def free(*frames: DataFrame) -> None:
    """Removes tables that ``cut`` wrote, once all that is made of them is a table itself."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df._written_at = None


#: Bits of a sieve for each of its keys, and at most (8 MB).
SIEVE_BITS, MOST_BITS = 32, 1 << 26


def sifted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key is none of ``keys`` for certain, and all others, which have to meet the table ``keys`` itself.

    What a few keys decide is not shuffled whole: a bitmap of their hashes is
    broadcast. Its size is bounded; with more keys than it can tell apart more
    rows, in the end all, are among the others. A null key is on either side.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (SIEVE_BITS * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast(keys.schema[key].dataType)), F.lit(bits)) + 1
    marks = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__marks"))
    met = df.withColumn("__at", F.bitmap_bit_position(place)).withColumn("__in", F.bitmap_bucket_number(place))
    met = met.join(F.broadcast(marks), F.col("__in") == F.col("__bucket"), "left")
    byte = "cast(conv(hex(substring(__marks, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    told = F.expr(f"coalesce(shiftright({byte}, cast(__at % 8 as int)) % 2 = 1, false)")
    return met.where(~told).select(*df.columns), met.where(told).select(*df.columns)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (a, b) reaches.

    Every round hooks a node to its smallest neighbour, shortens the hooks by
    pointer jumping and contracts the graph to the roots; the smallest id of a
    component is always a root. Rounds are logarithmic in a component's size,
    and the contracted graph shrinks from round to round. Nothing is collected.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").distinct()
    e = cut(e, "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("p"))
        hook = cut(hook, "hooks")  # read by all that follows
        for _ in range(2):
            up = hook.select(F.col("id").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("id", F.col("q").alias("p"))
        hook = cut(hook, "hooks")
        to = lambda side: hook.select(F.col("id").alias(side), F.col("p").alias(f"{side}_to"))
        e = cut(
            e.join(to("a"), "a").join(to("b"), "b").where("a_to != b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = hook.select("id", F.col("p").alias("component"))
        else:
            labels = cut(
                labels.join(hook.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")),
                "labels",
            )
    if labels is None:
        return edges.select(F.col("a").cast("long").alias("id"), F.col("a").cast("long").alias("component")).where("false")
    return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, component) after the further ``edges`` (a, b)."""
    if edges.isEmpty():
        return labels
    to = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"root_{x}"))
    roots = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    up = components(roots)
    known = labels.join(up.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return cut(known.union(up.join(labels.select("id"), "id", "left_anti")), "labels")

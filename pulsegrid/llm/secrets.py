"""Secrets in texts, told apart by who owns them across the corpus.

Patterns find candidates in one pass. Each candidate's value is hashed, and the
hashes are counted over the whole corpus by distinct repositories and owners:
a value that many owners hold is a copied example, one that a single owner
holds and that looks random is a live-looking credential. Only hashes and ids
are shuffled, and counts are summed before they are; DataFrame functions only.

Base kinds (assign, access, hex) are always reported as they match. The method
adds ``jwt``, ``pem`` and ``url`` spans.

Results: a null or empty text has no spans. A null owner or repository counts
as one of its own for every row without one together. Rows with equal ids are
reported separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.spans import matches
from pulsegrid.llm.stages import cut

#: Patterns by kind, and the group that holds the value.
KINDS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}+", 0, 18),
    "hex": (r"[0-9a-f]{16,}+", 0, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 28),
    "pem": (r"-----BEGIN\x20(?:[A-Z]+\x20){0,3}PRIVATE\x20KEY-----", 0, 20),
    "url": (r"[a-z][a-z0-9+]{1,12}://[^\x20\x09-\x0D:@/]++:([^\x20\x09-\x0D:@/]{4,}+)@", 1, 4),
}
BASE, ADDED = ("assign", "access", "hex"), ("jwt", "pem", "url")
#: Owners from which on a value is a copied example; distinct characters from which on it looks random.
COPIED_OWNERS, RANDOM_CHARACTERS = 3, 8


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source") -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, n_live, n_copied, max_owners of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    d = d.select("doc_id", "owner", "repo", *[matches("text", p, g).alias(f"m_{k}") for k, (p, g, _) in KINDS.items()])
    # the value's length decides; the place among equal starts is the kind's
    listed = lambda kinds: "concat(" + ", ".join(f"transform(filter(m_{k}, x -> char_length(x.part) >= {KINDS[k][2]}), x -> struct(x.s as s, {list(KINDS).index(k)} as place, '{k}' as kind, x.e as e, sha2(x.part, 256) as value, size(array_distinct(split(x.part, ''))) as kinds_of_characters))" for k in kinds) + ")"
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.expr(f"array_sort({listed(BASE)})").alias("base"), F.expr(f"array_sort({listed(KINDS)})").alias("found"))
    d = cut(d, "candidates")

    values = d.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", F.col("x.value").alias("value"), F.col("x.kinds_of_characters").alias("characters"))
    values = values.distinct()
    nobody = F.lit("\x00")
    # counts are a table of their own, so that a very common value's rows may be dealt to several tasks
    held = values.groupBy("value").agg(
        F.count_distinct(F.coalesce("owner", nobody)).alias("owners"),
        F.count_distinct(F.coalesce("repo", nobody)).alias("repos"),
    )
    held = cut(held, "ownership")
    judged = values.join(held, "value").select("row", "owners", "repos", (F.col("owners") >= COPIED_OWNERS).alias("copied"), ((F.col("owners") == 1) & (F.col("repos") <= 2) & (F.col("characters") >= RANDOM_CHARACTERS)).alias("live"))
    per_row = judged.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"), F.max("owners").alias("max_owners"))
    text = lambda c: f"array_join(transform({c}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    out = d.join(per_row, "row", "left")
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(text("base")), 256).alias("base_sha256"),
        F.expr(text("found")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("max_owners", F.lit(0)).alias("max_owners"),
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents. They name no repository or owner finer than their source, which stands for both, so ownership is counted once here."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

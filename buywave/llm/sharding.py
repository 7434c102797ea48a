"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash within their source. The row of rank r among n has the fractional rank
(r - 1/2) / n; sorted by it, every stretch of rows holds the sources in proportion. The order is cut
into shards of equal row counts, so each matches the mixture.

Both orders are numbered in parallel: the hash (and the fractional rank) is cut into buckets, counts of
the buckets give the offsets, and windows run inside a bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import CONTENT_KEYS, materialize, numbered_copies, rows_of, unit_interval, with_content_keys

SHARDS = 40
SEED = 9
BUCKETS = 4096
ROW_OVERHEAD = 16


def _numbered(rows: DataFrame, strata: tuple[str, ...], bucket: str, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: the 1-based rank within strata by (bucket, order), and ``name_of``, the
    stratum's rows. No window holds more than one bucket of one stratum."""
    counts = materialize(rows.groupBy(*strata, bucket).agg(F.count("*").alias("n")), "counts")
    whole = Window.partitionBy(*strata)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (stratum, bucket), whatever the number of rows.
    offsets = counts.select(
        *[F.col(c).alias(f"of_{c}") for c in (*strata, bucket)],
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(whole).alias(f"{name}_of"),
    )
    same = F.lit(True)
    for c in (*strata, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    inside = F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order))
    ranked = rows.withColumn("inside", inside).join(offsets, same)
    return ranked.withColumn(name, F.col("offset") + F.col("inside")).drop("inside", "offset", *[f"of_{c}" for c in (*strata, bucket)])


def size_in_shard(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("bigint")


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = (), buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, ``keep``, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``rows``: shard sizes differ by one row at most, and ``slot`` numbers a shard's rows from
    0 without gaps. ``grown_shard`` is null under that law. A null source is a source of its own, null
    texts have no bytes. The shuffle key comes from id, size, checksum, ``keep`` and a number among equal rows,
    so rows without an id or with one id are spread like any others. Fewer rows than shards leave the shards between empty.
    """
    measured = docs.select(
        "doc_id",
        "source",
        *keep,
        size_in_shard().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    hashed = unit_interval("doc_id", "size", "text_crc32", *keep, "copy", seed=seed)
    rows = materialize(
        numbered_copies(measured).withColumn("u", hashed).withColumn("bucket", F.floor(F.col("u") * buckets).cast("int")),
        "shuffled",
    )
    ties = ["doc_id", "size", "text_crc32", *keep, "copy"]
    ranked = _numbered(rows, ("source",), "bucket", ["u", *ties], "rank")
    fraction = (F.col("rank") - F.lit(0.5)) / F.col("rank_of")
    spread = materialize(
        ranked.withColumn("fraction", fraction)
        .withColumn("stretch", F.floor(F.col("fraction") * buckets).cast("int"))
        .select("doc_id", "source", *keep, "size", "text_crc32", "copy", "u", "fraction", "stretch"),
        "interleaved",
    )
    lined_up = _numbered(spread, (), "stretch", ["fraction", F.col("source").isNull(), "source", "u", *ties], "position")
    at = F.col("position") - 1
    # Integer arithmetic: shard s starts at the smallest position p with p * shards >= s * total.
    exact = F.expr(f"cast((position - 1) * {shards} div position_of as int)")
    first = F.expr(f"(shard * position_of + {shards} - 1) div {shards}")
    return (
        lined_up.withColumn("shard", exact)
        .withColumn("slot", (at - first).cast("bigint"))
        .select(
            "doc_id",
            *keep,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with their size, text_crc32, law, shard, slot and grown_shard.

    A column of ``docs`` with one of these names is replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = with_content_keys(docs.drop(*made))
    return rows_of(keyed, assign_shards(keyed, shards, seed, keep=CONTENT_KEYS).drop("doc_id"), *made)

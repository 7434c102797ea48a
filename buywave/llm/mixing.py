"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a share of the words. A source whose target exceeds its size is repeated: complete
epochs first, and the rest is sampled without replacement. Every document gets the key
``-ln(u) / weight`` with a reproducible uniform u and its quality weight; in the order of the keys,
documents are taken until the sum of sizes reaches the rest of the target.

The running sum of a source is made in parallel: keys are cut into buckets, the buckets' sums give the
offsets, and windows run inside (source, bucket) only. So a source with a third of all rows is no
single task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import (
    CONTENT_KEYS,
    WORD,
    few_and_many,
    materialize,
    numbered_copies,
    repeated_apart,
    repeated_here,
    rows_of,
    unit_interval,
    whole_text,
    with_content_keys,
)

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = 20
BUCKETS = 1024
#: Characters that are rare in prose; their share lowers a document's quality weight.
SYMBOLS = "#$%&*@|~^<>{}[]\\\\=+_"


def word_count(text: str = "text") -> Column:
    """How many words, found as the length of the text with one letter for each word: no array of words."""
    blank = r"[\x20\x09-\x0D]*"
    marks = F.length(F.regexp_replace(F.col(text), blank + WORD + blank, "x"))
    return F.when(F.col(text).rlike(WORD), marks).otherwise(0).cast("bigint")


def quality_weight(text: str = "text") -> Column:
    """Between 0.5 and 1: one minus five times the share of symbols, at least one half."""
    body = whole_text(text)
    symbols = F.length(F.regexp_replace(body, f"[^{re.escape(SYMBOLS)}]+", ""))
    return F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.length(body), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``target`` words for every row (source, source_size); the targets share the sum of all sizes.

    Sources in code point order, null last, have the weights in turn. A target is ``level * weight``, but
    at most ``most`` times the source's size; the level is the one at which the targets sum up
    to the whole, which is where sharing the excess again and again ends. One row per source: ordering
    them in one task is bounded by the number of sources.
    """
    everything = Window.partitionBy()
    named = everything.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    full_at = F.col("cap") / F.col("weight")
    by_level = everything.orderBy(full_at, F.col("source").isNull(), "source")
    up_to = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sources = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.sum("cap").over(up_to))
        .withColumn("capped_weight", F.sum("weight").over(up_to))
    )
    # The level if all sources that fill up earlier are full, and this one and the later ones are not.
    open_weight = F.col("all_weight") - F.col("capped_weight") + F.col("weight")
    level = (F.col("total") - F.col("capped") + F.col("cap")) / open_weight
    levels = (
        sources.withColumn("level", level)
        .withColumn("full_at", full_at)
        .withColumn("full", F.col("level") >= F.col("full_at"))
        .withColumn("place", F.row_number().over(by_level))
    )
    # Full sources come first in this order; the level of the first open one holds for all open ones.
    first_open = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(first_open * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
    quality: Column | None = None,
    keep: tuple[str, ...] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, ``keep``, source, size, source_size, target, epochs, taken of every row.

    ``epochs`` is how often the mix holds the document and ``taken`` its words in the mix. The last
    sampled document of a source is taken if that brings the sum nearer to the target. Null texts and
    texts without words have size 0 and are taken in complete epochs only. A null source is a source of
    its own. Repeated rows are separate documents, and so are rows without an id: the key comes from id, text
    and a number among equal rows, so that no id fills one bucket. ``quality`` is a weight in [0.5, 1] by default from the
    text alone; null weights count as 0.5.
    """
    quality = F.greatest(F.coalesce(quality if quality is not None else quality_weight(), F.lit(0.5)), F.lit(1e-6))
    digest = F.md5(whole_text("text")).alias("digest")
    measured = docs.select("doc_id", "source", *keep, word_count().alias("size"), quality.alias("quality"), digest)
    key = -F.log(unit_interval("doc_id", "digest", "copy", seed=seed)) / F.col("quality")
    rows = materialize(
        numbered_copies(measured)
        .withColumn("key", key)
        .drop("quality", "digest")
        .withColumn(
            # Half the key: with weights from 0.5 to 1 no bucket gets more than twice its share.
            "bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key") / 2)) * buckets), F.lit(buckets - 1)).cast("int")
        ),
        "mix",
    )
    sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (source, bucket): bounded by sources x buckets whatever the number of documents.
    plan = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    )
    plan = plan.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *keep, "copy")
    placed = rows.withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("bigint")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    start = F.col("offset") + F.col("until") - F.col("size")
    sampled = (F.col("size") > 0) & (start + F.col("size") / F.lit(2.0) <= F.col("rest"))
    return (
        joined.withColumn("whole", F.least(whole, F.lit(most)))
        .withColumn("rest", rest)
        .withColumn("epochs", F.col("whole") + F.when((F.col("whole") < most) & sampled, 1).otherwise(0))
        .select("doc_id", *keep, "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with the same columns.

    Rows that agree in every column are repeated as often as ``mix`` takes them together.
    """
    keyed = with_content_keys(docs)
    taken = mix(keyed, keep=CONTENT_KEYS, **options).filter("epochs > 0")
    times = materialize(taken.groupBy(*CONTENT_KEYS).agg(F.sum("epochs").alias("times")), "mix-times")
    few, many = few_and_many(times, "times")
    copies = repeated_here(rows_of(keyed, few, "times"), "times", "mix copy")
    return copies.unionByName(repeated_apart(rows_of(keyed, many, "times"), "times", "mix copy")).drop("mix copy")

"""Chronological split and diagnostics of training snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAIN_RATIO = 0.7
VAL_RATIO = 0.15
DIAGNOSED = ("events_last_7d", "events_last_30d", "conversion_rate_30d", "recency_score")
# Positive-rate limits of the quality flag. Fixed values.
LOW_RATE = 0.01
UNSTABLE_RATE = 0.03


def date_splits(snapshots: DataFrame, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> DataFrame:
    """(snapshot_date, split): first int(train*n) dates, next int(val*n) dates, the rest.

    One row per date, so the ungrouped windows are bounded by the calendar.
    """
    dates = snapshots.select("snapshot_date").distinct()
    numbered = dates.withColumn("i", F.row_number().over(W.orderBy("snapshot_date"))).withColumn(
        "n", F.count(F.lit(1)).over(W.partitionBy())
    )
    train_end = F.floor(F.col("n") * train)
    val_end = train_end + F.floor(F.col("n") * val)
    return numbered.select(
        "snapshot_date",
        F.when(F.col("i") <= train_end, "train").when(F.col("i") <= val_end, "val").otherwise("test").alias("split"),
    )


def time_split(
    snapshots: DataFrame, train: float = TRAIN_RATIO, val: float = VAL_RATIO, dates: DataFrame | None = None
) -> DataFrame:
    """Add ``split``; the date table (one row per calendar day) is broadcast.

    ``dates`` has the ``snapshot_date`` values where they are known (``snapshot_dates``); else they are
    taken from the snapshots, which are then computed for that too.
    """
    return snapshots.join(F.broadcast(date_splits(snapshots if dates is None else dates, train, val)), "snapshot_date")


def split_distribution(split_rows: DataFrame, label: str = "will_purchase_next_7d") -> DataFrame:
    """Positives, rows and positive rate per split."""
    return split_rows.groupBy("split").agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.count(F.lit(1)).alias("total"),
        (F.sum(label) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("rate"),
    )


def target_diagnostics(
    snapshots: DataFrame, label: str = "will_purchase_next_7d", features: Sequence[str] = DIAGNOSED
) -> DataFrame:
    """Per feature: mean for positives and negatives and their difference, with the positive
    rate and its quality flag on every row. One pass over the rows."""
    present = [c for c in features if c in snapshots.columns]
    means = snapshots.agg(
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        *[F.avg(F.when(F.col(label) == 1, F.col(c).cast("double"))).alias(f"p_{c}") for c in present],
        *[F.avg(F.when(F.col(label) == 0, F.col(c).cast("double"))).alias(f"n_{c}") for c in present],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("pos_mean"), F.col(f"n_{c}").alias("neg_mean"))
            for c in present
        ]
    )
    rate = F.col("positive_rate")
    return means.select("positive_rate", F.inline(rows)).select(
        "feature",
        "pos_mean",
        "neg_mean",
        (F.col("pos_mean") - F.col("neg_mean")).alias("difference"),
        "positive_rate",
        F.when(rate < LOW_RATE, "too_few_positives")
        .when(rate < UNSTABLE_RATE, "unstable")
        .otherwise("ok")
        .alias("quality"),
    )

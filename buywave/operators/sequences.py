"""Supervised windows over trend series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY_COLUMNS = ("snapshot_date", "trend_id", "trend_type")


def sequence_windows(df: DataFrame, context: int, horizon: int) -> DataFrame:
    """One row per complete window of a trend: (trend_id, window_start, history, future, target).

    ``history`` holds ``context`` feature vectors, ``future`` the next ``horizon``; ``target``
    the ``target_*`` vectors of the future steps, or its last feature without such columns. A
    series of n points gives n - context - horizon + 1 windows.
    """
    if context <= 0 or horizon <= 0:
        raise ValueError("context and horizon must be positive")
    targets = [c for c in df.columns if c.startswith("target_")]
    features = [c for c in df.columns if c not in KEY_COLUMNS and c not in targets]
    vector = F.array(*[F.col(c).cast("float") for c in features])
    goal = F.array(*[F.col(c).cast("float") for c in (targets or features[-1:])])
    series = W.partitionBy("trend_id").orderBy("snapshot_date")
    ahead = series.rowsBetween(context, context + horizon - 1)
    windows = df.select(
        "trend_id",
        F.col("snapshot_date").alias("window_start"),
        F.collect_list(vector).over(series.rowsBetween(0, context - 1)).alias("history"),
        F.collect_list(vector).over(ahead).alias("future"),
        F.collect_list(goal).over(ahead).alias("target"),
    )
    return windows.filter(F.size("future") == horizon)

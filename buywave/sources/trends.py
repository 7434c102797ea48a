"""Trend files: service responses, the trend master table, tolerant reading."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from buywave.operators.trends import daily_series, normalize_types, trend_features, trend_stats
from buywave.schemas import TREND_DAILY, TREND_RESPONSE, TRENDS


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved trend responses, one JSON document per file."""
    return spark.read.schema(TREND_RESPONSE).option("multiLine", "true").json(path)


def write_trends_once(points: DataFrame, path: str) -> DataFrame:
    """Add features and write the master table unless it exists; return what is stored."""
    trend_features(normalize_types(points)).write.mode("ignore").parquet(path)
    return points.sparkSession.read.parquet(path)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    """The master table, or an empty one when it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], TRENDS)


def load_daily_trends(spark: SparkSession, path: str) -> DataFrame:
    """Gap-free daily trends; an absent, empty or differently shaped table gives an empty one.

    Other failures, as of permissions or the network, are raised.
    """
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], TREND_DAILY)
    return daily_series(stored)


def write_load_stats(trends: DataFrame, path: str) -> None:
    """Write the load statistics of a trend table (records, date range, queries, regions) as JSON."""
    trend_stats(trends).coalesce(1).write.mode("overwrite").json(path)

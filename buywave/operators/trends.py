"""External popularity trends: parsing, series features, daily calendar, join to snapshots.

A series is one (query, region) with at most one point per date, so windows over a series and
tables keyed by date are bounded by the number of calendar days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.functions.dates import trend_date
from buywave.schemas import TREND_DAILY, TREND_FEATURES

SERIES = ["query", "region"]
BASE_COLUMNS = {"date": "date", "query": "string", "region": "string", "popularity": "bigint"}


def flatten_response(
    responses: DataFrame,
    queries: Sequence[str],
    region: str | Column,
    loaded_at: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Points of a trend response: one row per timeline entry and query.

    The i-th value of an entry belongs to the i-th query; entries short of values give 0 and
    '0'. Entries without a readable date are left out.
    """
    entry = F.explode(F.col("interest_over_time.timeline_data"))
    place = region if isinstance(region, Column) else F.lit(region)
    points = (
        responses.select(*keep, place.alias("region"), entry.alias("entry"))
        .withColumn("date", trend_date("entry.date"))
        .filter(F.col("date").isNotNull())
        .select(
            *keep, "region", "date", "entry.values", F.posexplode(F.array(*[F.lit(q) for q in queries])).alias("i", "query")
        )
        .withColumn("point", F.try_element_at("values", F.col("i") + 1))
    )
    present = F.col("i") < F.coalesce(F.size("values"), F.lit(0))
    return points.select(
        *keep,
        "query",
        "region",
        "date",
        popularity_number("point.value").alias("popularity"),
        F.when(present & F.col("point.formattedValue").isNotNull(), F.col("point.formattedValue"))
        .otherwise(F.lit("0"))
        .alias("formatted_value"),
        (loaded_at if loaded_at is not None else F.current_timestamp()).alias("loaded_at"),
    )


def popularity_number(value: Column | str) -> Column:
    """Whole-number popularity; anything unreadable is 0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.floor(value.try_cast("double")), F.lit(0)).cast("bigint")


def normalize_types(trends: DataFrame) -> DataFrame:
    """Base columns with their types: midnight dates, whole-number popularity, absent ones null."""
    out = trends
    for name, kind in BASE_COLUMNS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("date", F.to_date("date")).withColumn("popularity", popularity_number("popularity"))


def _series() -> W:
    return W.partitionBy(*SERIES).orderBy("date")


def moving_averages(trends: DataFrame) -> DataFrame:
    """Means of the last 7 and 30 points of the series (points, not days)."""
    return trends.withColumns(
        {
            f"popularity_{n}d_avg": F.avg("popularity").over(_series().rowsBetween(-(n - 1), 0))
            for n in (7, 30)
        }
    )


def relative_change(value: Column, before: Column) -> Column:
    """``value / before - 1``; 0 without a previous point and for 0 to 0, infinite from 0."""
    infinite = F.when(value > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(before.isNull() | value.isNull(), F.lit(0.0))
        .when((before == 0) & (value == 0), F.lit(0.0))
        .when(before == 0, infinite)
        .otherwise(value.cast("double") / F.nullif(before, F.lit(0)) - 1)
    )


def changes(trends: DataFrame) -> DataFrame:
    """Relative change against the point 1 and 7 points back."""
    value = F.col("popularity")
    return trends.withColumns(
        {
            f"popularity_change_{n}d": relative_change(value, F.lag("popularity", n).over(_series()))
            for n in (1, 7)
        }
    )


def slope(trends: DataFrame) -> DataFrame:
    """(last - first) / number of points, the same on every row of the series."""
    whole = _series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rise = F.last("popularity").over(whole) - F.first("popularity").over(whole)
    return trends.withColumn("trend_slope", rise.cast("double") / F.count(F.lit(1)).over(whole))


def trend_features(trends: DataFrame) -> DataFrame:
    """The five feature columns of the trend table; one exchange on (query, region)."""
    return slope(changes(moving_averages(trends)))


def trend_daily(trends: DataFrame) -> DataFrame:
    """Mean and maximum popularity per date over all queries and regions."""
    points = trends.select(F.to_date("date").alias("date"), F.col("popularity").try_cast("double").alias("p"))
    return (
        points.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.avg("p").alias("trend_popularity_mean"), F.max("p").alias("trend_popularity_max"))
    )


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Repeat each date's values on the calendar days up to the next known date.

    ``daily`` has one row per date, so the ungrouped window sees at most the calendar.
    """
    follow = F.lead("date").over(W.orderBy("date"))
    return (
        daily.withColumn("_until", F.coalesce(F.date_sub(follow, 1), F.col("date")))
        .withColumn("date", F.explode(F.sequence("date", "_until")))
        .drop("_until")
    )


def daily_series(trends: DataFrame) -> DataFrame:
    """Gap-free daily trend table for the snapshot join; empty for tables without trends."""
    if not {"date", "popularity"} <= set(trends.columns):
        return trends.sparkSession.createDataFrame([], TREND_DAILY)
    return fill_calendar(trend_daily(trends))


def join_trends(snapshots: DataFrame, daily: DataFrame) -> DataFrame:
    """Trend columns of the exact snapshot date; null before and after the trend range.

    ``daily`` has one row per calendar day, which bounds the broadcast.
    """
    days = daily.select(F.col("date").alias("_trend_date"), *TREND_FEATURES)
    return snapshots.join(
        F.broadcast(days), F.col("snapshot_date") == F.col("_trend_date"), "left"
    ).drop("_trend_date")


def trend_stats(trends: DataFrame) -> DataFrame:
    """Load statistics: records, date range, sorted distinct queries and regions."""
    return (
        trends.groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
        .agg(
            F.sum("n").alias("total_records"),
            F.min("first").alias("first_date"),
            F.max("last").alias("last_date"),
            F.array_sort(F.collect_set("query")).alias("queries"),
            F.array_sort(F.collect_set("region")).alias("regions"),
        )
    )

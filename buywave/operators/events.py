"""Operators on the event table: normalisation, per-day and per-user aggregates, last events.

Users may be very uneven, so nothing here gathers a user's raw events in one task: events are
first reduced per (user, day), by partial aggregation or by a per-day group limit that already
runs before the shuffle. What remains per user is bounded by the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.functions.features import CLICK, PURCHASE


def normalize_loaded(df: DataFrame) -> DataFrame:
    """Types every operator expects: ``ts``, ``date`` of ``ts``, numeric ``price`` without gaps."""
    kind = dict(df.dtypes)["ts"]
    ts = F.col("ts") if kind.startswith("timestamp") else F.try_to_timestamp("ts")
    out = df.withColumn("ts", ts).withColumn("date", F.to_date("ts"))
    if "price" in df.columns:
        number = F.col("price").try_cast("double")
        out = out.withColumn("price", F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)))
    return out


def with_users(events: DataFrame) -> DataFrame:
    """Events that belong to a user; the others give no feature rows."""
    return events.filter(F.col("user_id").isNotNull())


def is_type(name: str) -> Column:
    return F.coalesce(F.col("event_type") == name, F.lit(False))


def event_stats(events: DataFrame) -> DataFrame:
    """Row count and date range of the loaded events."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def observed_dates(events: DataFrame) -> DataFrame:
    """Distinct dates in the data (at most one row per calendar day)."""
    return events.filter(F.col("date").isNotNull()).select("date").distinct()


def user_day(events: DataFrame) -> DataFrame:
    """Events, clicks, purchases and spend per user and day.

    Spend sums the price of every event type. All buffers are fixed-width, so this is a hash
    aggregation with a map-side part.
    """
    spend = (
        F.sum(F.coalesce(F.nanvl("price", F.lit(0.0)), F.lit(0.0)))
        if "price" in events.columns
        else F.lit(0.0)
    )
    return (
        with_users(events)
        .filter(F.col("date").isNotNull())
        .groupBy("user_id", "date")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(is_type(CLICK)).alias("clicks"),
            F.count_if(is_type(PURCHASE)).alias("purchases"),
            spend.alias("spent"),
        )
    )


def user_lifetime(events: DataFrame) -> DataFrame:
    """Lifetime counts, spend (0 without prices), first and last timestamp and active days per user."""
    days = (
        with_users(events)
        .groupBy("user_id", "date")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(is_type(CLICK)).alias("clicks"),
            F.count_if(is_type(PURCHASE)).alias("purchases"),
            (F.sum("price") if "price" in events.columns else F.lit(0.0)).alias("spent"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    return days.groupBy("user_id").agg(
        F.sum("events").alias("total_events"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("purchases").alias("total_purchases"),
        F.sum("spent").alias("total_spent"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.count("date").alias("unique_days"),
    )


def item_first_days(events: DataFrame) -> DataFrame:
    """First day of each item of a user; '' is an item, null is not."""
    return (
        with_users(events)
        .filter(F.col("item_id").isNotNull() & F.col("date").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(F.min("date").alias("date"))
    )


def distinct_items(events: DataFrame) -> DataFrame:
    """Distinct items per user over the whole history (0 rows for users without items)."""
    return item_first_days(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("distinct_items"))


def new_items_per_day(events: DataFrame) -> DataFrame:
    """Items a user touches for the first time, per day; running sums of it count distinct items."""
    return item_first_days(events).groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("new_items"))


def event_order(descending: bool = False) -> list[Column]:
    """Order of events: time, then id."""
    keys = [F.col("ts"), F.col("event_id")]
    return [k.desc() for k in keys] if descending else [k.asc() for k in keys]


def last_events_of_day(events: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` events of each user and day, numbered from the last one in ``rn``.

    The ``rn <= n`` filter lets Spark keep only n rows per (user, day) in every map task, so a
    busy user-day reaches the shuffle already reduced.
    """
    latest = W.partitionBy("user_id", "date").orderBy(*event_order(descending=True))
    return (
        with_users(events)
        .filter(F.col("date").isNotNull())
        .withColumn("rn", F.row_number().over(latest))
        .filter(F.col("rn") <= n)
    )


def last_event_per_day(events: DataFrame) -> DataFrame:
    """Type, region, item and time of the last event of each user and day."""
    context = [c for c in ("region", "item_id") if c in events.columns]
    wanted = events.select("user_id", "date", "ts", "event_id", "event_type", *context)
    return last_events_of_day(wanted, 1).drop("rn")


def last_events_of_user(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each user, numbered from the last one in ``rn``.

    Two steps, per day and then per user, so that a user with very many events brings at most
    n rows per day into the second step.
    """
    latest = W.partitionBy("user_id").orderBy(F.desc("date"), "rn")
    return (
        last_events_of_day(events, n)
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= n)
        .drop("rn", "ts", "event_id")
        .withColumnRenamed("_rank", "rn")
    )


def first_purchase_per_day(events: DataFrame) -> DataFrame:
    """Price of the first purchase of each user and day: (user_id, date, first_price)."""
    amount = F.coalesce(F.nanvl("price", F.lit(0.0)), F.lit(0.0))
    return (
        with_users(events)
        .filter((F.col("event_type") == PURCHASE) & F.col("date").isNotNull())
        .groupBy("user_id", "date")
        .agg(F.min_by(amount, F.struct("ts", "event_id")).alias("first_price"))
    )


def event_vocabulary(events: DataFrame) -> DataFrame:
    """Event types in order of first appearance: (event_type, position), position from 0.

    First timestamps come from a hash aggregation over (event_type, ts). Event ids are compared only
    among the types that share their first timestamp; null ids come last, then the type's name
    decides. The window holds one row per type.
    """
    typed = events.filter(F.col("event_type").isNotNull() & F.col("ts").isNotNull())
    starts = typed.groupBy("event_type").agg(F.min("ts").alias("ts"))
    shared = starts.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("ts"))).filter(F.col("_n") > 1).drop("_n")
    ids = (
        typed.select("event_type", "ts", "event_id")
        .join(shared, ["event_type", "ts"])
        .groupBy("event_type")
        .agg(F.min("event_id").alias("_first_id"))
    )
    order = W.orderBy("ts", F.col("_first_id").asc_nulls_last(), "event_type")
    return starts.join(ids, "event_type", "left").select(
        "event_type", (F.row_number().over(order) - 1).cast("int").alias("position")
    )


def fit_vocabulary(events: DataFrame) -> list[str]:
    """The types of ``event_vocabulary`` as a list: each becomes a column of the embedding."""
    return [row["event_type"] for row in event_vocabulary(events).orderBy("position").collect()]


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of event parts by column name; absent columns become null."""
    if not parts:
        raise ValueError("no parts to union")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

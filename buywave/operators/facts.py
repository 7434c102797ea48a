"""User-day facts: what the snapshots need of each user and day, small enough to be stored.

A day's rows follow from that day's events alone, so a stored table is extended by one day per run
and the raw events are read once. A row without a user marks each observed date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.operators import events as ev
from buywave.operators import history as hist

KEYS = ["user_id", "date"]
CONTEXT = ("region", "item_id")


def user_day_facts(events: DataFrame) -> DataFrame:
    """Per user and day: sums, first purchase, context of the last event, and ``recent_types``.

    ``recent_types`` holds the types of the day's last ``SEQUENCE_LENGTH`` events, newest first, so its
    size is fixed. All inputs are reduced in the map tasks before they meet on (user, day).
    """
    context = [c for c in CONTEXT if c in events.columns]
    last = F.col("rn") == 1
    ordered = F.sort_array(F.collect_list(F.struct("rn", "event_type")))
    recent = (
        ev.last_events_of_day(events.select(*KEYS, "ts", "event_id", "event_type", *context), hist.SEQUENCE_LENGTH)
        .groupBy(*KEYS)
        .agg(
            F.transform(ordered, lambda x: x["event_type"]).alias("recent_types"),
            *[F.max(F.when(last, F.col(c))).alias(c) for c in context],
        )
    )
    facts = recent.join(ev.user_day(events), KEYS)
    if "price" in events.columns:
        facts = facts.join(ev.first_purchase_per_day(events), KEYS, "left")
    return facts.unionByName(ev.observed_dates(events), allowMissingColumns=True)


def user_item_days(events: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id, date); '' is an item, null is not."""
    known = F.col("item_id").isNotNull() & F.col("date").isNotNull()
    return ev.with_users(events).filter(known).select("user_id", "item_id", "date").distinct()


def recent_rows(user_days: DataFrame, length: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per recent event of each user-day, numbered from the last one in ``rn``; ``keep``
    columns are carried by the last event only."""
    hist.check_sequence_length(length)
    if length > hist.SEQUENCE_LENGTH:
        raise ValueError(f"the facts hold {hist.SEQUENCE_LENGTH} events of a day")
    rows = ev.with_users(user_days).select(*KEYS, *keep, F.posexplode("recent_types").alias("rn", "event_type"))
    first = F.col("rn") == 0
    return rows.filter(F.col("rn") < length).select(
        *KEYS, (F.col("rn") + 1).alias("rn"), "event_type", *[F.when(first, F.col(c)).alias(c) for c in keep]
    )


def last_events_of_user(user_days: DataFrame, length: int) -> DataFrame:
    """The last ``length`` events of each user, numbered from the last one in ``rn``.

    Each active day has an event, so only the last ``length`` days of a user are unfolded; that limit
    already applies in the map tasks.
    """
    context = [c for c in CONTEXT if c in user_days.columns]
    newest = W.partitionBy("user_id").orderBy(F.desc("date"))
    days = (
        ev.with_users(user_days)
        .select(*KEYS, *context, "recent_types")
        .withColumn("_day", F.row_number().over(newest))
        .filter(F.col("_day") <= length)
    )
    along = W.partitionBy("user_id").orderBy(F.desc("date"), "rn")
    return (
        recent_rows(days, length, context)
        .withColumn("_rank", F.row_number().over(along))
        .filter(F.col("_rank") <= length)
        .drop("rn")
        .withColumnRenamed("_rank", "rn")
    )


def with_history(
    user_days: DataFrame, user_items: DataFrame | None, vocabulary: Sequence[str], length: int
) -> DataFrame:
    """User-days with new items and the type counts of the last ``length`` events so far."""
    days = ev.with_users(user_days)
    if user_items is not None:
        days = days.join(ev.new_items_per_day(user_items), KEYS, "left")
    else:
        days = days.withColumn("new_items", F.lit(0).cast("bigint"))
    keep = [c for c in days.columns if c not in (*KEYS, "recent_types")]
    return hist.type_counts_so_far(recent_rows(days, length, keep), vocabulary, length, keep)

"""Per-user state that is rolled from day to day, so that a daily run reads no history.

A user's row holds lifetime sums, the sums of the active days among the last ``WINDOW_DAYS`` (at most one entry
a day), the types of the last events and the context of the last one. All of it has a fixed size. Rolling
adds the facts of the days since, grouped by user, in one full outer join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.operators import events as ev
from buywave.operators import history as hist
from buywave.operators.facts import CONTEXT

WINDOW_DAYS = 30
SUMS = {"total_events": "events", "total_clicks": "clicks", "total_purchases": "purchases", "total_spent": "spent"}


def _within(days: Column, today: dt.date, window: int) -> Column:
    """The entries of the last ``window`` days, today included."""
    return F.filter(days, lambda d: d["date"] > F.lit(today - dt.timedelta(days=window)))


def fresh_state(user_days: DataFrame, today: dt.date) -> DataFrame:
    """The state that the given facts alone make, on the day ``today``.

    Only a user's newest ``SEQUENCE_LENGTH`` active days are gathered, a limit that already applies in the
    map tasks; each of them has an event, so they hold the last events.
    """
    days = ev.with_users(user_days)
    context = [c for c in CONTEXT if c in days.columns]
    sums = days.groupBy("user_id").agg(
        *[F.sum(c).alias(name) for name, c in SUMS.items()],
        F.count(F.lit(1)).alias("unique_days"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )
    newest = W.partitionBy("user_id").orderBy(F.desc("date"))
    entry = F.struct("date", *hist.METRICS, "recent_types", *context)
    recent = (
        days.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= hist.SEQUENCE_LENGTH)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(entry), asc=False).alias("_days"))
    )
    short = F.transform("_days", lambda d: F.struct(d["date"].alias("date"), *[d[m].alias(m) for m in hist.METRICS]))
    types = F.flatten(F.transform("_days", lambda d: d["recent_types"]))
    recent = recent.select(
        "user_id",
        _within(short, today, WINDOW_DAYS).alias("recent_days"),
        F.slice(types, 1, hist.SEQUENCE_LENGTH).alias("recent_types"),
        *[F.get("_days", F.lit(0))[c].alias(c) for c in context],
    )
    return sums.join(recent, "user_id")


def rolled(state: DataFrame | None, user_days: DataFrame, new_items: DataFrame | None, today: dt.date) -> DataFrame:
    """``state`` (None: of nobody) with the facts of the days after it, as of ``today``.

    ``new_items`` has (user_id, new_items): how many items a user touched for the first time on those days.
    """
    fresh = fresh_state(user_days, today)
    if new_items is not None:
        fresh = fresh.join(new_items, "user_id", "left")
    else:
        fresh = fresh.withColumn("new_items", F.lit(0).cast("bigint"))
    fresh = fresh.withColumn("distinct_items", F.coalesce("new_items", F.lit(0).cast("bigint"))).drop("new_items")
    if state is None:
        return fresh
    old, new = state.alias("old"), fresh.alias("new")
    both = old.join(new, F.col("old.user_id") == F.col("new.user_id"), "full_outer")
    active = F.col("new.user_id").isNotNull()

    def added(c: str) -> Column:
        zero = F.lit(0).cast(dict(fresh.dtypes)[c])
        return F.coalesce(F.col(f"old.{c}"), zero) + F.coalesce(F.col(f"new.{c}"), zero)

    def newest_first(c: str) -> Column:
        nothing = F.array().cast(dict(fresh.dtypes)[c])
        return F.concat(F.coalesce(f"new.{c}", nothing), F.coalesce(f"old.{c}", nothing))

    merged = {c: added(c) for c in (*SUMS, "unique_days", "distinct_items")}
    merged["first_day"] = F.least("old.first_day", "new.first_day")
    merged["last_day"] = F.greatest("old.last_day", "new.last_day")
    merged["recent_days"] = _within(newest_first("recent_days"), today, WINDOW_DAYS)
    merged["recent_types"] = F.slice(newest_first("recent_types"), 1, hist.SEQUENCE_LENGTH)
    for c in CONTEXT:
        if c in fresh.columns:
            merged[c] = F.when(active, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    user = F.coalesce("old.user_id", "new.user_id").alias("user_id")
    return both.select(user, *[merged[c].alias(c) for c in fresh.columns if c != "user_id"])


def state_columns(today: dt.date, windows: list[int], vocabulary: list[str], length: int) -> dict[str, Column]:
    """What a snapshot needs of the state: trailing sums, the last event's type and the counts of types."""
    if max(windows) > WINDOW_DAYS:
        raise ValueError(f"the state holds {WINDOW_DAYS} days")

    def trailing(metric: str, k: int) -> Column:
        zero = F.lit(0).cast(hist.METRICS[metric])
        return F.aggregate(_within(F.col("recent_days"), today, k), zero, lambda s, d: s + F.coalesce(d[metric], zero))

    last = F.slice("recent_types", 1, length)
    counts = {f"type_{i}": F.size(F.filter(last, lambda x: x == F.lit(name))).cast("bigint") for i, name in enumerate(vocabulary)}
    sums = {f"{m}_{k}": trailing(m, k) for k in windows for m in hist.METRICS}
    return {**sums, **counts, "event_type": F.get("recent_types", F.lit(0))}

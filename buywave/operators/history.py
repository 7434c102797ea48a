"""Point-in-time state of each user on each snapshot date.

The chain works on one row per user and active day. Everything that only changes on active
days (running totals, last event, embedding, next purchase) is computed there; the rows are
then repeated over the observed dates up to the next active day, which is both the spine and
the backward as-of join. Only the trailing k-day windows run on the repeated rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.functions.features import NO_PURCHASE_DAYS
from buywave.operators import events as ev
from buywave.schemas import SEQUENCE_PREFIX

SEQUENCE_LENGTH = 50
METRICS = {"events": "bigint", "purchases": "bigint", "spent": "double"}


# --- spine -----------------------------------------------------------------------------------


def last_date(events: DataFrame) -> Column:
    """Last observed date, as one value."""
    return events.agg(F.max("date")).scalar()


def expand_to_dates(
    user_days: DataFrame,
    events: DataFrame,
    horizon_days: int = 0,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Repeat each user-day over the observed dates from its day to before the next active day.

    ``user_days`` has one row per user and active ``date`` with ``next_date`` (null for the
    last). Dates less than ``horizon_days`` before the last one, before ``start`` or after ``end`` give no
    rows; they are cut off before the rows are repeated. The observed dates (one per calendar day) are
    numbered once and joined by broadcast, so a row costs only the dates it is repeated over.
    """
    observed = ev.observed_dates(events)
    numbered = observed.select("date", F.row_number().over(W.orderBy("date")).alias("position"))
    listed = observed.agg(F.array_sort(F.collect_list("date")).alias("dates"))

    def how_many(condition) -> Column:
        return F.size(F.filter("dates", condition))

    until = F.date_sub(F.try_element_at("dates", F.lit(-1)), horizon_days)
    if end is not None:
        until = F.least(until, F.lit(end))
    before = how_many(lambda d: d < F.lit(start)) if start is not None else F.lit(0)
    span = F.struct("dates", (before + 1).alias("first"), how_many(lambda d: d <= until).alias("last"))
    own = F.broadcast(numbered.select(F.col("date").alias("_own"), F.col("position").alias("_position")))
    follow = F.broadcast(numbered.select(F.col("date").alias("_follow"), F.col("position").alias("_next")))
    placed = (
        user_days.join(own, F.col("date") == F.col("_own"))
        .join(follow, F.col("next_date") == F.col("_follow"), "left")
        .withColumn("_span", listed.select(span.alias("span")).scalar())
    )
    low = F.greatest("_position", F.col("_span.first"))
    high = F.least(F.col("_next") - 1, F.col("_span.last"))  # nulls are passed over
    covered = F.slice("_span.dates", low, high - low + 1)
    return placed.filter(high >= low).select(*user_days.columns, F.explode(covered).alias("snapshot_date"))


def user_window() -> W:
    """A user's active days in time order."""
    return W.partitionBy("user_id").orderBy("date")


def snapshot_dates(events: DataFrame, horizon_days: int = 0) -> DataFrame:
    """The dates (``snapshot_date``) that the spine has, found without building it."""
    first = ev.with_users(events).agg(F.min("date")).scalar()
    until = F.date_sub(last_date(events), horizon_days)
    return ev.observed_dates(events).filter(F.col("date").between(first, until)).select(F.col("date").alias("snapshot_date"))


def with_next_date(user_days: DataFrame) -> DataFrame:
    return user_days.withColumn("next_date", F.lead("date").over(user_window()))


def snapshot_spine(events: DataFrame, horizon_days: int = 0) -> DataFrame:
    """(user_id, snapshot_date): each user on every observed date from the first active day on."""
    days = ev.with_users(events).select("user_id", "date").filter(F.col("date").isNotNull()).distinct()
    return expand_to_dates(with_next_date(days), events, horizon_days).select(
        "user_id", "snapshot_date"
    )


# --- state that changes on active days ---------------------------------------------------------


def running_user_totals(user_days: DataFrame) -> DataFrame:
    """Running totals per user (events, active days, clicks, purchases, spend, first day) and
    the next active day, all in one window pass."""
    days = user_window()
    so_far = days.rowsBetween(W.unboundedPreceding, 0)
    totals = {
        "total_events": F.sum("events").over(so_far),
        "unique_days": F.count(F.lit(1)).over(so_far),
        "total_clicks": F.sum("clicks").over(so_far),
        "total_purchases": F.sum("purchases").over(so_far),
        "total_spent": F.sum("spent").over(so_far),
        "first_day": F.min("date").over(so_far),
        "next_date": F.lead("date").over(days),
    }
    if "new_items" in user_days.columns:
        totals["distinct_items"] = F.coalesce(F.sum("new_items").over(so_far), F.lit(0))
    return user_days.withColumns(totals)


def next_purchase(user_days: DataFrame) -> DataFrame:
    """First purchase on a later day, as ``next_purchase`` (day, price).

    ``first_price`` is non-null on days with a purchase. Walking the days backwards keeps the
    frame growing, so each row is visited once.
    """
    later = W.partitionBy("user_id").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)
    bought = F.when(
        F.col("first_price").isNotNull(), F.struct(F.col("date").alias("day"), F.col("first_price").alias("price"))
    )
    return user_days.withColumn("next_purchase", F.last(bought, ignorenulls=True).over(later))


def purchase_targets(grid: DataFrame, horizon_days: int) -> DataFrame:
    """Targets from ``next_purchase``: it counts 1..horizon days after the snapshot."""
    return grid.withColumns(target_columns(horizon_days))


def target_columns(horizon_days: int) -> dict[str, Column]:
    days = F.datediff("next_purchase.day", "snapshot_date")
    hit = F.coalesce(days.between(1, horizon_days), F.lit(False))
    return {
        "will_purchase_next_7d": F.when(hit, 1).otherwise(0).cast("bigint"),
        "days_to_next_purchase": F.when(hit, days).otherwise(NO_PURCHASE_DAYS).cast("bigint"),
        "next_purchase_amount": F.when(hit, F.col("next_purchase.price")).otherwise(F.lit(0.0)),
    }


def recent_type_counts(
    events: DataFrame, vocabulary: Sequence[str], length: int, extra: DataFrame | None = None
) -> DataFrame:
    """Per user and active day: last event and type counts of the last ``length`` events so far.

    Columns: user_id, date, event_type, [region, item_id], type_0..type_{n-1}, and those of
    ``extra``, which has one row per (user_id, date). A null type takes a slot of the ``length``
    but is not counted. Rows come sorted by date within the user.

    A count over the last rows is the running count minus the running count ``length`` rows
    back: constant work per row, where a sliding frame would add up the whole frame again.
    """
    check_sequence_length(length)
    context = [c for c in ("region", "item_id") if c in events.columns]
    recent = ev.last_events_of_day(
        events.select("user_id", "date", "ts", "event_id", "event_type", *context), length
    )
    last = F.col("rn") == 1
    # From here the position in the day stands for (ts, event_id), and the context is only
    # carried by the last event of the day.
    recent = recent.select(
        "user_id", "date", "rn", "event_type", *[F.when(last, F.col(c)).alias(c) for c in context]
    )
    carried: list[str] = []
    if extra is not None:
        keys = ["user_id", "date"]
        carried = [c for c in extra.columns if c not in keys]
        side = extra.withColumnsRenamed({k: f"_{k}" for k in keys})
        # Only (user_id, date) are join keys: both sides are already hashed by them.
        same_day = (F.col("user_id") == F.col("_user_id")) & (F.col("date") == F.col("_date"))
        recent = recent.join(side, same_day & last, "left")
    return type_counts_so_far(recent, vocabulary, length, [*context, *carried])


def type_counts_so_far(recent: DataFrame, vocabulary: Sequence[str], length: int, carried: Sequence[str]) -> DataFrame:
    """The last event (``rn`` 1) of each user-day with the type counts of the last ``length`` rows so far.

    ``recent`` has user_id, date, rn, event_type and the ``carried`` columns.
    """
    last = F.col("rn") == 1
    kept = ["user_id", "date", "event_type", *carried]
    if not vocabulary:
        return recent.filter(last).select(*kept)
    along = W.partitionBy("user_id").orderBy("date", F.desc("rn"))
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    running = [F.count_if(ev.is_type(name)).over(so_far).alias(f"so_far_{i}") for i, name in enumerate(vocabulary)]
    counts = [
        (F.col(f"so_far_{i}") - F.lag(f"so_far_{i}", length, 0).over(along)).alias(f"type_{i}")
        for i in range(len(vocabulary))
    ]
    return recent.select(*kept, "rn", *running).select(*kept, "rn", *counts).filter(last).drop("rn")


def check_sequence_length(length: int) -> None:
    if length <= 0:
        raise ValueError("the sequence length must be positive")


def type_shares(vocabulary: Sequence[str]) -> list[Column]:
    """``seq_emb_i`` from ``type_i``: shares over the known types, zeros without any."""
    if not vocabulary:
        return []
    known = sum((F.col(f"type_{i}") for i in range(1, len(vocabulary))), F.col("type_0"))
    return [
        F.when(known > 0, F.col(f"type_{i}") / known).otherwise(F.lit(0.0)).alias(f"{SEQUENCE_PREFIX}{i}")
        for i in range(len(vocabulary))
    ]


# --- trailing windows on the spine ---------------------------------------------------------------


def rolling_activity(
    grid: DataFrame, windows: Iterable[int], metrics: Iterable[str] = ("events", "purchases", "spent")
) -> DataFrame:
    """Trailing sums ``<metric>_<k>`` over the k calendar days ending on the snapshot date.

    A repeated row counts only on the day it stems from. One sort serves all frames.
    """
    along = W.partitionBy("user_id").orderBy(F.unix_date("snapshot_date"))
    on_day = F.col("snapshot_date") == F.col("date")
    sums = []
    for k in sorted(set(windows)):
        frame = along.rangeBetween(-(k - 1), 0)
        for name in metrics:
            zero = F.lit(0).cast(METRICS[name])
            daily = F.when(on_day, F.col(name)).otherwise(zero)
            total = F.sum(daily).over(frame)
            sums.append(total.alias(f"{name}_{k}"))
    return grid.select("*", *sums)


# --- stand-alone forms ---------------------------------------------------------------------------


def running_totals(events: DataFrame) -> DataFrame:
    """Running totals of each user on every observed date."""
    days = running_user_totals(ev.user_day(events))  # carries next_date
    totals = ["total_events", "unique_days", "total_clicks", "total_purchases", "total_spent"]
    return expand_to_dates(days, events).select("user_id", "snapshot_date", *totals)


def rolling_on_spine(events: DataFrame, windows: Iterable[int]) -> DataFrame:
    grid = expand_to_dates(with_next_date(ev.user_day(events)), events)
    return rolling_activity(grid, windows)


def asof_last_event(events: DataFrame) -> DataFrame:
    """Last known event (type, region, item, ts) of each user as of every observed date."""
    grid = expand_to_dates(with_next_date(ev.last_event_per_day(events)), events)
    names = {"event_type": "last_event_type", "region": "last_region", "item_id": "last_item", "ts": "last_ts"}
    return grid.select(
        "user_id",
        "snapshot_date",
        *[F.col(c).alias(n) for c, n in names.items() if c in grid.columns],
    )


def next_purchase_target(events: DataFrame, horizon_days: int = 7) -> DataFrame:
    """Look-ahead targets on the training spine; the look-ahead itself sees all dates."""
    active = ev.with_users(events).select("user_id", "date").filter(F.col("date").isNotNull()).distinct()
    days = active.join(ev.first_purchase_per_day(events), ["user_id", "date"], "left")
    grid = expand_to_dates(with_next_date(next_purchase(days)), events, horizon_days)
    return purchase_targets(grid, horizon_days).select(
        "user_id",
        "snapshot_date",
        "will_purchase_next_7d",
        "days_to_next_purchase",
        "next_purchase_amount",
    )


def sequence_embedding(
    events: DataFrame, vocabulary: Sequence[str] | None = None, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Type shares of each user's last ``length`` events as of every observed date."""
    vocabulary = list(vocabulary) if vocabulary is not None else ev.fit_vocabulary(events)
    days = recent_type_counts(events, vocabulary, length)
    grid = expand_to_dates(with_next_date(days), events)
    return grid.select("user_id", "snapshot_date", *type_shares(vocabulary))


def running_distinct_items(events: DataFrame) -> DataFrame:
    """Distinct items of each user as of every active day."""
    active = ev.with_users(events).select("user_id", "date").filter(F.col("date").isNotNull()).distinct()
    days = active.join(ev.new_items_per_day(events), ["user_id", "date"], "left")
    so_far = user_window().rowsBetween(W.unboundedPreceding, 0)
    return days.select(
        "user_id", "date", F.coalesce(F.sum("new_items").over(so_far), F.lit(0)).alias("distinct_items")
    )

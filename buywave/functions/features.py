"""Column expressions of the snapshot features and of the scored output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURCHASE = "purchase"
CLICK = "click"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column) -> Column:
    """Text as a double, null when it is no number. Spark also reads a type letter (``12d``)."""
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def per_unit(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / max(1, denominator)`` as a double."""
    return _col(numerator).cast("double") / F.greatest(F.lit(1), _col(denominator))


def ratio_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` where the denominator is positive, else 0."""
    below = _col(denominator).cast("double")
    return F.when(below > 0, _col(numerator).cast("double") / below).otherwise(F.lit(0.0))


def derived_ratios() -> dict[str, Column]:
    """The five guarded ratios of a snapshot row."""
    return {
        "conversion_rate_30d": per_unit("purchases_last_30d", "events_last_30d"),
        "avg_order_value_30d": per_unit("spent_last_30d", "purchases_last_30d"),
        "purchase_frequency": per_unit("total_purchases", "unique_days"),
        "avg_spend_per_event": per_unit("total_spent", "total_events"),
        "events_per_day": per_unit("total_events", "unique_days"),
    }


def recency_score(days_since_last: Column | str = "days_since_last") -> Column:
    return F.lit(1.0) / (F.lit(1.0) + _col(days_since_last))


def micro_trend_ratios(short: int, long: int, with_price: bool = True) -> dict[str, Column]:
    """Short-over-long growth ratios from ``events_<k>``, ``purchases_<k>``, ``spent_<k>``."""
    ratios = {
        "micro_event_growth": ratio_or_zero(f"events_{short}", f"events_{long}"),
        "micro_purchase_growth": ratio_or_zero(f"purchases_{short}", f"purchases_{long}"),
        "micro_purchase_ratio": ratio_or_zero(f"purchases_{short}", f"events_{short}"),
    }
    if with_price:
        ratios["micro_spent_growth"] = ratio_or_zero(f"spent_{short}", f"spent_{long}")
    return ratios


def check_micro_windows(short: int, long: int) -> None:
    if short <= 0 or long <= 0:
        raise ValueError("window sizes must be positive")
    if short > long:
        raise ValueError("the short window must not exceed the long window")


# Limits of the stable output. Fixed values.
DAYS_TARGET_MAX = 30.0
DAYS_PRED_MIN = 0.1
DAYS_PRED_MAX = 30.0
AMOUNT_PRED_MIN = 10.0
NO_PURCHASE_DAYS = 999


def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high]; null stays null."""
    value = _col(value)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    # greatest/least skip nulls, so put the null back.
    return F.when(value.isNotNull(), out)


def days_target(days: Column | str = "days_to_next_purchase") -> Column:
    """Regression target: days until the purchase, clipped to 0..30."""
    return clip(_col(days).cast("double"), 0.0, DAYS_TARGET_MAX)


def clip_days(days: Column | str) -> Column:
    return clip(days, DAYS_PRED_MIN, DAYS_PRED_MAX)


def clip_amount(amount: Column | str) -> Column:
    return clip(amount, AMOUNT_PRED_MIN)


def predicted_class(proba: Column | str, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(proba) >= limit).cast("int")


def display_days(days: Column | str) -> Column:
    """The 'no purchase' marker 999 is shown as 0."""
    days = _col(days)
    return F.when(days == NO_PURCHASE_DAYS, F.lit(0.0)).otherwise(days.cast("double"))

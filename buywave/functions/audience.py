"""Column rules of the scored-audience view: segments, search, input shaping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buywave.functions.features import number

# Text-valued model inputs. Fixed values.
TEXT_INPUTS = ("last_event_type", "last_item", "last_region", "snapshot_date")


def _number(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def audience_segment() -> Column:
    """hot / warm / cold / ignore from probability and recent activity.

    Rules are tried in order; null inputs count as p = 0, prediction = 0, 7-day events = 0 and
    999 days since the last event.
    """
    p = _number("purchase_proba", 0)
    predicted = _number("will_purchase_pred", 0)
    events7 = _number("events_last_7d", 0)
    idle = _number("days_since_last", 999)
    # The limits are fixed values.
    return (
        F.when((p >= 0.7) & (idle <= 30), "hot")
        .when((p >= 0.3) & ((events7 >= 3) | (idle <= 14)), "warm")
        .when(p >= 0.1, "cold")
        .when(predicted == 0, "ignore")
        .otherwise("cold")
    )


def segment_label(segment: Column | str = "segment") -> Column:
    """Display name of a segment."""
    segment = F.col(segment) if isinstance(segment, str) else segment
    # Fixed values.
    return (
        F.when(segment == "hot", "Hot Audience")
        .when(segment == "warm", "Promising")
        .when(segment == "cold", "Weak Interest")
        .otherwise("Non-target now")
    )


def segment_reason(segment: Column | str = "segment") -> Column:
    """One sentence that explains the segment."""
    segment = F.col(segment) if isinstance(segment, str) else segment
    percent = F.format_string("%.0f%%", _number("purchase_proba", 0) * 100)
    fine = F.format_string("%.1f%%", _number("purchase_proba", 0) * 100)
    return (
        F.when(
            segment == "hot",
            F.concat(
                F.lit("Chance of purchase "),
                percent,
                F.lit("; last active "),
                _number("days_since_last", 999).cast("long").cast("string"),
                F.lit(" days ago; events in 7 days: "),
                _number("events_last_7d", 0).cast("long").cast("string"),
            ),
        )
        .when(segment == "warm", F.concat(F.lit("Chance of purchase "), percent, F.lit("; recently active")))
        .when((segment == "cold") & (_number("purchase_proba", 0) >= 0.1), F.concat(F.lit("Chance of purchase "), percent, F.lit("; weak signals")))
        # Below that limit a user is cold only if a purchase is predicted all the same.
        .when(segment == "cold", F.concat(F.lit("Chance of purchase "), percent))
        .otherwise(F.concat(F.lit("Chance of purchase "), fine, F.lit("; very low")))
    )


def activity_share() -> Column:
    """Share of the 30-day activity that fell into the last 7 days, in percent (0..100)."""
    e7 = _number("events_last_7d", 0)
    e30 = _number("events_last_30d", 0)
    return F.when(e30 > 0, F.least(F.lit(100.0), e7 / e30 * 100)).otherwise(F.lit(0.0))


def matches_user(text: str, user_id: str = "user_id") -> Column:
    """Case-insensitive 'contains' on the trimmed search text; empty text matches all."""
    needle = (text or "").strip().lower()
    if not needle:
        return F.lit(True)
    return F.contains(F.lower(F.col(user_id).cast("string")), F.lit(needle))


def short_id(user_id: str = "user_id") -> Column:
    """The part of the id before its first dash."""
    return F.split_part(F.col(user_id).cast("string"), F.lit("-"), F.lit(1))


def shape_input(df: DataFrame, feature: str) -> Column:
    """One model input: text features keep their text or '', others their number or 0.

    A numeric feature counts only if it arrives as a number; text in it becomes 0.
    """
    if feature not in df.columns:
        return F.lit("" if feature in TEXT_INPUTS else 0.0).alias(feature)
    if feature in TEXT_INPUTS:
        return F.coalesce(F.col(feature).cast("string"), F.lit("")).alias(feature)
    kind = dict(df.dtypes)[feature]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if not numeric:
        return F.lit(0.0).alias(feature)
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0)).alias(feature)


def shape_inputs(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ("user_id",)) -> DataFrame:
    """Model-input rows in the order of ``features``."""
    return df.select(*[c for c in keep if c in df.columns], *[shape_input(df, f) for f in features])


def entered_value(feature: str, text: Column | str) -> Column:
    """Hand-entered value: ``last*`` fields stay text, others are the leading number or 0."""
    text = F.col(text) if isinstance(text, str) else text
    if feature.lower().startswith("last"):
        return F.coalesce(text, F.lit(""))
    leading = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(leading.try_cast("double"), F.lit(0.0))


def invalid_fields(df: DataFrame, features: Iterable[str]) -> Column:
    """Names of the fields a record must fill in before it can be scored.

    Text fields are invalid when absent; others when absent or not a number. A null in a
    numeric field is read as 0 and is valid, and so is blank text.
    """
    flags = []
    for feature in features:
        if feature not in df.columns:
            flags.append(F.lit(feature))
        elif feature in TEXT_INPUTS:
            flags.append(F.when(F.col(feature).isNull(), F.lit(feature)))
        else:
            kind = dict(df.dtypes)[feature]
            value = F.col(feature)
            if kind == "string":
                blank = F.trim(value) == ""
                bad = value.isNotNull() & ~blank & number(value).isNull()
                bad = bad | F.coalesce(F.isnan(number(value)), F.lit(False))
            else:
                bad = F.isnan(value.cast("double"))
            flags.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(feature)))
    return F.filter(F.array(*flags), lambda f: f.isNotNull())

"""Scored users: ranking, search, joins with the users table, prediction history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buywave.functions import audience as rules

HISTORY_LENGTH = 20
NO_USER_LABEL = "Manual Input"


def rank_users(scored: DataFrame) -> DataFrame:
    """Users by descending purchase probability, unscored ones last, ties by id."""
    return scored.orderBy(F.desc_nulls_last("purchase_proba"), "user_id")


def segment_users(scored: DataFrame) -> DataFrame:
    """Segment, label, reason, activity share and short id of each scored user."""
    return scored.withColumn("segment", rules.audience_segment()).withColumns(
        {
            "segment_label": rules.segment_label(),
            "segment_reason": rules.segment_reason(),
            "activity_share": rules.activity_share(),
            "short_id": rules.short_id(),
        }
    )


def search_users(users: DataFrame, text: str) -> DataFrame:
    return users.filter(rules.matches_user(text))


def users_features(users: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every user with its snapshot features; users without a snapshot keep nulls.

    Both sides have one row per user, so no key is hot.
    """
    ids = users.select(F.col("user_uid").cast("string").alias("user_id"))
    return ids.join(snapshot, "user_id", "left")


def user_record(users: DataFrame, user_id: str) -> DataFrame:
    """The row of one user (a pushed-down equality)."""
    return users.filter(F.col("user_id") == user_id)


def recent_predictions(
    predictions: DataFrame, history: str = "user_id", at: str = "ts", tie: str = "event_id", n: int = HISTORY_LENGTH
) -> DataFrame:
    """The latest ``n`` predictions of each history, newest first in ``rn``.

    The row limit already applies in the map tasks.
    """
    newest = W.partitionBy(history).orderBy(F.desc(at), F.desc(tie))
    return predictions.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def prediction_stats(predictions: DataFrame, history: str = "user_id", at: str = "ts") -> DataFrame:
    """Number and latest time of predictions per user; hand-entered ones share one label."""
    owner = F.coalesce(F.nullif(F.col(history).cast("string"), F.lit("")), F.lit(NO_USER_LABEL))
    return predictions.groupBy(owner.alias("user")).agg(
        F.count(F.lit(1)).alias("predictions"), F.max(at).alias("last_prediction")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with numbers: the metrics that can be charted."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in df.dtypes if kind in kinds or kind.startswith("decimal")]


def prediction_series(history: DataFrame, output: str = "output", inputs: str = "input") -> DataFrame:
    """Prediction log flattened to one row per prediction: outputs plus numeric inputs.

    ``output`` and ``inputs`` are struct columns; an input overrides an output of the same name.
    """
    number_inputs = numeric_columns(history.select(f"{inputs}.*"))
    kept = [c for c in history.select(f"{output}.*").columns if c not in number_inputs]
    others = [c for c in history.columns if c not in (output, inputs)]
    return history.select(
        *others,
        *[F.col(f"{output}.{c}").alias(c) for c in kept],
        *[F.col(f"{inputs}.{c}").alias(c) for c in number_inputs],
    )

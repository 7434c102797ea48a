"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw event table and event Parquet parts.
EVENT_COLUMNS = [
    "event_id",
    "event_type",
    "ts",
    "session_id",
    "user_id",
    "region",
    "item_id",
    "price",
    "properties",
]

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("properties", T.StringType()),
    ]
)

# Fields a collected JSON message must carry as text.
REQUIRED_MESSAGE_FIELDS = [
    "event_id",
    "event_type",
    "timestamp",
    "session_id",
    "user_id",
    "region",
]

USERS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("user_uid", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Popularity points of a query in a region.
TRENDS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("popularity", T.LongType()),
        T.StructField("formatted_value", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("popularity_7d_avg", T.DoubleType()),
        T.StructField("popularity_30d_avg", T.DoubleType()),
        T.StructField("popularity_change_1d", T.DoubleType()),
        T.StructField("popularity_change_7d", T.DoubleType()),
        T.StructField("trend_slope", T.DoubleType()),
    ]
)

# Nested response a trend service returns for one batch of queries.
TREND_RESPONSE = T.StructType(
    [
        T.StructField(
            "interest_over_time",
            T.StructType(
                [
                    T.StructField(
                        "timeline_data",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("date", T.StringType()),
                                    T.StructField(
                                        "values",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("value", T.StringType()),
                                                    T.StructField("formattedValue", T.StringType()),
                                                ]
                                            )
                                        ),
                                    ),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

TREND_DAILY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("trend_popularity_mean", T.DoubleType()),
        T.StructField("trend_popularity_max", T.DoubleType()),
    ]
)

# Snapshot columns, in order. The micro_* columns follow the targets.
SNAPSHOT_KEYS = ["snapshot_date", "user_id"]
LIFETIME_FEATURES = [
    "total_events",
    "unique_days",
    "total_clicks",
    "total_purchases",
    "total_spent",
    "distinct_items",
]
ROLLING_FEATURES = [
    "events_last_7d",
    "events_last_30d",
    "purchases_last_30d",
    "spent_last_30d",
]
RATIO_FEATURES = [
    "conversion_rate_30d",
    "avg_order_value_30d",
    "purchase_frequency",
    "avg_spend_per_event",
]
RECENCY_FEATURES = ["days_since_first", "days_since_last", "events_per_day", "recency_score"]
CONTEXT_FEATURES = ["last_event_type", "last_region", "last_item"]
TARGETS = ["will_purchase_next_7d", "days_to_next_purchase", "next_purchase_amount"]
MICRO_FEATURES = [
    "micro_event_growth",
    "micro_purchase_growth",
    "micro_purchase_ratio",
    "micro_spent_growth",
]
TREND_FEATURES = ["trend_popularity_mean", "trend_popularity_max"]
SNAPSHOT_CORE = (
    SNAPSHOT_KEYS
    + LIFETIME_FEATURES
    + ROLLING_FEATURES
    + RATIO_FEATURES
    + RECENCY_FEATURES
    + CONTEXT_FEATURES
)
SEQUENCE_PREFIX = "seq_emb_"

PREDICTIONS = [
    "purchase_proba",
    "will_purchase_pred",
    "days_to_next_pred",
    "next_purchase_amount_pred",
]

# Columns that are never model inputs.
NON_FEATURES = ["snapshot_date", "user_id", "last_ts", "index", *TARGETS]

"""Queries on raw JSON messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from buywave.streaming import ingest
from query_catalog import fixtures as fixture
from query_catalog.fixtures import MESSAGES_SQL
from query_catalog.registry import query, with_views


@query(
    "event_contract",
    with_views(
        MESSAGES_SQL,
        """SELECT seq, readable AND seq % 29 <> 0 AS accepted,
                  CASE WHEN readable THEN CASE WHEN seq % 29 = 0 THEN 'user_id' ELSE '' END
                       ELSE 'event_id,event_type,timestamp,session_id,user_id,region' END AS missing
           FROM fx_messages""",
    ),
)
def event_contract(spark, sf_dir):
    return ingest.event_contract(fixture.messages(spark, sf_dir)).select(
        "seq", "accepted", F.array_join("missing", ",").alias("missing")
    )


@query("drop_malformed", with_views(MESSAGES_SQL, "SELECT seq FROM fx_messages WHERE readable"))
def drop_malformed(spark, sf_dir):
    return ingest.drop_malformed(fixture.messages(spark, sf_dir)).select("seq")


@query(
    "normalize_events",
    with_views(
        MESSAGES_SQL,
        """SELECT CAST(seq AS VARCHAR) AS event_id, event_type,
                  CASE WHEN seq % 13 = 0 THEN TIMESTAMP '2024-02-01 00:00:00'
                       WHEN seq % 2 = 0 THEN date_trunc('second', ts)
                       ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS ts,
                  's' AS session_id, CASE WHEN seq % 29 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
                  'UA-30' AS region, CASE WHEN seq % 17 = 0 THEN '' ELSE CONCAT('item_', k) END AS item_id,
                  CASE WHEN seq % 17 = 0 OR seq % 11 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS price, properties
           FROM fx_messages WHERE readable""",
    ),
)
def normalize_events(spark, sf_dir):
    events = ingest.events_from_messages(fixture.messages(spark, sf_dir))
    # The oracle's timestamps carry no zone; the session zone is UTC.
    return events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "props_extract",
    """SELECT event_id, COALESCE(json_extract_string(props, '$.k'), '') AS item_id,
              TRY_CAST(json_extract_string(props, '$.price') AS DOUBLE) AS price, props AS properties FROM events""",
)
def props_extract(spark, sf_dir):
    raw = fixture.table(spark, sf_dir, "events")
    return raw.select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("item_id"),
        ingest.price(F.col("props")).alias("price"),
        F.coalesce("props", F.lit("{}")).alias("properties"),
    )

"""Event ingestion: JSON messages to the event table, as a stream or as a batch.

The same functions run on both; offsets, retries and exactly-once files come from the stream's
checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buywave.functions.features import number
from buywave.schemas import EVENT_COLUMNS, REQUIRED_MESSAGE_FIELDS

MESSAGE_SCHEMA = (
    "event_id string, event_type string, timestamp string, session_id string, "
    "user_id string, region string, properties string, _corrupt string"
)
#: The fields that are read out of a message's properties.
DETAIL_SCHEMA = "item_id string, price string"
BATCH_SECONDS = 0.5
ROWS_PER_BATCH = 500_000


def kafka_source(
    spark: SparkSession, servers: str, topic: str = "raw-events", rows_per_batch: int | None = ROWS_PER_BATCH
) -> DataFrame:
    """(value, ingest_ts) of a Kafka topic from the earliest offset.

    ``rows_per_batch`` bounds a micro-batch over all partitions, so that the first one is not the whole
    topic; None leaves it unbounded.
    Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts")
    )


def file_source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(value, ingest_ts) of text files with one JSON message per line, as they arrive.

    The arrival time of the file stands for the ingest time, so a replay gives the same rows.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        "value", F.col("_metadata.file_modification_time").alias("ingest_ts")
    )


def parse_messages(messages: DataFrame) -> DataFrame:
    """Add ``event`` (parsed fields) and ``readable`` to rows with a JSON text ``value``.

    Readable means: a JSON object whose ``properties``, if given, is an object.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # The one-element explode keeps later filters above the parse, so that each message is
    # parsed once and not again for every condition.
    event = F.from_json("value", MESSAGE_SCHEMA, options)
    parsed = messages.select("*", F.explode(F.array(event)).alias("event"))
    is_object = F.startswith(F.ltrim(F.col("event.properties")), F.lit("{"))
    readable = F.col("event").isNotNull() & F.col("event._corrupt").isNull() & F.coalesce(is_object, F.lit(True))
    return parsed.withColumn("readable", F.coalesce(readable, F.lit(False)))


def drop_malformed(messages: DataFrame) -> DataFrame:
    """Readable messages only."""
    return parse_messages(messages).filter("readable").drop("readable")


def malformed_count() -> Column:
    """Aggregate for ``DataFrame.observe``: how many parsed messages are not readable."""
    return F.count_if(~F.col("readable")).alias("malformed")


def missing_fields() -> Column:
    """Required fields that a parsed message lacks."""
    flags = [F.when(F.col(f"event.{c}").isNull(), F.lit(c)) for c in REQUIRED_MESSAGE_FIELDS]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def event_contract(messages: DataFrame) -> DataFrame:
    """Add ``accepted`` and the ``missing`` required fields; absent properties are allowed."""
    parsed = parse_messages(messages).withColumn("missing", missing_fields())
    return parsed.withColumn("accepted", F.col("readable") & (F.size("missing") == 0))


def parse_time(text: Column, otherwise: Column) -> Column:
    """ISO time as an instant; without an offset it is UTC; unreadable text gives ``otherwise``.

    A full date is required: a time alone, a year or a month is unreadable. Milliseconds are kept,
    finer digits cut.
    """
    has_date = text.rlike(r"^\s*[+-]?\d{4,}-\d{2}-\d{2}(?:[T ]|\s*$)")
    has_offset = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    has_time = text.rlike(r"\d[T ]\d{2}")
    iso = F.when(has_date, F.when(has_offset | ~has_time, text).otherwise(F.concat(text, F.lit("Z"))))
    return F.coalesce(F.date_trunc("millisecond", F.try_to_timestamp(iso)), otherwise)


def normalize_events(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The nine event columns from parsed messages with an ``ingest_ts`` column, and the columns ``keep``."""
    # Item and price in one parse of the properties; the explode keeps it one.
    parsed = parsed.select("*", F.explode(F.array(F.from_json("event.properties", DETAIL_SCHEMA))).alias("details"))
    event = {c: F.coalesce(F.col(f"event.{c}"), F.lit("")) for c in REQUIRED_MESSAGE_FIELDS}
    properties = F.coalesce(F.col("event.properties"), F.lit("{}"))
    return parsed.select(
        event["event_id"].alias("event_id"),
        event["event_type"].alias("event_type"),
        parse_time(F.col("event.timestamp"), F.col("ingest_ts")).alias("ts"),
        event["session_id"].alias("session_id"),
        event["user_id"].alias("user_id"),
        event["region"].alias("region"),
        F.coalesce("details.item_id", F.lit("")).alias("item_id"),
        number(F.col("details.price")).alias("price"),
        properties.alias("properties"),
        *keep,
    )


def price(properties: Column) -> Column:
    """Numeric price, null when absent or unreadable."""
    return number(F.get_json_object(properties, "$.price"))


def events_from_messages(messages: DataFrame) -> DataFrame:
    """Messages to events, leaving out the unreadable ones."""
    return normalize_events(drop_malformed(messages))


def rejected_messages(messages: DataFrame) -> DataFrame:
    """Messages that are unreadable or lack required fields, for a quarantine table."""
    return event_contract(messages).filter(~F.col("accepted")).select("value", "ingest_ts", "missing")


def start_append(
    events: DataFrame,
    path: str,
    checkpoint: str,
    seconds: float = BATCH_SECONDS,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Append events to the Parquet table at ``path``, partitioned by event date.

    Runs a micro-batch every ``seconds``, or drains what is there and stops.
    """
    if events.columns != EVENT_COLUMNS:
        raise ValueError(f"events must have the columns {EVENT_COLUMNS}")
    dated = events.withColumn("date", F.to_date("ts"))
    return start_parquet(dated, path, checkpoint, seconds, available_now, name, ["date"])


def start_parquet(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    seconds: float = BATCH_SECONDS,
    available_now: bool = False,
    name: str | None = None,
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def start_ingest(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    quarantine: str | None = None,
    seconds: float = BATCH_SECONDS,
    available_now: bool = False,
) -> list[StreamingQuery]:
    """The whole ingest: accepted messages to the event table, rejected ones to quarantine."""
    accepted = event_contract(messages).filter("accepted")
    queries = [start_append(normalize_events(accepted), path, f"{checkpoint}/events", seconds, available_now)]
    if quarantine:
        queries.append(
            start_parquet(rejected_messages(messages), quarantine, f"{checkpoint}/quarantine", seconds, available_now)
        )
    return queries

"""Ingest in micro-batches that are written once each: events, rejected messages and counts from one read.

Below one folder lie ``landing`` (what the batches wrote, by kind, date and batch), ``counts`` (a row for each
batch) and ``events`` (closed dates, rewritten to few files). A batch that is done again after a failure
replaces its own folders, so nothing is lost or stored twice, and there is no log of the sink that would hide the
rewriting from readers.

Readers take closed dates from ``events`` and later ones from ``landing``; the date up to which dates are closed is
moved on last, so a rewriting that is stopped changes nothing they see.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buywave.schemas import EVENT_COLUMNS
from buywave.sources.snapshots import read_metadata, write_metadata
from buywave.streaming import ingest

ACCEPTED, REJECTED = "accepted", "rejected"
ROWS_PER_FILE = 1_000_000
_EVENTS = (
    "event_id string, event_type string, ts timestamp, session_id string, user_id string, region string, "
    "item_id string, price double, properties string"
)
_LANDED = f"{_EVENTS}, value string, ingest_ts timestamp, missing array<string>, kind string, date date, batch bigint"
_CLOSED = f"{_EVENTS}, batch bigint, date date"
_COUNTS = "messages bigint, malformed bigint, accepted bigint, rejected bigint, batch bigint"


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _day(date: dt.date) -> Column:
    """The date as a value; the earliest one that Python has would not pass as such."""
    return F.lit(date.isoformat()).cast("date")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def land_batch(messages: DataFrame, batch: int, base: str) -> None:
    """Write one batch of messages (value, ingest_ts): events and rejected messages in one job, then its counts.

    The messages are read and parsed once. The counts are observed while they pass.
    """
    spark = messages.sparkSession
    checked = ingest.event_contract(messages)
    observation = Observation(f"batch {batch}")
    counted = checked.observe(
        observation,
        F.count(F.lit(1)).alias("messages"),
        ingest.malformed_count(),
        F.count_if(F.col("accepted")).alias("accepted"),
    )
    ok = F.col("accepted")
    kept = ["value", "ingest_ts", "missing"]
    events = ingest.normalize_events(counted, keep=["accepted", *kept])
    rows = events.select(
        *[F.when(ok, F.col(c)).alias(c) for c in EVENT_COLUMNS],
        *[F.when(~ok, F.col(c)).alias(c) for c in kept],
        F.when(ok, ACCEPTED).otherwise(REJECTED).alias("kind"),
        F.when(ok, F.to_date("ts")).otherwise(F.to_date("ingest_ts")).alias("date"),
        F.lit(batch).cast("bigint").alias("batch"),
    )
    _replace(rows, f"{base}/landing", "kind", "date", "batch")
    found = observation.get
    counts = (found["messages"], found["malformed"], found["accepted"], found["messages"] - found["accepted"], batch)
    _replace(spark.createDataFrame([counts], _COUNTS).coalesce(1), f"{base}/counts", "batch")


def start_batches(
    messages: DataFrame,
    base: str,
    checkpoint: str,
    seconds: float = ingest.BATCH_SECONDS,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """The whole ingest of a stream of messages, one ``land_batch`` for each micro-batch."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: land_batch(batch, number, base))
    if name:
        writer = writer.queryName(name)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def closed_until(spark: SparkSession, base: str) -> dt.date:
    """The last date that readers take from the rewritten files."""
    try:
        return dt.date.fromisoformat(read_metadata(spark, f"{base}/closed")["until"])
    except (AnalysisException, TypeError):  # not written yet
        return dt.date.min


def compact(spark: SparkSession, base: str, until: dt.date, rows_per_file: int = ROWS_PER_FILE) -> list[dt.date]:
    """Rewrite the dates up to ``until`` that have landed batches to files of at most ``rows_per_file`` rows.

    Batches that landed for a date closed earlier are added to it; batches that are in it already are
    replaced, so the job can be repeated. Returns the dates rewritten. The landed folders of closed dates are no
    longer read and may be deleted (``landed_folders``).
    """
    landed = _stored(spark, f"{base}/landing", _LANDED).filter((F.col("kind") == ACCEPTED) & (F.col("date") <= _day(until)))
    before = _stored(spark, f"{base}/events", _CLOSED)
    batches = landed.select("date", "batch").distinct()
    old = before.select("date", "batch").distinct()
    # A date is rewritten if a landed batch is not in it. One row for each date and batch.
    open_ = batches.join(old, ["date", "batch"], "left_anti").select("date").distinct()
    dates = sorted(r["date"] for r in open_.collect())
    if dates:
        columns = [*EVENT_COLUMNS, "batch", "date"]
        fresh = landed.filter(F.col("date").isin(dates)).select(*columns)
        stay = before.filter(F.col("date").isin(dates)).join(batches, ["date", "batch"], "left_anti").select(*columns)
        rows = stay.unionByName(fresh).hint("rebalance", "date").sortWithinPartitions("date", "ts")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "maxRecordsPerFile", rows_per_file
        ).partitionBy("date").parquet(f"{base}/events")
    if until > closed_until(spark, base):
        write_metadata(spark, {"until": until.isoformat()}, f"{base}/closed")
    return dates


def landed_folders(spark: SparkSession, base: str) -> list[str]:
    """The landed folders whose events all lie in closed dates, for deletion."""
    until = closed_until(spark, base)
    landed = _stored(spark, f"{base}/landing", _LANDED).filter((F.col("kind") == ACCEPTED) & (F.col("date") <= _day(until)))
    closed = _stored(spark, f"{base}/events", _CLOSED).select("date", "batch").distinct()
    safe = landed.select("date", "batch").distinct().join(closed, ["date", "batch"])
    return [f"{base}/landing/kind={ACCEPTED}/date={r['date']}/batch={r['batch']}" for r in safe.orderBy("date", "batch").collect()]


def read_events(spark: SparkSession, base: str) -> DataFrame:
    """The event columns and ``date`` of all events: closed dates from their few files, later ones as they landed."""
    until = closed_until(spark, base)
    closed = _stored(spark, f"{base}/events", _CLOSED).filter(F.col("date") <= _day(until))
    landed = _stored(spark, f"{base}/landing", _LANDED).filter((F.col("kind") == ACCEPTED) & (F.col("date") > _day(until)))
    return closed.select(*EVENT_COLUMNS, "date").unionByName(landed.select(*EVENT_COLUMNS, "date"))


def read_rejected(spark: SparkSession, base: str) -> DataFrame:
    """Messages that are unreadable or lack required fields: value, ingest_ts, missing."""
    rows = _stored(spark, f"{base}/landing", _LANDED).filter(F.col("kind") == REJECTED)
    return rows.select("value", "ingest_ts", "missing")


def read_counts(spark: SparkSession, base: str) -> DataFrame:
    """Messages, malformed, accepted and rejected ones of each batch."""
    return _stored(spark, f"{base}/counts", _COUNTS)

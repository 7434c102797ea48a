"""Throughput of the event flow in two-second ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buywave.operators.ordering import running_totals

TICK_SECONDS = 2
RECENT_TICKS = 20
CHUNK_SECONDS = 3_600


def stream_ticks(stream: DataFrame, time: str = "ingest_ts", lateness: str = "10 seconds") -> DataFrame:
    """Streaming counts and rates per tumbling tick of the ingest time."""
    ticks = (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, f"{TICK_SECONDS} seconds"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return ticks.select(
        F.col("window.start").alias("tick"),
        "events",
        (F.col("events") / TICK_SECONDS).alias("rate"),
    )


def event_rate(events: DataFrame, time: str = "ts") -> DataFrame:
    """Per tick with events: its rate, the mean of the last 20 tick rates, the rate so far.

    Ticks are seconds since 1970 cut to two; ticks without events count as rate 0 in both
    means, which start with the first tick of the data.
    """
    second = F.unix_seconds(F.col(time).cast("timestamp"))
    ticks = (
        events.select((F.floor(second / TICK_SECONDS) * TICK_SECONDS).cast("bigint").alias("tick"))
        .filter(F.col("tick").isNotNull())
        .groupBy("tick")
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return tick_rates(ticks, ticks.agg(F.min("tick")).scalar())


REACH = TICK_SECONDS * (RECENT_TICKS - 1)


def tick_rates(ticks: DataFrame, first: Column, before: int = 0) -> DataFrame:
    """The rates of counted ticks (tick, events), of which ``first`` is the first of all and ``before`` the events
    that came before these."""
    summed = running_totals(ticks, ["tick"], {"so_far": "events"})
    # The trailing sum runs per chunk of time. A tick close to the end of its chunk also goes
    # to the next chunk, as context only.
    own = F.floor(F.col("tick") / CHUNK_SECONDS)
    also = F.floor((F.col("tick") + REACH) / CHUNK_SECONDS)
    chunked = summed.withColumn("chunk", F.explode(F.array_distinct(F.array(own, also))))
    recent = W.partitionBy("chunk").orderBy("tick").rangeBetween(-REACH, 0)
    elapsed = (F.col("tick") - first) / TICK_SECONDS + 1
    return (
        chunked.withColumn("recent", F.sum("events").over(recent))
        .filter(F.col("chunk") == own)
        .select(
            "tick",
            "events",
            (F.col("events") / TICK_SECONDS).alias("rate"),
            (F.col("recent") / (TICK_SECONDS * F.least(F.lit(RECENT_TICKS), elapsed))).alias("recent_rate"),
            ((F.col("so_far") + before) / (TICK_SECONDS * elapsed)).alias("overall_rate"),
        )
    )


def start_rates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    time: str = "ingest_ts",
    lateness: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Store the rates of ``event_rate`` below ``path`` while events come in, one folder for each micro-batch.

    A tick is written once the watermark has passed it, so later batches have later ticks only. What a batch
    needs of the earlier ones are the last ticks within reach, the first tick and the events so far: these
    are read from the stored rates. A batch that is done again replaces its own folder.
    """
    spark = stream.sparkSession

    def write(ticks: DataFrame, batch: int) -> None:
        new = ticks.select(F.unix_seconds("tick").alias("tick"), "events")
        lowest = new.agg(F.min("tick")).first()[0]
        if lowest is None:
            return
        # Explicit columns: the stored folders may hold nothing yet.
        spark.createDataFrame([], _STORED).write.mode("append").parquet(path)
        stored = spark.read.schema(_STORED).parquet(path).filter(F.col("batch") < batch)
        first, before = stored.agg(F.min("tick"), F.coalesce(F.sum("events"), F.lit(0))).first()
        within = stored.filter(F.col("tick") >= lowest - REACH).select("tick", "events")
        known = within.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
        start = F.lit(lowest if first is None else first)
        rates = tick_rates(within.unionByName(new), start, before - known).filter(F.col("tick") >= lowest)
        rows = rates.withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = (
        stream_ticks(stream, time, lateness)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime=f"{TICK_SECONDS} seconds").start()


_STORED = "tick bigint, events bigint, rate double, recent_rate double, overall_rate double, batch bigint"


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rates stored by ``start_rates``, as ``event_rate`` gives them."""
    return spark.read.schema(_STORED).parquet(path).drop("batch")

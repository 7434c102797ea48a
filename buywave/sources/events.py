"""Event table and Parquet parts: definition, export, load."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buywave.operators.events import normalize_loaded
from buywave.schemas import EVENT_COLUMNS

EXPORT_DAYS = 730
ROWS_PER_FILE = 100_000
PART_PATTERN = "*.parquet"


def ensure_table(spark: SparkSession, table: str = "events_raw", location: str | None = None) -> None:
    """Create the raw event table if it is absent: Parquet, one partition per event date."""
    place = f"LOCATION '{location}'" if location else ""
    spark.sql(
        f"""
        CREATE TABLE IF NOT EXISTS {table} (
            event_id STRING, event_type STRING, ts TIMESTAMP, session_id STRING,
            user_id STRING, region STRING, item_id STRING, price DOUBLE,
            properties STRING, date DATE
        ) USING parquet PARTITIONED BY (date) {place}
        """
    )


def export_window(events: DataFrame, now: dt.datetime, days: int = EXPORT_DAYS) -> DataFrame:
    """The exported columns of the events of the last ``days`` days before ``now``.

    The bound is cut to whole seconds and stays a plain comparison on ``ts``, so Parquet and
    JDBC sources can skip data.
    """
    start = (now - dt.timedelta(days=days)).replace(microsecond=0)
    kind = dict(events.dtypes)["ts"]
    return events.filter(F.col("ts") >= F.lit(start).cast(kind)).select(*EVENT_COLUMNS)


def write_event_parts(
    events: DataFrame,
    path: str,
    rows_per_file: int = ROWS_PER_FILE,
    files: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write events in (ts, event_id) order over the files, at most ``rows_per_file`` each.

    Ranges are cut on both keys, so a moment with very many events is spread too.
    """
    order = ["ts", "event_id"]
    ranged = events.repartitionByRange(files, *order) if files else events.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "snappy")
        .parquet(path)
    )


def export_events(
    events: DataFrame, path: str, now: dt.datetime, days: int = EXPORT_DAYS, rows_per_file: int = ROWS_PER_FILE
) -> None:
    write_event_parts(export_window(events, now, days), path, rows_per_file)


def load_events(
    spark: SparkSession,
    path: str,
    strict: bool = True,
    pattern: str = PART_PATTERN,
    schema: StructType | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    dates: Sequence[dt.date] | None = None,
) -> DataFrame:
    """Normalised events of all Parquet parts below ``path``, from ``start`` to ``end`` (whole days) if given.

    With ``dates`` only the events of those days. The days bound ``ts``, so row groups of other days are skipped, and prune the folders of a table that
    is partitioned by ``date``.

    Strict loading fails on a corrupt part; otherwise corrupt parts are skipped. No parts at
    all is a FileNotFoundError in both cases. Without a ``schema`` lenient loading merges the
    readable footers (a distributed job), since any single one may be corrupt.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    if not strict:
        reader = reader.option("ignoreCorruptFiles", "true").option("mergeSchema", str(schema is None).lower())
    if schema is not None:
        reader = reader.schema(schema)
    try:
        parts = reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no Parquet parts in {path}") from error
        raise
    return normalize_loaded(_on(_within(parts, start, end), dates))


def _within(parts: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    kinds = dict(parts.dtypes)
    if start is None and end is None:
        return parts
    if not kinds["ts"].startswith("timestamp"):
        day = F.to_date(F.try_to_timestamp("ts"))
        return parts.filter(day.between(F.lit(start or dt.date.min), F.lit(end or dt.date.max)))
    if start is not None:
        parts = parts.filter(F.col("ts") >= F.lit(start).cast(kinds["ts"]))
    if end is not None:
        parts = parts.filter(F.col("ts") < F.lit(end + dt.timedelta(days=1)).cast(kinds["ts"]))
    if kinds.get("date") == "date":
        if start is not None:
            parts = parts.filter(F.col("date") >= F.lit(start))
        if end is not None:
            parts = parts.filter(F.col("date") <= F.lit(end))
    return parts


def _on(parts: DataFrame, dates: Sequence[dt.date] | None) -> DataFrame:
    """Rows of the given days: a range of ``ts`` for every run of days, and the folders of a table by date."""
    if dates is None:
        return parts
    runs: list[list[dt.date]] = []
    for day in sorted(set(dates)):
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    kinds = dict(parts.dtypes)
    if kinds["ts"].startswith("timestamp"):
        after = [(F.lit(a).cast(kinds["ts"]), F.lit(b + dt.timedelta(days=1)).cast(kinds["ts"])) for a, b in runs]
        within = [(F.col("ts") >= a) & (F.col("ts") < b) for a, b in after]
    else:
        within = [F.to_date(F.try_to_timestamp("ts")).between(F.lit(a), F.lit(b)) for a, b in runs]
    parts = parts.filter(functools.reduce(operator.or_, within, F.lit(False)))
    return parts.filter(F.col("date").isin(list(dates))) if kinds.get("date") == "date" else parts


def changed_dates(
    spark: SparkSession, path: str, mark: str | None, seen: Sequence[str] = (), pattern: str = PART_PATTERN
) -> tuple[list[dt.date], str | None, list[str]]:
    """(dates, mark, files): the dates that have events in files written since ``mark``, the newest file time, and the
    files of just that time.

    ``seen`` are the files of the time ``mark`` that were read already. Older files are left out by their times when
    the files are listed. The dates are at most one for each calendar day.
    """
    time, name = F.col("_metadata.file_modification_time"), F.col("_metadata.file_path")
    parts = spark.read.option("pathGlobFilter", pattern).parquet(path)
    kind = dict(parts.dtypes)["ts"]
    day = F.to_date("ts" if kind.startswith("timestamp") else F.try_to_timestamp("ts"))
    named = parts.select(time.alias("time"), name.alias("name"), day.alias("date"))
    if mark is not None:
        named = named.filter(F.col("time") >= F.lit(mark).cast("timestamp"))
        named = named.filter((F.col("time") > F.lit(mark).cast("timestamp")) | ~F.col("name").isin(list(seen)))
    days = named.groupBy("date").agg(F.max("time").alias("time")).collect()
    if not days:
        return [], mark, list(seen)
    new_mark = spark.range(1).select(F.lit(max(r["time"] for r in days)).cast("string")).first()[0]
    at_mark = named.filter(F.col("time") == F.lit(new_mark).cast("timestamp")).select("name").distinct().collect()
    files = {r["name"] for r in at_mark} | (set(seen) if new_mark == mark else set())
    return sorted(r["date"] for r in days if r["date"] is not None), new_mark, sorted(files)

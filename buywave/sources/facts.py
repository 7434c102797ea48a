"""Stored user-day facts: tables partitioned by date, extended or replaced day by day, and what is rolled from them.

Below one folder: ``user_days`` and ``user_items`` (a day's facts), ``first_items`` (each item of a user on the
first date it was seen), ``states`` (per-user states by date) and ``progress`` (which event files were read, and
which states still hold).
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.operators import events as ev
from buywave.operators import facts
from buywave.sources.snapshots import read_metadata, write_metadata


def _write(rows: DataFrame, path: str, by: str = "date") -> None:
    # Rebalancing gives each date few files of even size, however uneven the dates are.
    (
        rows.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def write_facts(events: DataFrame, path: str) -> None:
    """Store the facts of the days in ``events``; those days are replaced, others stay.

    ``events`` must hold its days whole. A repeated run gives the same tables.
    """
    _write(facts.user_day_facts(events), f"{path}/user_days")
    if "item_id" in events.columns:
        _write(facts.user_item_days(events), f"{path}/user_items")


def read_facts(spark: SparkSession, path: str, end: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(user days, user items), up to ``end`` if given; only the folders of those dates are read."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("user_days", "user_items")]
    if end is not None:
        tables = [t.filter(F.col("date") <= F.lit(end)) for t in tables]
    return tables[0], tables[1]


# --- tables laid out by user --------------------------------------------------------------------

#: Columns of the catalog tables; ``date`` is the partition column.
FACT_TABLES = {
    "user_days": "user_id string, recent_types array<string>, region string, item_id string, events bigint, clicks bigint, "
    "purchases bigint, spent double, first_price double",
    "user_items": "user_id string, item_id string",
}


def ensure_fact_tables(spark: SparkSession, prefix: str, location: str, buckets: int) -> None:
    """Create the catalog tables ``<prefix>_user_days`` and ``<prefix>_user_items`` below ``location`` if they are absent.

    They are partitioned by date and bucketed and sorted by user, so the windows and joins of the snapshot builds
    by user run where the rows lie. ``buckets`` is then the number of tasks: choose it for the whole history.
    """
    for name, columns in FACT_TABLES.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}_{name} ({columns}, date date) USING parquet PARTITIONED BY (date) "
            f"CLUSTERED BY (user_id) SORTED BY (user_id) INTO {buckets} BUCKETS LOCATION '{location}/{name}'"
        )


def write_fact_tables(events: DataFrame, prefix: str, buckets: int) -> None:
    """As ``write_facts``, into the catalog tables: a date has one file for each bucket."""
    spark = events.sparkSession
    made = {"user_days": facts.user_day_facts(events), "user_items": facts.user_item_days(events)}
    setting = "spark.sql.sources.partitionOverwriteMode"  # catalog tables take it from the session only
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        _insert(made, prefix, buckets)
    finally:
        spark.conf.set(setting, before)


def _insert(made: dict[str, DataFrame], prefix: str, buckets: int) -> None:
    for name, rows in made.items():
        kinds = [c.strip().split(" ", 1) for c in f"{FACT_TABLES[name]}, date date".split(",")]
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds]
        rows.select(*columns).repartition(buckets, "user_id").write.insertInto(f"{prefix}_{name}", overwrite=True)


def read_fact_tables(spark: SparkSession, prefix: str, end: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(user days, user items) of the catalog tables, up to ``end`` if given.

    The session is told that rows dealt by user need not be dealt again to be joined by user and day.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tables = [spark.table(f"{prefix}_{name}") for name in FACT_TABLES]
    if end is not None:
        tables = [t.filter(F.col("date") <= F.lit(end)) for t in tables]
    return tables[0], tables[1]


# --- what is rolled from the facts --------------------------------------------------------------


def known_items(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, date) with the first date of every item of a user."""
    try:
        return spark.read.parquet(f"{path}/first_items").filter(F.col("user_id").isNotNull())
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "user_id string, item_id string, date date")


def first_items_since(items: DataFrame, known: DataFrame, since: dt.date | None) -> DataFrame:
    """Items first seen on ``since`` or later: those of the days since then that no earlier date has.

    The outer join lets Spark prune the earlier items by a Bloom filter of the new ones before they are
    shuffled (``spark.sql.optimizer.runtime.bloomFilter``).
    """
    if since is not None:
        items, known = items.filter(F.col("date") >= F.lit(since)), known.filter(F.col("date") < F.lit(since))
    firsts = ev.item_first_days(items)
    if since is None:
        return firsts
    earlier = known.select("user_id", "item_id", F.lit(True).alias("_earlier"))
    return firsts.join(earlier, ["user_id", "item_id"], "left").filter(F.col("_earlier").isNull()).drop("_earlier")


def write_first_items(spark: SparkSession, path: str, since: dt.date | None) -> None:
    """Bring the first-seen items up to the stored facts, from the date ``since`` on (None: all).

    A late event moves an item to an earlier date, so all dates from there on are replaced; a row without a user
    stands for each of them, so that a date left without new items is replaced as well.
    """
    days, items = read_facts(spark, path)
    firsts = first_items_since(items, known_items(spark, path), since)
    dates = ev.observed_dates(days if since is None else days.filter(F.col("date") >= F.lit(since)))
    _write(firsts.unionByName(dates, allowMissingColumns=True), f"{path}/first_items")


def write_state(state: DataFrame, path: str, as_of: dt.date) -> None:
    _write(state.withColumn("as_of", F.lit(as_of)), f"{path}/states", "as_of")


def read_state(spark: SparkSession, path: str, as_of: dt.date) -> DataFrame:
    return spark.read.parquet(f"{path}/states").filter(F.col("as_of") == F.lit(as_of)).drop("as_of")


def read_progress(spark: SparkSession, path: str) -> dict:
    """``mark`` and ``files`` (see ``changed_dates``), and ``states``: the run date and last observed date of each valid state."""
    try:
        return read_metadata(spark, f"{path}/progress")
    except (AnalysisException, TypeError):  # absent, or emptied by a run that was stopped: read all files again
        return {"mark": None, "files": [], "states": {}}


def write_progress(spark: SparkSession, path: str, progress: dict) -> None:
    write_metadata(spark, progress, f"{path}/progress")

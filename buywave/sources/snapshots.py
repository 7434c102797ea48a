"""Snapshot tables: training splits, daily runs, run metadata."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def write_splits(snapshots: DataFrame, path: str) -> None:
    """Write the training rows partitioned by ``split`` in one job."""
    snapshots.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one split (only its folder is read); an error when the table is absent."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}")
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    return table.filter(F.col("split") == name).drop("split")


#: Parquet settings for lookups of single users: a Bloom filter of the ids in every row group, as large as they need.
LOOKUP = {
    "parquet.bloom.filter.enabled#user_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def write_daily_snapshot(snapshot: DataFrame, path: str, run_date: dt.date) -> None:
    """Write one run under its run date, replacing only that date's folder.

    Users are sorted over the files, so that a lookup of one user finds its row group by the ids'
    ranges, and a user that is not there mostly none at all by the Bloom filters.
    """
    if "user_id" in snapshot.columns:
        snapshot = snapshot.repartitionByRange("user_id").sortWithinPartitions("user_id")
    (
        snapshot.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**LOOKUP)
        .partitionBy("run_date")
        .parquet(path)
    )


def latest_rows(snapshots: DataFrame, run_column: str = "run_date") -> DataFrame:
    """Rows of the greatest run date; the bound reaches the scan as a partition filter."""
    newest = snapshots.agg(F.max(run_column)).scalar()
    return snapshots.filter(F.col(run_column) == newest)


def run_dates(spark: SparkSession, path: str) -> list[dt.date]:
    """The dates that runs are stored for, in order: one listing of the run folders, none of their files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(folder) if entry.isDirectory()]
    return sorted(dt.date.fromisoformat(n.removeprefix("run_date=")) for n in names if n.startswith("run_date="))


def read_run(spark: SparkSession, path: str, run_date: dt.date) -> DataFrame:
    """The rows of one run; only its own folder is listed."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/run_date={run_date.isoformat()}")
    return stored.filter(F.col("run_date") == F.lit(run_date))


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest daily snapshot."""
    runs = run_dates(spark, path)
    if not runs:
        raise FileNotFoundError(f"no daily snapshot in {path}")
    return read_run(spark, path, runs[-1])


def publish_run(spark: SparkSession, table: str, path: str, run_date: dt.date) -> None:
    """Enter one stored run into the catalog table ``table``, which is created over ``path`` if it is absent."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read_run(spark, path, run_date).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (run_date) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (run_date = DATE '{run_date.isoformat()}')")


def latest_published(spark: SparkSession, table: str) -> DataFrame:
    """The newest run of a catalog table, found in its partition metadata: no folder is listed."""
    runs = [row[0].removeprefix("run_date=") for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    if not runs:
        raise FileNotFoundError(f"no run in {table}")
    return spark.table(table).filter(F.col("run_date") == F.lit(max(runs)).cast("date"))


def write_metadata(spark: SparkSession, record: dict, path: str) -> None:
    """Write one run record (configuration, metrics, load statistics) as a JSON file."""
    text = spark.createDataFrame([(json.dumps(record, default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])

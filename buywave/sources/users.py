"""Users dimension: export from a database, cast, projection, preferred source."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def cast_to_string(df: DataFrame, columns: Iterable[str] = ("user_uid",)) -> DataFrame:
    """Cast the named columns that exist to text."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: df[c].cast("string") for c in present}) if present else df


def read_users_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "public.users",
    options: dict[str, str] | None = None,
    partition_column: str | None = "id",
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
) -> DataFrame:
    """Users over JDBC, read in parallel ranges of ``partition_column`` when bounds are given.

    Credentials come in through ``options``.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def export_users(users: DataFrame, path: str) -> None:
    """Write the users table as Parquet with text ids."""
    cast_to_string(users).write.mode("overwrite").parquet(path)


def user_ids(users: DataFrame, ordered: bool = True) -> DataFrame:
    """The id column alone, in id order."""
    ids = cast_to_string(users).select("user_uid")
    return ids.orderBy("user_uid") if ordered else ids


def preferred_users(
    spark: SparkSession, path: str, fallback: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """Users from Parquet, else from ``fallback`` (for example a JDBC read), else an error."""
    try:
        return cast_to_string(spark.read.parquet(path))
    except AnalysisException as missing:
        if fallback is None:
            raise FileNotFoundError(f"no users at {path} and no other source") from missing
        try:
            return cast_to_string(fallback())
        except Exception as failed:
            raise RuntimeError(f"no users at {path}, and the other source failed") from failed

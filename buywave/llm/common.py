"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/llm-stages/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, computes
    it once, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column) -> Column:
    """The text as it is; null reads as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unit_interval(*columns: str | Column, seed: int) -> Column:
    """A reproducible uniform number in (0, 1) from the md5 of the columns' texts.

    The first 13 hex digits (52 bits) plus one half, so that neither end is reached. Null columns
    read as the text ``null``.
    """
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("null")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def portions(texts: pa.Array, chars: int = 4_000_000) -> Iterator[list[str]]:
    """The batch's texts in portions of some million characters, never splitting a text."""
    part: list[str] = []
    size = 0
    for x in texts:
        part.append(x.as_py())
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


#: Names of the two content hashes that tell rows apart; both together have 128 bits.
CONTENT_KEYS = ("content_key_1", "content_key_2")
#: Copies of one row that a task makes at once; more are dealt to several tasks.
COPIES_AT_ONCE = 10_000


def with_content_keys(docs: DataFrame) -> DataFrame:
    """All columns as the struct ``row``, beside doc_id, source, text and two hashes of the whole row.

    Ids need not be unique and may be null; rows with equal hashes agree in every column. Hashes pass over
    nulls, so which columns are null is hashed as well. Columns that hold maps are hashed as JSON texts.
    """
    one, two = CONTENT_KEYS
    named = [F.col(f"`{c}`") for c in docs.columns]
    values = [
        F.to_json(F.struct(c.alias("c"))) if "map<" in kind else c for c, (_, kind) in zip(named, docs.dtypes)
    ]
    nulls = F.array(*[c.isNull() for c in named])
    return docs.select(
        F.struct(*named).alias("row"),
        "doc_id",
        "source",
        "text",
        F.xxhash64(nulls, *values).alias(one),
        F.xxhash64(*reversed(values), nulls).alias(two),
    )


def repeated_here(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Every row ``times`` times, numbered from 1 in ``number``, made by the task that has the row."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != times]
    some = rows.filter(F.col(times) > 0)
    return some.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))).alias(number))


def repeated_apart(rows: DataFrame, times: str, number: str) -> DataFrame:
    """As ``repeated_here``, but runs of ``COPIES_AT_ONCE`` copies are dealt over the tasks first."""
    step = F.lit(COPIES_AT_ONCE).cast("bigint")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != times]
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, step))
    runs = rows.filter(F.col(times) > 0).withColumn("run start", starts)
    run = F.sequence(F.col("run start") + 1, F.least(F.col("run start") + step, F.col(times)))
    return runs.repartition("run start", *kept).select(*kept, F.explode(run).alias(number))


def few_and_many(rows: DataFrame, times: str) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(times) <= COPIES_AT_ONCE), rows.filter(F.col(times) > COPIES_AT_ONCE)


def numbered_copies(rows: DataFrame, number: str = "copy") -> DataFrame:
    """``rows`` with equal ones numbered from 1: counted in the map tasks, then repeated. No window over
    equal rows."""
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias("copies"))
    few, many = few_and_many(counted, "copies")
    return repeated_here(few, "copies", number).unionByName(repeated_apart(many, "copies", number))


def rows_of(keyed: DataFrame, decided: DataFrame, *more: str) -> DataFrame:
    """The rows that ``decided`` names by content keys, once per row of ``decided``, with its columns
    ``more`` after their own. Equal rows are reduced to one in the map tasks first."""
    texts = keyed.select("row", *CONTENT_KEYS).dropDuplicates(list(CONTENT_KEYS))
    return texts.join(decided, list(CONTENT_KEYS)).select("row.*", *more)

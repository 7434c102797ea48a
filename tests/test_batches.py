"""Ingest by micro-batches: one read, no loss, no repeats, bounded files; rates in the stream."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from buywave.schemas import EVENT_COLUMNS
from buywave.streaming import batches, ingest
from buywave.streaming.rates import event_rate, read_rates, start_rates
from tests.test_streaming import LINES, message


def lines(rng, n, days=4):
    made = []
    for k in range(n):
        ts = dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randint(0, 1440 * days - 1))
        made.append(rng.choice([message(k, timestamp=ts.isoformat() + "Z"), rng.choice(LINES)]))
    return made


def as_files(folder, parts):
    folder.mkdir(exist_ok=True)
    for k, part in enumerate(parts):
        name = f"{len(os.listdir(folder)):03d}-{k}.txt"
        (folder / name).write_text("\n".join(part))


def drain(spark, source, base):
    stream = ingest.file_source(spark, str(source), files_per_batch=1)
    query = batches.start_batches(stream, str(base), str(base / "cp"), available_now=True)
    query.awaitTermination(120)
    return query


def as_rows(df):
    return sorted(map(repr, df.select(EVENT_COLUMNS).collect()))


def wanted(spark, source):
    given = spark.read.text(str(source)).select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))
    return ingest.normalize_events(ingest.event_contract(given).filter("accepted"))


def test_one_read_three_outputs(spark, tmp_path):
    rng = random.Random(1)
    parts = [lines(rng, 40) for _ in range(3)]
    as_files(tmp_path / "in", parts)
    query = drain(spark, tmp_path / "in", tmp_path)
    # A source that is read twice reports its rows twice.
    assert sum(p["numInputRows"] for p in query.recentProgress) == 120
    base = str(tmp_path)
    assert as_rows(batches.read_events(spark, base)) == as_rows(wanted(spark, tmp_path / "in"))
    counts = {r["batch"]: r for r in batches.read_counts(spark, base).collect()}
    rejected = batches.read_rejected(spark, base)
    assert sum(r["messages"] for r in counts.values()) == 120
    assert sum(r["rejected"] for r in counts.values()) == rejected.count()
    assert sum(r["malformed"] for r in counts.values()) == rejected.filter(F.size("missing") != 1).count()
    assert sum(r["accepted"] for r in counts.values()) == batches.read_events(spark, base).count()
    assert {"{broken", "17"} & {r["value"] for r in rejected.collect()}


@pytest.mark.parametrize("when", ["before", "after"])
def test_failed_batch_is_done_again(spark, tmp_path, monkeypatch, when):
    as_files(tmp_path / "in", [lines(random.Random(k), 20) for k in range(3)])
    land = batches.land_batch

    def fails(messages, number, base):
        if when == "after" or number != 1:
            land(messages, number, base)
        if number == 1:
            raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(batches, "land_batch", fails)
        with pytest.raises(Exception, match="lost"):
            drain(spark, tmp_path / "in", tmp_path)
    drain(spark, tmp_path / "in", tmp_path)
    drain(spark, tmp_path / "in", tmp_path)  # nothing new
    assert as_rows(batches.read_events(spark, str(tmp_path))) == as_rows(wanted(spark, tmp_path / "in"))
    assert sorted(r["messages"] for r in batches.read_counts(spark, str(tmp_path)).collect()) == [20, 20, 20]


def test_compaction(spark, tmp_path):
    base = str(tmp_path)
    rng = random.Random(3)
    as_files(tmp_path / "in", [lines(rng, 30) for _ in range(6)])
    drain(spark, tmp_path / "in", tmp_path)
    before = as_rows(batches.read_events(spark, base))
    dates = batches.compact(spark, base, dt.date(2025, 1, 2), rows_per_file=25)
    assert [str(d) for d in dates] == ["2025-01-01", "2025-01-02"]
    assert as_rows(batches.read_events(spark, base)) == before
    for date in dates:
        n = batches.read_events(spark, base).filter(F.col("date") == F.lit(date)).count()
        assert len(glob.glob(f"{base}/events/date={date}/*.parquet")) <= n // 25 + 1
        assert len(glob.glob(f"{base}/landing/kind=accepted/date={date}/*/*.parquet")) >= 5
    assert batches.compact(spark, base, dt.date(2025, 1, 2)) == []  # nothing new
    # Late events of a closed date wait for the next rewriting, which adds their batch.
    as_files(tmp_path / "in", [[message(900, timestamp="2025-01-01T00:00:00Z")]])
    drain(spark, tmp_path / "in", tmp_path)
    assert as_rows(batches.read_events(spark, base)) == before
    assert [str(d) for d in batches.compact(spark, base, dt.date(2025, 1, 3))] == ["2025-01-01", "2025-01-03"]
    assert as_rows(batches.read_events(spark, base)) == as_rows(wanted(spark, tmp_path / "in"))
    folders = batches.landed_folders(spark, base)
    assert folders and all(os.path.isdir(f) and f.split("date=")[1] < "2025-01-04" for f in folders)


def test_stopped_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    as_files(tmp_path / "in", [lines(random.Random(5), 30) for _ in range(2)])
    drain(spark, tmp_path / "in", tmp_path)
    before = as_rows(batches.read_events(spark, base))

    def fails(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(batches, "write_metadata", fails)
        with pytest.raises(RuntimeError):
            batches.compact(spark, base, dt.date(2025, 1, 3))
    assert as_rows(batches.read_events(spark, base)) == before
    batches.compact(spark, base, dt.date(2025, 1, 3))
    assert as_rows(batches.read_events(spark, base)) == before


def test_nothing_stored_yet(spark, tmp_path):
    base = str(tmp_path / "none")
    assert batches.read_events(spark, base).count() == batches.read_rejected(spark, base).count() == 0
    assert batches.read_counts(spark, base).count() == 0
    assert batches.compact(spark, base, dt.date(2025, 1, 1)) == []


def test_rates_in_the_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2025, 1, 1, 0, 59, 0)
    seconds = sorted(rng.sample(range(0, 400), 120))
    parts = [seconds[:40], seconds[40:80], seconds[80:], [5000]]  # the last one only moves the watermark
    for k, part in enumerate(parts):
        rows = [(start + dt.timedelta(seconds=s),) for s in part for _ in range(1 + s % 3)]
        spark.createDataFrame(rows, "ingest_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ingest_ts timestamp").parquet(str(tmp_path / "in"))
        start_rates(stream, str(tmp_path / "rates"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    given = spark.read.parquet(str(tmp_path / "in")).filter(F.col("ingest_ts") < F.lit(start + dt.timedelta(seconds=4000)))
    as_set = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert as_set(read_rates(spark, str(tmp_path / "rates"))) == as_set(event_rate(given, "ingest_ts"))
    assert spark.read.parquet(str(tmp_path / "rates")).select("batch").distinct().count() >= 3

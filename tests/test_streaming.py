"""Ingest stream on text files: equal to the batch operator, restartable, nothing lost."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from buywave.schemas import EVENT_COLUMNS
from buywave.streaming import ingest
from buywave.streaming.rates import event_rate, stream_ticks


def message(i, **changes):
    record = {
        "event_id": str(i), "event_type": "click", "timestamp": "2025-01-01T00:00:00Z", "session_id": "s",
        "user_id": "u", "region": "UA-30", "properties": {"item_id": "item_1", "price": 10},
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v is not Ellipsis})


LINES = [
    message(1),
    message(2, properties=...),
    message(3, properties={"price": "bad"}),
    message(4, timestamp="junk"),
    message(5, timestamp="2025-01-01T02:00:00.123456+02:00"),
    message(6, timestamp="2025-01-01 00:00:05"),
    message(7, user_id=...),
    message(8, properties=[1, 2]),
    "{broken",
    "17",
    message(9, properties={"price": "12.5", "item_id": "x"}),
]


@pytest.fixture
def messages(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string").withColumn(
        "ingest_ts", F.lit(dt.datetime(2025, 2, 2))
    )


def test_normalised_rows(messages):
    rows = {r["event_id"]: r for r in ingest.events_from_messages(messages).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5", "6", "7", "9"]
    assert (rows["1"]["item_id"], rows["1"]["price"], rows["1"]["properties"]) == ("item_1", 10.0, '{"item_id":"item_1","price":10}')
    assert (rows["2"]["item_id"], rows["2"]["price"], rows["2"]["properties"]) == ("", None, "{}")
    assert rows["3"]["price"] is None and rows["9"]["price"] == 12.5
    assert rows["4"]["ts"] == dt.datetime(2025, 2, 2)
    assert rows["5"]["ts"] == dt.datetime(2025, 1, 1, 0, 0, 0, 123000)
    assert rows["6"]["ts"] == dt.datetime(2025, 1, 1, 0, 0, 5)
    assert rows["7"]["user_id"] == ""


def test_contract(messages):
    checked = ingest.event_contract(messages)
    assert checked.filter("accepted").count() == 7
    missing = [r["missing"] for r in checked.filter(~F.col("accepted") & F.col("readable")).collect()]
    assert missing == [["user_id"]]
    counted = ingest.parse_messages(messages).agg(ingest.malformed_count()).first()[0]
    assert counted == 3


def drain(spark, source, base):
    stream = ingest.file_source(spark, str(source), files_per_batch=1)
    for query in ingest.start_ingest(stream, str(base / "events"), str(base / "cp"), str(base / "bad"), available_now=True):
        query.awaitTermination(120)


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(LINES[:5]))
    drain(spark, source, tmp_path)
    (source / "b.txt").write_text("\n".join(LINES[5:]))
    drain(spark, source, tmp_path)  # picks up where it stopped
    drain(spark, source, tmp_path)  # nothing new
    stored = spark.read.parquet(str(tmp_path / "events"))
    lines = spark.read.text(str(source)).select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))
    accepted = ingest.event_contract(lines).filter("accepted")
    wanted = ingest.normalize_events(accepted)
    assert sorted(map(tuple, stored.select(EVENT_COLUMNS).collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert stored.count() + bad.count() == len(LINES)


def test_stream_ticks(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(LINES))
    ticks = stream_ticks(ingest.file_source(spark, str(source)))
    query = ticks.writeStream.format("memory").queryName("ticks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("ticks").collect()
    assert [(r["events"], r["rate"]) for r in rows] == [(len(LINES), len(LINES) / 2)]


def test_rates_cross_chunk_borders(spark):
    seconds = [3500, 3501, 3598, 3600, 3630, 3640, 7300]
    frame = spark.createDataFrame([(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s),) for s in seconds], "ts timestamp_ntz")
    rows = {r["tick"]: r for r in event_rate(frame).collect()}
    for tick, row in rows.items():
        n = min(20, (tick - 3500) // 2 + 1)
        inside = [s for s in seconds if tick - 38 <= s // 2 * 2 <= tick]
        before = [s for s in seconds if s // 2 * 2 <= tick]
        assert row["recent_rate"] == pytest.approx(len(inside) / (2 * n))
        assert row["overall_rate"] == pytest.approx(len(before) / (2 * ((tick - 3500) // 2 + 1)))
    assert len(rows) == 6

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buywave.operators import events as ev
from buywave.operators.audience import user_record
from buywave.sources import events as event_source
from buywave.sources import snapshots as store
from buywave.sources import trends as trend_source
from buywave.sources import users as user_source
from query_catalog import fixtures as fixture
from tests.conftest import SMALL


def test_export_writes_ordered_bounded_parts(spark, tmp_path):
    events = fixture.events(spark, SMALL)
    path = str(tmp_path / "parts")
    event_source.export_events(events, path, dt.datetime(2024, 2, 1), days=31, rows_per_file=100)
    stored = spark.read.parquet(path)
    assert stored.count() == events.count()
    sizes = stored.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 100 and len(sizes) >= 10
    late = event_source.export_window(events, dt.datetime(2024, 2, 1), days=10)
    assert late.filter(F.col("ts") < dt.datetime(2024, 1, 22)).count() == 0


def test_load_strict_and_lenient(spark, tmp_path):
    path = tmp_path / "parts"
    fixture.events(spark, SMALL).limit(50).coalesce(1).write.parquet(str(path))
    loaded = event_source.load_events(spark, str(path))
    assert loaded.count() == 50 and loaded.filter(F.col("price").isNull()).count() == 0
    (path / "broken.parquet").write_bytes(b"not parquet")
    assert event_source.load_events(spark, str(path), strict=False).count() == 50
    with pytest.raises(Exception):
        event_source.load_events(spark, str(path)).count()


@pytest.mark.parametrize("strict", [True, False])
def test_load_nothing(spark, tmp_path, strict):
    (tmp_path / "empty").mkdir()
    for name in ("empty", "absent"):
        with pytest.raises(FileNotFoundError):
            event_source.load_events(spark, str(tmp_path / name), strict=strict)


def test_load_cleans_types(spark):
    raw = spark.createDataFrame([("2024-01-01T10:00:00Z", "4.5"), ("2024-01-02T10:00:00Z", "x")], "ts string, price string")
    rows = ev.normalize_loaded(raw).orderBy("ts").collect()
    assert [(str(r["date"]), r["price"]) for r in rows] == [("2024-01-01", 4.5), ("2024-01-02", 0.0)]


def test_event_table(spark, tmp_path):
    place = str(tmp_path / "events_raw")
    event_source.ensure_table(spark, "events_raw_t", place)
    event_source.ensure_table(spark, "events_raw_t", place)
    assert spark.table("events_raw_t").columns[-1] == "date"
    spark.sql("DROP TABLE events_raw_t")


def test_users(spark, tmp_path):
    users = fixture.users(spark, SMALL)
    path = str(tmp_path / "users")
    with pytest.raises(FileNotFoundError):
        user_source.preferred_users(spark, path)
    assert user_source.preferred_users(spark, path, lambda: users).count() == users.count()
    user_source.export_users(users, path)
    stored = user_source.preferred_users(spark, path)
    assert dict(stored.dtypes)["user_uid"] == "string"
    ids = [r[0] for r in user_source.user_ids(stored).collect()]
    assert ids == sorted(ids)


def test_trend_master_is_written_once(spark, tmp_path):
    path = str(tmp_path / "trends")
    assert trend_source.read_trends(spark, path).count() == 0
    assert trend_source.load_daily_trends(spark, path).count() == 0
    points = fixture.trends(spark, SMALL)
    first = trend_source.write_trends_once(points, path)
    n = first.count()
    assert n == points.count() and "trend_slope" in first.columns
    assert trend_source.write_trends_once(points.limit(1), path).count() == n
    assert trend_source.load_daily_trends(spark, path).count() == 30
    trend_source.write_load_stats(first, str(tmp_path / "stats"))
    stats = spark.read.json(str(tmp_path / "stats")).first()
    assert stats["total_records"] == n and stats["regions"] == ["UA-30", "UA-40", "UA-50"]


def test_only_absent_empty_or_other_tables_mean_no_trends(spark, tmp_path):
    path = tmp_path / "bad"
    path.mkdir()
    assert trend_source.load_daily_trends(spark, str(path)).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "other"))
    assert trend_source.load_daily_trends(spark, str(tmp_path / "other")).count() == 0
    (path / "x.parquet").write_bytes(b"no")
    with pytest.raises(Exception, match="(?i)parquet"):
        trend_source.load_daily_trends(spark, str(path))


def test_daily_runs(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = spark.range(5).select(F.col("id").cast("string").alias("user_id"))
    store.write_daily_snapshot(rows, path, dt.date(2024, 1, 1))
    store.write_daily_snapshot(rows, path, dt.date(2024, 1, 2))
    store.write_daily_snapshot(rows.limit(2), path, dt.date(2024, 1, 2))  # replaces only that run
    newest = store.read_latest_snapshot(spark, path)
    assert newest.count() == 2 and spark.read.parquet(path).count() == 7
    assert "PartitionFilters: [isnotnull(run_date" in newest._jdf.queryExecution().toString()


def test_union_of_parts_with_gaps(spark):
    both = ev.union_parts([spark.range(2).toDF("a"), spark.range(3).select(F.col("id").alias("a"), F.lit(1).alias("b"))])
    assert both.count() == 5 and both.filter(F.col("b").isNull()).count() == 2
    with pytest.raises(ValueError):
        ev.union_parts([])


def rows_scanned(df):
    """Rows that the scans of the plan gave, once it was run."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plans = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while plans:
        node = plans.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children().iterator()
        while children.hasNext():
            plans.append(children.next())
    return total


def test_one_user_is_looked_up_in_one_row_group(spark, tmp_path, monkeypatch):
    path, n = str(tmp_path / "daily"), 40_000
    # Row groups as small as Parquet makes them.
    monkeypatch.setattr(store, "LOOKUP", {**store.LOOKUP, "parquet.block.size": "20000", "parquet.page.size": "2000"})
    users = spark.range(n).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("user_id"), "id")
    store.write_daily_snapshot(users, path, dt.date(2024, 1, 1))
    snapshot = store.read_latest_snapshot(spark, path)
    found = user_record(snapshot, "u00012345")
    assert [r["id"] for r in found.collect()] == [12345]
    assert 0 < rows_scanned(found) <= n // 8
    # Within the range of ids, but not there: the Bloom filters leave nothing to read.
    assert rows_scanned(user_record(snapshot, "u00012345x")) == 0


def test_runs_in_the_catalog(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = spark.range(5).select(F.col("id").cast("string").alias("user_id"))
    assert store.run_dates(spark, path) == []
    with pytest.raises(FileNotFoundError):
        store.read_latest_snapshot(spark, path)
    for day, n in ((2, 3), (1, 5)):
        store.write_daily_snapshot(rows.limit(n), path, dt.date(2024, 1, day))
        store.publish_run(spark, "daily_runs", path, dt.date(2024, 1, day))
    try:
        assert [str(d) for d in store.run_dates(spark, path)] == ["2024-01-01", "2024-01-02"]
        newest = store.latest_published(spark, "daily_runs")
        assert newest.count() == store.read_latest_snapshot(spark, path).count() == 3
        assert spark.table("daily_runs").count() == 8
    finally:
        spark.sql("DROP TABLE daily_runs")

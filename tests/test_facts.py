"""Stored user-day facts: the snapshots from them, day by day extension, composed jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buywave.models import purchase
from buywave.operators import events as ev
from buywave.operators import facts
from buywave.operators import history as hist
from buywave.operators import splits
from buywave.plans.audience import score_records, users_listing
from buywave.plans.daily import daily_run, load_trends
from buywave.plans.snapshots import daily_from_facts, daily_snapshot, training_from_facts, training_snapshots
from buywave.sources import snapshots as store
from buywave.sources.events import load_events
from buywave.sources.facts import ensure_fact_tables, read_fact_tables, read_facts, write_fact_tables, write_facts
from query_catalog import fixtures as fixture
from query_catalog.event_queries import loaded
from tests.conftest import SMALL, day
from tests.test_plans import plan


def rows(frame):
    rounded = frame.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in sorted(frame.dtypes)])
    return sorted(map(repr, rounded.collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Raw events as a table by date, and the facts written in two runs, the second one twice."""
    base = tmp_path_factory.mktemp("facts")
    raw = fixture.events(spark, SMALL)
    raw = raw.withColumn("user_id", F.when(F.col("event_id") != "3", F.col("user_id")))  # one event without user
    raw.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(str(base / "events"))
    middle = dt.date(2024, 1, 15)
    write_facts(load_events(spark, str(base / "events"), end=middle), str(base / "facts"))
    for _ in range(2):
        write_facts(load_events(spark, str(base / "events"), start=middle + dt.timedelta(days=1)), str(base / "facts"))
    events = load_events(spark, str(base / "events"))
    return base, events, ev.fit_vocabulary(events)


def test_same_snapshots(spark, stored):
    base, events, vocabulary = stored
    days, items = read_facts(spark, str(base / "facts"))
    assert rows(training_from_facts(days, items, vocabulary=vocabulary)) == rows(training_snapshots(events, vocabulary=vocabulary))
    assert rows(daily_from_facts(days, items, vocabulary=vocabulary)) == rows(daily_snapshot(events, vocabulary=vocabulary))
    short = training_from_facts(days, items, vocabulary=vocabulary, sequence_length=3, start=dt.date(2024, 1, 20))
    assert rows(short) == rows(training_snapshots(events, vocabulary=vocabulary, sequence_length=3, start=dt.date(2024, 1, 20)))


def test_no_event_scan_and_pruned_dates(spark, stored):
    base, _, vocabulary = stored
    days, items = read_facts(spark, str(base / "facts"), end=dt.date(2024, 1, 20))
    text = plan(training_from_facts(days, items, vocabulary=vocabulary))
    assert "properties" not in text and "PartitionFilters: [isnotnull(date" in text
    one = plan(load_events(spark, str(base / "events"), start=dt.date(2024, 1, 9), end=dt.date(2024, 1, 9)))
    assert "GreaterThanOrEqual(ts," in one and "PartitionFilters: [isnotnull(date" in one


def test_awkward_facts(spark, make_events):
    events = make_events(
        [
            ("a", "click", day(0), 1.0, "x"),
            ("a", None, day(0), None, None),
            ("a", "purchase", day(2), float("nan"), "x"),
            (None, "click", day(4), 1.0, "y"),
            ("b", "view", day(3), 2.0, None),
        ]
    )
    parts = facts.user_day_facts(events), facts.user_item_days(events)
    for vocabulary in ([], ["click", "view"]):
        assert rows(training_from_facts(*parts, 1, vocabulary=vocabulary)) == rows(training_snapshots(events, 1, vocabulary=vocabulary))
        assert rows(daily_from_facts(*parts, vocabulary=vocabulary)) == rows(daily_snapshot(events, vocabulary=vocabulary))
    nothing = events.filter("false")
    parts = facts.user_day_facts(nothing), facts.user_item_days(nothing)
    assert training_from_facts(*parts, vocabulary=["click"]).count() == 0
    assert daily_from_facts(*parts, vocabulary=["click"]).count() == 0
    bare = events.drop("price", "item_id", "region")
    assert rows(daily_from_facts(facts.user_day_facts(bare), vocabulary=["click"])) == rows(daily_snapshot(bare, vocabulary=["click"]))
    with pytest.raises(ValueError):
        training_from_facts(*parts, vocabulary=["click"], sequence_length=51)


def test_known_dates_split_alike(spark, make_events):
    # The first date has an event without user only, so the spine does not start there.
    events = make_events([(None, "click", day(0))] + [("u", "view", day(n)) for n in range(1, 12) if n != 5])
    targets = hist.next_purchase_target(events, 2)
    dates = hist.snapshot_dates(events, 2)
    assert rows(dates) == rows(targets.select("snapshot_date").distinct())
    assert rows(splits.time_split(targets, dates=dates)) == rows(splits.time_split(targets))


def test_daily_run(spark, stored, tmp_path):
    base, events, vocabulary = stored
    paths = [str(base / "events"), str(tmp_path / "facts"), str(tmp_path / "daily")]
    first, second = dt.date(2024, 1, 29), dt.date(2024, 1, 30)
    daily_run(spark, *paths, first, vocabulary=vocabulary, first=dt.date(2024, 1, 1))
    daily_run(spark, *paths, second, vocabulary=vocabulary)
    # A late run of the first day gives its rows again and sees nothing of the second.
    again = daily_run(spark, *paths, first, vocabulary=vocabulary, trends_path=str(tmp_path / "none"))
    assert rows(again) == rows(daily_snapshot(events.filter(F.col("date") <= first), vocabulary=vocabulary))
    latest = store.read_latest_snapshot(spark, paths[2])
    assert rows(latest.drop("run_date")) == rows(daily_snapshot(events, vocabulary=vocabulary))


def test_trends_job(spark, tmp_path):
    text = """{"interest_over_time": {"timeline_data": [
        {"date": "Jun 4, 2025", "values": [{"value": "7", "formattedValue": "7"}, {"value": "x", "formattedValue": "x"}]}]}}"""
    (tmp_path / "one.json").write_text(text)
    where = str(tmp_path / "table"), str(tmp_path / "stats")
    stored = load_trends(spark, str(tmp_path / "one.json"), ["shoes", "hats"], "UA-30", *where)
    assert {(r["query"], r["popularity"]) for r in stored.collect()} == {("shoes", 7), ("hats", 0)}
    again = load_trends(spark, str(tmp_path / "one.json"), ["other"], "UA-30", *where)
    assert again.count() == 2  # written once
    stats = spark.read.json(where[1]).first()
    assert stats["total_records"] == 2 and stats["queries"] == ["hats", "shoes"]


def test_users_listing_and_records(spark, stored):
    _, events, vocabulary = stored
    few = {"maxIter": 2, "maxDepth": 2}
    training = training_snapshots(events, vocabulary=vocabulary).checkpoint()
    model = purchase.fit(training, classifier=few, regressor=few, vocabulary=vocabulary)
    snapshot = daily_snapshot(events, vocabulary=vocabulary)
    users = snapshot.select(F.col("user_id").alias("user_uid")).unionByName(spark.createDataFrame([("zz",), ("00",)], "user_uid string"))
    plain = [r["user_id"] for r in users_listing(users, snapshot).collect()]
    assert plain == sorted(plain) and len(plain) == users.count()
    ranked = users_listing(users, snapshot, model).collect()
    assert {r["user_id"] for r in ranked[-2:]} == {"zz", "00"} and ranked[-1]["segment"] == "ignore"
    scores = [r["purchase_proba"] for r in ranked[:-2]]
    assert scores == sorted(scores, reverse=True)
    records = snapshot.withColumn("total_spent", F.when(F.col("user_id") == "1", "abc").otherwise(F.col("total_spent").cast("string")))
    scored = {r["user_id"]: r for r in score_records(records, model).collect()}
    assert scored["1"]["invalid_fields"] == ["total_spent"] and scored["1"]["purchase_proba"] is None
    others = [r for u, r in scored.items() if u != "1"]
    assert others and all(0 <= r["purchase_proba"] <= 1 and r["invalid_fields"] == [] for r in others)
    lacking = score_records(snapshot.drop("total_events"), model).first()
    assert lacking["invalid_fields"] == ["total_events"] and lacking["days_to_next_pred"] is None


def test_facts_by_user_need_no_exchange_by_user(spark, stored, tmp_path):
    base, events, vocabulary = stored
    buckets, name = 3, "laid_out"
    ensure_fact_tables(spark, name, str(tmp_path), buckets)
    try:
        middle = dt.date(2024, 1, 20)
        write_fact_tables(load_events(spark, str(base / "events"), end=middle), name, buckets)
        for _ in range(2):  # a repeated run replaces its dates
            write_fact_tables(load_events(spark, str(base / "events"), start=middle), name, buckets)
        parts = read_fact_tables(spark, name)
        built = training_from_facts(*parts, vocabulary=vocabulary)
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(user_id" not in plan and "Exchange hashpartitioning(date" in plan
        assert rows(built) == rows(training_snapshots(events, vocabulary=vocabulary))
        daily = daily_from_facts(*parts, vocabulary=vocabulary)
        assert "Exchange hashpartitioning(user_id" not in daily._jdf.queryExecution().executedPlan().toString()
        assert rows(daily) == rows(daily_snapshot(events, vocabulary=vocabulary))
        early = read_fact_tables(spark, name, end=middle)
        assert rows(daily_from_facts(*early, vocabulary=vocabulary)) == rows(
            daily_snapshot(events.filter(F.col("date") <= middle), vocabulary=vocabulary)
        )
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for table in ("user_days", "user_items"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")

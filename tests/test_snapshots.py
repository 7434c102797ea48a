"""Point-in-time rules of the snapshots."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from buywave.operators import events as ev
from buywave.operators import history as hist
from buywave.plans.snapshots import daily_snapshot, training_snapshots
from query_catalog import fixtures as fixture
from query_catalog.event_queries import loaded
from tests import brute_force
from tests.conftest import SMALL, day


def snap(frame, user, n):
    d = day(n).date()
    rows = [r.asDict() for r in frame.collect() if r["user_id"] == user and r["snapshot_date"] == d]
    assert len(rows) == 1
    return rows[0]


def same(found, wanted):
    keys = ["user_id", "snapshot_date"]
    found = found.toPandas().sort_values(keys).reset_index(drop=True)
    wanted = wanted.sort_values(keys).reset_index(drop=True)
    assert sorted(found.columns) == sorted(wanted.columns)
    pd.testing.assert_frame_equal(found[wanted.columns], wanted, check_dtype=False, atol=1e-6)


@pytest.mark.parametrize("sparse", [False, True])
def test_training_matches_brute_force(spark, sparse):
    events = loaded(spark, SMALL)
    if sparse:  # idle days and a missing calendar day
        number = F.col("event_id").cast("bigint")
        events = events.filter(((number * 7919 + F.col("user_id").cast("bigint")) % 10 < 3) & (F.dayofmonth("ts") != 11))
    local = events.select("event_id", "event_type", "ts", "date", "user_id", "region", "item_id", "price").toPandas()
    same(training_snapshots(events), brute_force.training(local))
    same(daily_snapshot(events, vocabulary=ev.fit_vocabulary(events)), brute_force.daily(local))


def test_window_edges(make_events):
    ages = [0, 2, 3, 6, 7, 29, 30]
    events = make_events([("u", "click", day(40 - a), 1.0) for a in ages] + [("v", "click", day(47), 1.0)])
    row = snap(training_snapshots(events), "u", 40)
    assert row["events_last_7d"] == 4 and row["events_last_30d"] == 6 and row["total_events"] == 7
    assert row["micro_event_growth"] == pytest.approx(2 / 4)


def test_target_takes_first_purchase_of_next_purchase_day(make_events):
    events = make_events(
        [
            ("u", "click", day(0), None),
            ("u", "purchase", day(3, 15), 99.0),
            ("u", "purchase", day(3, 9), 10.0),
            ("u", "click", day(20), None),
        ]
    )
    row = snap(training_snapshots(events), "u", 0)
    assert (row["will_purchase_next_7d"], row["days_to_next_purchase"], row["next_purchase_amount"]) == (1, 3, 10.0)


def test_purchase_on_the_snapshot_day_is_no_target(make_events):
    events = make_events([("u", "purchase", day(0), 5.0), ("u", "click", day(10), None)])
    row = snap(training_snapshots(events), "u", 0)
    assert (row["will_purchase_next_7d"], row["days_to_next_purchase"], row["next_purchase_amount"]) == (0, 999, 0.0)


def test_horizon_edges(make_events):
    rows = []
    for user, gap in (("a", 1), ("b", 7), ("c", 8)):
        rows += [(user, "click", day(0), None), (user, "purchase", day(gap), 2.0)]
    found = training_snapshots(make_events(rows + [("z", "click", day(30), None)]))
    got = {u: snap(found, u, 0)["days_to_next_purchase"] for u in "abc"}
    assert got == {"a": 1, "b": 7, "c": 999}


def test_dates_after_the_cutoff_only_look_ahead(make_events):
    events = make_events([("u", "click", day(0), None), ("u", "purchase", day(7), 3.0)])
    found = training_snapshots(events).collect()
    assert [(r["snapshot_date"], r["will_purchase_next_7d"]) for r in found] == [(day(0).date(), 1)]


def test_last_fifty_events(make_events):
    rows = [("u", "view", day(0), None)] + [("u", "click", day(1, 1, i), None) for i in range(50)]
    found = hist.sequence_embedding(make_events(rows))
    assert snap(found, "u", 0)["seq_emb_0"] == 1.0
    row = snap(found, "u", 1)
    assert (row["seq_emb_0"], row["seq_emb_1"]) == (0.0, 1.0)


def test_null_type_takes_a_slot(make_events):
    rows = [("u", "view", day(0, 1), None), ("u", None, day(0, 2), None), ("u", "click", day(0, 3), None)]
    events = make_events(rows)
    full = snap(hist.sequence_embedding(events), "u", 0)
    assert (full["seq_emb_0"], full["seq_emb_1"]) == (0.5, 0.5)
    short = snap(hist.sequence_embedding(events, length=2), "u", 0)
    assert (short["seq_emb_0"], short["seq_emb_1"]) == (0.0, 1.0)


def test_unknown_types_give_zeros(make_events):
    found = snap(hist.sequence_embedding(make_events([("u", "view", day(0), None)]), vocabulary=["click"]), "u", 0)
    assert found["seq_emb_0"] == 0.0


def test_equal_timestamps_are_ordered_by_id(make_events):
    events = make_events([("u", "click", day(0), None), ("u", "view", day(0), None)])
    assert snap(hist.asof_last_event(events), "u", 0)["last_event_type"] == "view"
    assert ev.fit_vocabulary(events) == ["click", "view"]


def test_vocabulary_has_no_cap(spark, make_events):
    events = make_events([("u", f"t{i}", day(0), None) for i in range(2500)] + [("u", "early", day(-1), None)])
    assert ev.fit_vocabulary(events) == ["early", *(f"t{i}" for i in range(2500))]


def test_vocabulary_with_null_ids(make_events):
    events = make_events([("u", "b", day(0), None), ("u", "a", day(0), None), ("u", "c", day(0), None)])
    no_id = events.withColumn("event_id", F.when(F.col("event_type") != "b", F.col("event_id")))
    assert ev.fit_vocabulary(no_id) == ["a", "c", "b"]  # the null id comes last
    none = events.withColumn("event_id", F.lit(None).cast("string"))
    assert ev.fit_vocabulary(none) == ["a", "b", "c"]


def test_lifetime_without_prices(make_events):
    events = make_events([("u", "purchase", day(0), 5.0)]).drop("price")
    assert ev.user_lifetime(events).first()["total_spent"] == 0.0


def test_empty_item_counts_null_item_does_not(spark, make_events):
    events = make_events([("u", "click", day(0, 1), None, "a"), ("u", "click", day(0, 2), None)])
    assert ev.distinct_items(events).first()["distinct_items"] == 2
    no_item = events.withColumn("item_id", F.lit(None).cast("string"))
    assert ev.distinct_items(no_item).count() == 0
    assert daily_snapshot(no_item, vocabulary=[]).first()["distinct_items"] == 0


def test_spend_counts_every_event_type(make_events):
    events = make_events([("u", "view", day(0), 4.0), ("u", "purchase", day(0), 6.0)])
    assert daily_snapshot(events, vocabulary=ev.fit_vocabulary(events)).first()["total_spent"] == 10.0


def test_events_without_user_shape_the_dates_but_give_no_rows(make_events):
    events = make_events([("u", "click", day(0), None), (None, "view", day(2), None), ("u", "click", day(9), None)])
    found = training_snapshots(events)
    assert [(r["user_id"], r["snapshot_date"]) for r in found.orderBy("snapshot_date").collect()] == [
        ("u", day(0).date()),
        ("u", day(2).date()),
    ]
    assert "seq_emb_1" in found.columns


def test_no_leakage(spark):
    events = loaded(spark, SMALL)
    cut = dt.date(2024, 1, 15)
    vocabulary = ev.fit_vocabulary(events)
    features = [c for c in training_snapshots(events, vocabulary=vocabulary).columns if "next" not in c]
    past = events.filter(F.col("date") <= cut)
    before = training_snapshots(past, horizon_days=0, vocabulary=vocabulary).select(features)
    after = training_snapshots(events, vocabulary=vocabulary, end=cut).select(features)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0


def test_share_and_window_invariants(spark):
    found = training_snapshots(loaded(spark, SMALL)).toPandas()
    shares = found[[c for c in found.columns if c.startswith("seq_emb_")]].sum(axis=1)
    assert ((shares - 1).abs() < 1e-9).all()
    assert (found["events_last_7d"] <= found["events_last_30d"]).all()
    assert (found["events_last_30d"] <= found["total_events"]).all()


def test_date_range_and_optional_columns(spark):
    events = loaded(spark, SMALL)
    some = training_snapshots(events, start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 11))
    assert {r["snapshot_date"].day for r in some.select("snapshot_date").distinct().collect()} == {10, 11}
    bare = daily_snapshot(events.drop("item_id", "region", "price"), vocabulary=ev.fit_vocabulary(events))
    row = bare.first()
    assert row["distinct_items"] == 0 and row["last_item"] is None and row["total_spent"] == 0.0
    assert "micro_spent_growth" not in bare.columns


def test_trend_columns(spark):
    events = loaded(spark, SMALL)
    found = training_snapshots(events, trends_daily=fixture.trend_days(spark, SMALL), vocabulary=[])
    assert found.filter(F.col("trend_popularity_mean").isNull()).count() == 0


@pytest.mark.parametrize("short, long", [(0, 7), (3, 0), (8, 7), (-1, 7)])
def test_bad_micro_windows(make_events, short, long):
    with pytest.raises(ValueError):
        training_snapshots(make_events([("u", "click", day(0), None)]), short_window=short, long_window=long)


def test_bad_sequence_length(make_events):
    with pytest.raises(ValueError):
        daily_snapshot(make_events([("u", "click", day(0), None)]), vocabulary=[], sequence_length=0)

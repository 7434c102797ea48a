"""Physical plans: what reaches the scan, what is reduced before the shuffle, what is exchanged."""

import datetime as dt

import pytest

from buywave.operators import audience, events as ev
from buywave.plans.snapshots import daily_snapshot, training_snapshots
from buywave.sources.events import export_window
from query_catalog import fixtures as fixture
from query_catalog.event_queries import loaded
from tests.conftest import SMALL

VOCABULARY = ["click", "view"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As with tables beyond the broadcast limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def main_plan(text):
    """The plan without its scalar subqueries."""
    lines, skip = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "Subquery" in line and "+- Subquery" in line or line.lstrip(" :+-").startswith("Subquery") else None
        if skip is None:
            lines.append(line)
    return "\n".join(lines)


def test_training_exchanges(spark, no_broadcast):
    text = main_plan(plan(training_snapshots(loaded(spark, SMALL), vocabulary=VOCABULARY)))
    # Day sums, last events, first purchases and new items meet on (user, day); one more
    # exchange brings them to the user. None of them moves raw events unreduced.
    assert text.count("Exchange hashpartitioning(user_id") == 6
    assert text.count("BroadcastNestedLoopJoin") + text.count("CartesianProduct") == 0
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_daily_exchanges(spark, no_broadcast):
    text = main_plan(plan(daily_snapshot(loaded(spark, SMALL), vocabulary=VOCABULARY)))
    assert text.count("BroadcastNestedLoopJoin") + text.count("CartesianProduct") == 0
    assert text.count("Exchange hashpartitioning(user_id") == 6
    assert text.count("WindowGroupLimit") == 4


def test_day_sums_are_combined_before_the_shuffle(spark):
    text = plan(ev.user_day(loaded(spark, SMALL)))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_recent_predictions_are_limited_before_the_shuffle(spark):
    log = fixture.events(spark, SMALL).select("user_id", "event_id", "ts")
    assert plan(audience.recent_predictions(log)).count("WindowGroupLimit") == 2


def test_time_bound_is_pushed_to_the_scan(spark):
    text = plan(export_window(fixture.events(spark, SMALL), dt.datetime(2024, 2, 1), days=5))
    assert "GreaterThanOrEqual(ts," in text


def test_purchases_are_filtered_in_the_scan(spark):
    assert "EqualTo(event_type,purchase)" in plan(ev.first_purchase_per_day(loaded(spark, SMALL)))

"""Composed jobs: the daily run over stored facts, and the load of trends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.operators.state import rolled
from buywave.operators.trends import flatten_response
from buywave.plans.snapshots import daily_from_state
from buywave.sources import facts
from buywave.sources import trends as trend_source
from buywave.sources.events import changed_dates, load_events
from buywave.sources.snapshots import write_daily_snapshot


def daily_run(
    spark: SparkSession,
    events_path: str,
    facts_path: str,
    snapshot_path: str,
    run_date: dt.date,
    *,
    vocabulary: Sequence[str],
    trends_path: str | None = None,
    first: dt.date | None = None,
) -> DataFrame:
    """Take in the event files written since the last run, roll the users' state to ``run_date``, and store the
    snapshot under that date. Returns what is stored.

    The facts of every date that the new files have events of are built anew, whole: late events of earlier dates
    too. The state starts from the newest one before all of these dates and is rolled over the facts
    of the days since; on an ordinary day that is yesterday's state and one date of facts. A run for an earlier date
    sees no later facts, and a repeated run replaces its own rows. ``first`` leaves out events before
    that day. Progress is stored last, so a run that is stopped is simply done again.
    """
    progress = facts.read_progress(spark, facts_path)
    dates, mark, files = changed_dates(spark, events_path, progress["mark"], progress["files"])
    touched = [d for d in dates if first is None or d >= first]
    states = progress["states"]
    if touched:
        facts.write_facts(load_events(spark, events_path, dates=touched), facts_path)
        facts.write_first_items(spark, facts_path, min(touched) if progress["mark"] else None)
        states = {run: seen for run, seen in states.items() if dt.date.fromisoformat(run) < min(touched)}
    state, today = state_on(spark, facts_path, run_date, states)
    if today is None:
        raise ValueError(f"no events up to {run_date}")
    facts.write_state(state, facts_path, run_date)
    states = {**states, run_date.isoformat(): today.isoformat()}
    stored = facts.read_state(spark, facts_path, run_date)
    trends = trend_source.load_daily_trends(spark, trends_path) if trends_path else None
    # A table without trends adds no columns.
    if trends is not None and trends.isEmpty():
        trends = None
    snapshot = daily_from_state(stored, today, trends, vocabulary=vocabulary)
    write_daily_snapshot(snapshot, snapshot_path, run_date)
    facts.write_progress(spark, facts_path, {"mark": mark, "files": files, "states": states})
    return spark.read.parquet(f"{snapshot_path}/run_date={run_date.isoformat()}")


def state_on(
    spark: SparkSession, facts_path: str, run_date: dt.date, states: dict[str, str]
) -> tuple[DataFrame, dt.date | None]:
    """(the users' state on ``run_date``, the last observed date up to it), rolled from the newest of ``states``
    up to that date over the facts after it."""
    days, items = facts.read_facts(spark, facts_path, end=run_date)
    runs = [run for run in states if run <= run_date.isoformat()]
    if not runs:
        today = days.agg(F.max("date")).first()[0]
        firsts = facts.known_items(spark, facts_path).filter(F.col("date") <= F.lit(run_date))
        return (rolled(None, days, new_items(firsts), today), today) if today else (days, None)
    base = dt.date.fromisoformat(max(runs))
    since = days.filter(F.col("date") > F.lit(base))
    # One value, read from the folders of the dates since.
    today = since.agg(F.max("date")).first()[0] or dt.date.fromisoformat(states[base.isoformat()])
    firsts = facts.known_items(spark, facts_path).filter((F.col("date") > F.lit(base)) & (F.col("date") <= F.lit(run_date)))
    return rolled(facts.read_state(spark, facts_path, base), since, new_items(firsts), today), today


def new_items(firsts: DataFrame) -> DataFrame:
    return firsts.groupBy("user_id").agg(F.count(F.lit(1)).alias("new_items"))


def load_trends(
    spark: SparkSession, responses_path: str, queries: Sequence[str], region: str, table_path: str, stats_path: str
) -> DataFrame:
    """Saved responses to the trend table with its features (written once) and its statistics."""
    points = flatten_response(trend_source.read_responses(spark, responses_path), queries, region)
    stored = trend_source.write_trends_once(points, table_path)
    trend_source.write_load_stats(stored, stats_path)
    return stored

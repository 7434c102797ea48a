"""The rolled daily run: late events, first-seen items, progress, against builds from all events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from buywave.operators.events import distinct_items, normalize_loaded
from buywave.plans.daily import daily_run, state_on
from buywave.plans.snapshots import daily_snapshot
from buywave.sources import facts
from buywave.sources.events import changed_dates, load_events
from tests.conftest import EVENT_SCHEMA

START = dt.date(2024, 3, 1)
TYPES = ["view", "click", "purchase", "signup"]


def messages(seed, days, users=12, each=20):
    """Random events on the given day numbers; some days of some users are idle."""
    rng = random.Random(seed)
    rows = []
    for n in days:
        for k in range(rng.randint(1, each)):
            ts = dt.datetime.combine(START, dt.time(rng.randint(0, 23), rng.randint(0, 59))) + dt.timedelta(days=n)
            price = rng.choice((None, 2.5, 10.0, 99.99))
            user = rng.choice([f"u{rng.randint(1, users)}", "u1", None])
            rows.append((f"{seed}-{n}-{k}", rng.choice([*TYPES, None]), ts, "s", user, "UA-30", rng.choice(("", "i1", "i2", f"i{n}", None)), price, "{}"))
    return rows


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    rounded = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return sorted(map(repr, df.select(*rounded).collect()))


def rebuilt(spark, events, run_date):
    seen = load_events(spark, events).filter(F.col("date") <= F.lit(run_date))
    return rows_of(daily_snapshot(seen, vocabulary=TYPES))


def test_rolled_days_equal_rebuilds(spark, tmp_path):
    """Forty days with gaps, rolled one after the other in uneven steps."""
    events, where, daily = str(tmp_path / "events"), str(tmp_path / "facts"), str(tmp_path / "daily")
    days = [n for n in range(40) if n not in (3, 11, 12, 13, 30)]
    done = 0
    for upto in (0, 1, 3, 10, 14, 35, 36, 39):
        write(spark, messages(upto, [n for n in days if done <= n <= upto]) or messages(99, []), events)
        done = upto + 1
        run_date = START + dt.timedelta(days=upto)
        made = daily_run(spark, events, where, daily, run_date, vocabulary=TYPES)
        assert rows_of(made) == rebuilt(spark, events, run_date)


def test_late_events_reach_facts_states_and_items(spark, tmp_path):
    events, where, daily = str(tmp_path / "events"), str(tmp_path / "facts"), str(tmp_path / "daily")
    run = lambda n: daily_run(spark, events, where, daily, START + dt.timedelta(days=n), vocabulary=TYPES)
    for n in (0, 1, 2):
        write(spark, messages(n, [n]), events)
        run(n)
    # After the run of day 2, a file for days 0 and 1 arrives, together with day 3: it has an item seen first later.
    write(spark, messages(50, [0, 1]) + messages(51, [3]), events)
    assert rows_of(run(3)) == rebuilt(spark, events, START + dt.timedelta(days=3))
    assert set(facts.read_progress(spark, where)["states"]) == {"2024-03-04"}  # the others are out of date
    everything = load_events(spark, events)
    counted = facts.known_items(spark, where).groupBy("user_id").agg(F.count("*").alias("distinct_items"))
    assert rows_of(counted) == rows_of(distinct_items(everything))
    # A run for an earlier date sees no later events, and a repeated run gives the same.
    for n in (1, 3, 2, 3):
        assert rows_of(run(n)) == rebuilt(spark, events, START + dt.timedelta(days=n))
    # A date that loses its only first-seen item to an earlier one is emptied.
    write(spark, [("z", "view", dt.datetime(2024, 3, 6), "s", "zz", "r", "only", 1.0, "{}")], events)
    run(5)
    write(spark, [("y", "view", dt.datetime(2024, 3, 5), "s", "zz", "r", "only", 1.0, "{}")], events)
    assert rows_of(run(5)) == rebuilt(spark, events, START + dt.timedelta(days=5))
    found = facts.known_items(spark, where).filter("user_id = 'zz'").collect()
    assert [(r["item_id"], str(r["date"])) for r in found] == [("only", "2024-03-05")]


def test_only_new_files_are_read(spark, tmp_path):
    events = str(tmp_path / "events")
    write(spark, messages(1, [0, 1]), events)
    dates, mark, files = changed_dates(spark, events, None)
    assert [str(d) for d in dates] == ["2024-03-01", "2024-03-02"] and len(files) == 1
    assert changed_dates(spark, events, mark, files) == ([], mark, files)
    write(spark, messages(2, [1, 5]), events)
    later, newer, names = changed_dates(spark, events, mark, files)
    assert [str(d) for d in later] == ["2024-03-02", "2024-03-06"] and newer >= mark and set(names) != set(files)
    one = load_events(spark, events, dates=[dt.date(2024, 3, 2), dt.date(2024, 3, 6)])
    assert {str(r["date"]) for r in one.select("date").distinct().collect()} == {"2024-03-02", "2024-03-06"}
    assert load_events(spark, events, dates=[]).count() == 0


def test_stopped_run_is_done_again(spark, tmp_path, monkeypatch):
    events, where, daily = str(tmp_path / "events"), str(tmp_path / "facts"), str(tmp_path / "daily")
    run = lambda n: daily_run(spark, events, where, daily, START + dt.timedelta(days=n), vocabulary=TYPES)
    write(spark, messages(1, [0]), events)
    run(0)
    write(spark, messages(2, [0, 1]), events)

    def fails(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(facts, "write_progress", fails)
        with pytest.raises(RuntimeError):
            run(1)
    assert rows_of(run(1)) == rebuilt(spark, events, START + dt.timedelta(days=1))


def test_ordinary_day_reads_one_state_and_one_date(spark, tmp_path):
    events, where, daily = str(tmp_path / "events"), str(tmp_path / "facts"), str(tmp_path / "daily")
    for n in range(3):
        write(spark, messages(n, [n]), events)
        daily_run(spark, events, where, daily, START + dt.timedelta(days=n), vocabulary=TYPES)
    write(spark, messages(3, [3]), events)
    facts.write_facts(load_events(spark, events, dates=[START + dt.timedelta(days=3)]), where)
    facts.write_first_items(spark, where, START + dt.timedelta(days=3))
    states = facts.read_progress(spark, where)["states"]
    state, today = state_on(spark, where, START + dt.timedelta(days=3), states)
    assert str(today) == "2024-03-04"
    read = {f.split("=")[-1].split("/")[0] for f in executed_partitions(state)}
    assert read == {"2024-03-03", "2024-03-04"}  # the state as of one day, the facts of the next


def executed_partitions(df):
    """The folders of the files that the scans of the plan would read."""
    found = []
    for scan in scans(df._jdf.queryExecution().executedPlan()):
        for folder in listed(scan.selectedPartitions().filePartitionIterator()):
            found += [f.getPath().toString().rsplit("/", 1)[0] for f in listed(folder.files().iterator())]
    return found


def listed(iterator):
    while iterator.hasNext():
        yield iterator.next()


def scans(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    if plan.nodeName().startswith("Scan parquet"):
        yield plan
    for child in listed(plan.children().iterator()):
        yield from scans(child)


def test_bloom_filter_prunes_known_items(spark):
    rows = [(f"u{k % 50}", f"i{k}", START + dt.timedelta(days=k % 9)) for k in range(3000)]
    table = spark.createDataFrame(rows, "user_id string, item_id string, date date")
    found = facts.first_items_since(table, table, START + dt.timedelta(days=8))
    wanted = {r for r in rows if (r[2] - START).days == 8}
    assert {tuple(r) for r in found.collect()} == wanted


def test_empty_and_absent(spark, tmp_path):
    events, where = str(tmp_path / "events"), str(tmp_path / "facts")
    write(spark, messages(1, [4]), events)
    with pytest.raises(ValueError, match="no events up to"):
        daily_run(spark, events, where, str(tmp_path / "daily"), START, vocabulary=TYPES)
    nothing = normalize_loaded(spark.createDataFrame([], EVENT_SCHEMA))
    assert facts.first_items_since(nothing.select("user_id", "item_id", "date"), nothing.select("user_id", "item_id", "date"), START).count() == 0

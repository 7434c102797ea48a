"""Queries on the event table, the user state over time, and the snapshots."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from buywave.functions import features as fx
from buywave.operators import events as ev
from buywave.operators import facts
from buywave.operators import history as hist
from buywave.operators import splits
from buywave.operators.trends import join_trends
from buywave.plans.daily import daily_run
from buywave.plans.snapshots import daily_from_facts, daily_snapshot, training_from_facts, training_snapshots
from buywave.session import ensure_checkpoint_dir
from buywave.sources import events as event_source
from buywave.sources.snapshots import latest_rows
from buywave.streaming.rates import event_rate
from query_catalog import fixtures as fixture
from query_catalog.fixtures import EVENTS_SQL, TREND_DAYS_SQL
from query_catalog.registry import ORACLES, query, with_views


def loaded(spark, sf_dir):
    return ev.normalize_loaded(fixture.events(spark, sf_dir))


# --- sources ---------------------------------------------------------------------------------

EXPORT_NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


@query(
    "export_window",
    with_views(
        EVENTS_SQL,
        """SELECT event_id, event_type, ts, session_id, user_id, region, item_id, ROUND(price, 6) AS price, properties
           FROM fx_events WHERE ts >= TIMESTAMP '2024-01-11 12:00:00'""",
    ),
)
def export_window(spark, sf_dir):
    return event_source.export_window(fixture.events(spark, sf_dir), EXPORT_NOW, days=20)


@query(
    "load_events",
    """SELECT event_id, ts, user_id, event_type, ROUND(value, 6) AS value, props, CAST(ts AS DATE) AS date FROM events""",
)
def load_events(spark, sf_dir):
    return event_source.load_events(spark, sf_dir, pattern="events.parquet")


@query(
    "union_parts",
    with_views(EVENTS_SQL, "SELECT event_id, event_type, ts, user_id, ROUND(price, 6) AS price FROM fx_events"),
)
def union_parts(spark, sf_dir):
    rows = fixture.events(spark, sf_dir).select("event_id", "event_type", "ts", "user_id", "price")
    priced = F.col("price").isNotNull()
    return ev.union_parts([rows.filter(priced), rows.filter(~priced).drop("price")])


@query(
    "latest_snapshot",
    with_views(
        EVENTS_SQL,
        """SELECT user_id, date AS run_date, COUNT(*) AS events, ROUND(SUM(amount), 6) AS spent FROM ev
           WHERE date = (SELECT MAX(date) FROM ev) GROUP BY 1, 2""",
    ),
)
def latest_snapshot(spark, sf_dir):
    runs = ev.user_day(loaded(spark, sf_dir)).withColumnRenamed("date", "run_date")
    return latest_rows(runs).select("user_id", "run_date", "events", "spent")


# --- aggregates --------------------------------------------------------------------------------


@query(
    "event_stats",
    with_views(
        EVENTS_SQL, "SELECT COUNT(*) AS events, MIN(date) AS first_date, MAX(date) AS last_date FROM ev"
    ),
)
def event_stats(spark, sf_dir):
    return ev.event_stats(loaded(spark, sf_dir))


USER_DAY_SQL = """
user_day AS (
  SELECT user_id, date, COUNT(*) AS events,
         CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
         CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
         SUM(amount) AS spent
  FROM ev GROUP BY user_id, date)"""


@query(
    "user_day_agg",
    with_views(
        EVENTS_SQL + "," + USER_DAY_SQL,
        "SELECT user_id, date, events, clicks, purchases, ROUND(spent, 6) AS spent FROM user_day",
    ),
)
def user_day_agg(spark, sf_dir):
    return ev.user_day(loaded(spark, sf_dir))


@query(
    "user_lifetime",
    with_views(
        EVENTS_SQL,
        """SELECT user_id, COUNT(*) AS total_events,
                  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS total_clicks,
                  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS total_purchases,
                  ROUND(SUM(amount), 6) AS total_spent, MIN(ts) AS first_ts, MAX(ts) AS last_ts,
                  COUNT(DISTINCT date) AS unique_days
           FROM ev GROUP BY user_id""",
    ),
)
def user_lifetime(spark, sf_dir):
    return ev.user_lifetime(loaded(spark, sf_dir))


@query(
    "distinct_items",
    with_views(EVENTS_SQL, "SELECT user_id, COUNT(DISTINCT item_id) AS distinct_items FROM ev GROUP BY user_id"),
)
def distinct_items(spark, sf_dir):
    return ev.distinct_items(loaded(spark, sf_dir))


@query(
    "running_distinct_items",
    with_views(
        EVENTS_SQL + "," + USER_DAY_SQL,
        """SELECT d.user_id, d.date, COUNT(DISTINCT e.item_id) AS distinct_items
           FROM user_day d JOIN ev e ON e.user_id = d.user_id AND e.date <= d.date GROUP BY 1, 2""",
    ),
)
def running_distinct_items(spark, sf_dir):
    return hist.running_distinct_items(loaded(spark, sf_dir))


VOCABULARY_SQL = """
vocabulary AS (
  SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS INT) AS position
  FROM (SELECT event_type, ts, event_id,
               ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
        FROM ev WHERE event_type IS NOT NULL) firsts
  WHERE n = 1)"""


@query(
    "event_vocab",
    with_views(EVENTS_SQL + "," + VOCABULARY_SQL, "SELECT event_type, position FROM vocabulary"),
)
def event_vocab(spark, sf_dir):
    return ev.event_vocabulary(loaded(spark, sf_dir))


@query(
    "last_event_per_day",
    with_views(
        EVENTS_SQL,
        """SELECT user_id, date, ts, event_id, event_type, region, item_id
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) AS n FROM ev) d
           WHERE n = 1""",
    ),
)
def last_event_per_day(spark, sf_dir):
    return ev.last_event_per_day(loaded(spark, sf_dir))


@query(
    "event_rate",
    """WITH ticks AS (
         SELECT CAST(FLOOR(epoch(ts) / 2) * 2 AS BIGINT) AS tick, COUNT(*) AS events FROM events GROUP BY 1),
       bounds AS (SELECT MIN(tick) AS first FROM ticks)
       SELECT tick, events, ROUND(events / 2.0, 6) AS rate,
              ROUND(SUM(events) OVER (ORDER BY tick RANGE BETWEEN 38 PRECEDING AND CURRENT ROW)
                    / CAST(2 * LEAST(20, (tick - first) / 2 + 1) AS DOUBLE), 6) AS recent_rate,
              ROUND(SUM(events) OVER (ORDER BY tick) / CAST(2 * ((tick - first) / 2 + 1) AS DOUBLE), 6) AS overall_rate
       FROM ticks, bounds""",
)
def event_rates(spark, sf_dir):
    return event_rate(fixture.table(spark, sf_dir, "events").select("ts"))


# --- user state on the spine ---------------------------------------------------------------------

SPINE_SQL = """
spine AS (
  SELECT f.user_id, d.date AS snapshot_date
  FROM (SELECT user_id, MIN(date) AS first_day FROM ev GROUP BY user_id) f
  JOIN (SELECT DISTINCT date FROM ev) d ON d.date >= f.first_day)"""
TRAIN_SPINE_SQL = """
train_spine AS (
  SELECT * FROM spine WHERE snapshot_date <= (SELECT MAX(date) FROM ev) - INTERVAL 7 DAY)"""


@query(
    "snapshot_spine",
    with_views(EVENTS_SQL + "," + SPINE_SQL + "," + TRAIN_SPINE_SQL, "SELECT user_id, snapshot_date FROM train_spine"),
)
def snapshot_spine(spark, sf_dir):
    return hist.snapshot_spine(loaded(spark, sf_dir), horizon_days=7)


@query(
    "running_totals",
    with_views(
        EVENTS_SQL + "," + SPINE_SQL,
        """SELECT s.user_id, s.snapshot_date, COUNT(*) AS total_events, COUNT(DISTINCT e.date) AS unique_days,
                  COUNT(*) FILTER (WHERE e.event_type = 'click') AS total_clicks,
                  COUNT(*) FILTER (WHERE e.event_type = 'purchase') AS total_purchases,
                  ROUND(SUM(e.amount), 6) AS total_spent
           FROM spine s JOIN ev e ON e.user_id = s.user_id AND e.date <= s.snapshot_date GROUP BY 1, 2""",
    ),
)
def running_totals(spark, sf_dir):
    return hist.running_totals(loaded(spark, sf_dir))


def _window_sql(k: int) -> str:
    near = f"e.date > s.snapshot_date - INTERVAL {k} DAY"
    return f"""
       COUNT(e.event_id) FILTER (WHERE {near}) AS events_{k},
       COUNT(e.event_id) FILTER (WHERE {near} AND e.event_type = 'purchase') AS purchases_{k},
       ROUND(COALESCE(SUM(e.amount) FILTER (WHERE {near}), 0.0), 6) AS spent_{k}"""


WINDOWS_SQL = (
    "\nwindowed AS (SELECT s.user_id, s.snapshot_date,"
    + ",".join(_window_sql(k) for k in (3, 7, 30))
    + "\n  FROM spine s LEFT JOIN ev e ON e.user_id = s.user_id AND e.date <= s.snapshot_date GROUP BY 1, 2)"
)


@query(
    "rolling_activity",
    with_views(
        EVENTS_SQL + "," + SPINE_SQL + "," + WINDOWS_SQL,
        """SELECT user_id, snapshot_date, events_7 AS events_last_7d, events_30 AS events_last_30d,
                  purchases_30 AS purchases_last_30d, ROUND(spent_30, 6) AS spent_last_30d FROM windowed""",
    ),
)
def rolling_activity(spark, sf_dir):
    return hist.rolling_on_spine(loaded(spark, sf_dir), [7, 30]).select(
        "user_id",
        "snapshot_date",
        F.col("events_7").alias("events_last_7d"),
        F.col("events_30").alias("events_last_30d"),
        F.col("purchases_30").alias("purchases_last_30d"),
        F.col("spent_30").alias("spent_last_30d"),
    )


MICRO_SQL = """
       CASE WHEN events_7 > 0 THEN ROUND(events_3 / CAST(events_7 AS DOUBLE), 6) ELSE 0.0 END AS micro_event_growth,
       CASE WHEN purchases_7 > 0 THEN ROUND(purchases_3 / CAST(purchases_7 AS DOUBLE), 6) ELSE 0.0 END AS micro_purchase_growth,
       CASE WHEN events_3 > 0 THEN ROUND(purchases_3 / CAST(events_3 AS DOUBLE), 6) ELSE 0.0 END AS micro_purchase_ratio,
       CASE WHEN spent_7 > 0 THEN ROUND(spent_3 / spent_7, 6) ELSE 0.0 END AS micro_spent_growth"""


@query(
    "micro_trend",
    with_views(
        EVENTS_SQL + "," + SPINE_SQL + "," + WINDOWS_SQL,
        f"SELECT user_id, snapshot_date, {MICRO_SQL} FROM windowed",
    ),
)
def micro_trend(spark, sf_dir):
    grid = hist.rolling_on_spine(loaded(spark, sf_dir), [3, 7])
    return grid.select(
        "user_id", "snapshot_date", *[c.alias(n) for n, c in fx.micro_trend_ratios(3, 7).items()]
    )


ASOF_SQL = """
asof_event AS (
  SELECT user_id, snapshot_date, event_type AS last_event_type, region AS last_region, item_id AS last_item, ts AS last_ts
  FROM (SELECT s.user_id, s.snapshot_date, e.event_type, e.region, e.item_id, e.ts,
               ROW_NUMBER() OVER (PARTITION BY s.user_id, s.snapshot_date ORDER BY e.ts DESC, e.event_id DESC) AS n
        FROM spine s JOIN ev e ON e.user_id = s.user_id AND e.date <= s.snapshot_date) ranked
  WHERE n = 1)"""


@query(
    "asof_last_event",
    with_views(
        EVENTS_SQL + "," + SPINE_SQL + "," + ASOF_SQL,
        "SELECT user_id, snapshot_date, last_event_type, last_region, last_item, last_ts FROM asof_event",
    ),
)
def asof_last_event(spark, sf_dir):
    return hist.asof_last_event(loaded(spark, sf_dir))


TARGET_SQL = """
target AS (
  SELECT s.user_id, s.snapshot_date,
         CAST(CASE WHEN p.days BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS BIGINT) AS will_purchase_next_7d,
         CAST(CASE WHEN p.days BETWEEN 1 AND 7 THEN p.days ELSE 999 END AS BIGINT) AS days_to_next_purchase,
         CASE WHEN p.days BETWEEN 1 AND 7 THEN p.amount ELSE 0.0 END AS next_purchase_amount
  FROM train_spine s LEFT JOIN (
    SELECT s.user_id, s.snapshot_date, date_diff('day', s.snapshot_date, e.date) AS days, e.amount,
           ROW_NUMBER() OVER (PARTITION BY s.user_id, s.snapshot_date ORDER BY e.ts, e.event_id) AS n
    FROM train_spine s JOIN ev e
      ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.date > s.snapshot_date) p
  ON p.user_id = s.user_id AND p.snapshot_date = s.snapshot_date AND p.n = 1)"""


@query(
    "next_purchase_target",
    with_views(
        ",".join([EVENTS_SQL, SPINE_SQL, TRAIN_SPINE_SQL, TARGET_SQL]),
        """SELECT user_id, snapshot_date, will_purchase_next_7d, days_to_next_purchase,
                  ROUND(next_purchase_amount, 6) AS next_purchase_amount FROM target""",
    ),
)
def next_purchase_target(spark, sf_dir):
    return hist.next_purchase_target(loaded(spark, sf_dir))


def _share_sql(i: int) -> str:
    return f"ROUND(COUNT(*) FILTER (WHERE v.position = {i}) / CAST(COUNT(v.position) AS DOUBLE), 6) AS seq_emb_{i}"


EMBEDDING_COLUMNS = [f"seq_emb_{i}" for i in range(5)]
EMBEDDING_SQL = (
    "\nembedding AS (SELECT r.user_id, r.snapshot_date, "
    + ", ".join(_share_sql(i) for i in range(5))
    + """
  FROM (SELECT s.user_id, s.snapshot_date, e.event_type,
               ROW_NUMBER() OVER (PARTITION BY s.user_id, s.snapshot_date ORDER BY e.ts DESC, e.event_id DESC) AS n
        FROM spine s JOIN ev e ON e.user_id = s.user_id AND e.date <= s.snapshot_date) r
  LEFT JOIN vocabulary v ON v.event_type = r.event_type WHERE r.n <= 50 GROUP BY 1, 2)"""
)


@query(
    "sequence_embedding",
    with_views(
        ",".join([EVENTS_SQL, VOCABULARY_SQL, SPINE_SQL, EMBEDDING_SQL]),
        f"SELECT user_id, snapshot_date, {', '.join(EMBEDDING_COLUMNS)} FROM embedding",
    ),
)
def sequence_embedding(spark, sf_dir):
    return hist.sequence_embedding(loaded(spark, sf_dir))


@query(
    "trend_join",
    with_views(
        ",".join([EVENTS_SQL, SPINE_SQL, TREND_DAYS_SQL]),
        """SELECT s.user_id, s.snapshot_date, ROUND(t.trend_popularity_mean, 6) AS trend_popularity_mean,
                  ROUND(t.trend_popularity_max, 6) AS trend_popularity_max
           FROM spine s LEFT JOIN trend_days t ON t.date = s.snapshot_date""",
    ),
)
def trend_join(spark, sf_dir):
    return join_trends(hist.snapshot_spine(loaded(spark, sf_dir)), fixture.trend_days(spark, sf_dir))


# --- snapshots -------------------------------------------------------------------------------------

STATE_SQL = """
state AS (
  SELECT s.user_id, s.snapshot_date, COUNT(*) AS total_events, COUNT(DISTINCT e.date) AS unique_days,
         COUNT(*) FILTER (WHERE e.event_type = 'click') AS total_clicks,
         COUNT(*) FILTER (WHERE e.event_type = 'purchase') AS total_purchases,
         ROUND(SUM(e.amount), 6) AS total_spent, COUNT(DISTINCT e.item_id) AS distinct_items,
         date_diff('day', MIN(e.date), s.snapshot_date) AS days_since_first,
         date_diff('day', MAX(e.date), s.snapshot_date) AS days_since_last
  FROM spine s JOIN ev e ON e.user_id = s.user_id AND e.date <= s.snapshot_date GROUP BY 1, 2)"""
RATIOS_SQL = """
       ROUND(w.purchases_30 / CAST(GREATEST(1, w.events_30) AS DOUBLE), 6) AS conversion_rate_30d,
       ROUND(w.spent_30 / GREATEST(1, w.purchases_30), 8) AS avg_order_value_30d,
       ROUND(a.total_purchases / CAST(GREATEST(1, a.unique_days) AS DOUBLE), 6) AS purchase_frequency,
       ROUND(a.total_spent / GREATEST(1, a.total_events), 8) AS avg_spend_per_event,
       ROUND(a.total_events / CAST(GREATEST(1, a.unique_days) AS DOUBLE), 6) AS events_per_day"""
CORE_SQL = f"""
       a.snapshot_date, a.user_id, a.total_events, a.unique_days, a.total_clicks, a.total_purchases,
       ROUND(a.total_spent, 6) AS total_spent, a.distinct_items,
       w.events_7 AS events_last_7d, w.events_30 AS events_last_30d, w.purchases_30 AS purchases_last_30d,
       ROUND(w.spent_30, 6) AS spent_last_30d, {RATIOS_SQL},
       a.days_since_first, a.days_since_last, ROUND(1.0 / (1.0 + a.days_since_last), 6) AS recency_score,
       l.last_event_type, l.last_region, l.last_item, {MICRO_SQL},
       {", ".join("m." + c for c in EMBEDDING_COLUMNS)},
       ROUND(t.trend_popularity_mean, 6) AS trend_popularity_mean,
       ROUND(t.trend_popularity_max, 6) AS trend_popularity_max"""
JOINS_SQL = """
       JOIN windowed w ON w.user_id = a.user_id AND w.snapshot_date = a.snapshot_date
       JOIN asof_event l ON l.user_id = a.user_id AND l.snapshot_date = a.snapshot_date
       JOIN embedding m ON m.user_id = a.user_id AND m.snapshot_date = a.snapshot_date
       LEFT JOIN trend_days t ON t.date = a.snapshot_date"""
STATE_VIEWS = ",".join(
    [EVENTS_SQL, VOCABULARY_SQL, SPINE_SQL, STATE_SQL, WINDOWS_SQL, ASOF_SQL, EMBEDDING_SQL, TREND_DAYS_SQL]
)


@query(
    "training_snapshots",
    with_views(
        ",".join([STATE_VIEWS, TRAIN_SPINE_SQL, TARGET_SQL]),
        f"""SELECT {CORE_SQL}, y.will_purchase_next_7d, y.days_to_next_purchase,
                   ROUND(y.next_purchase_amount, 6) AS next_purchase_amount
            FROM state a {JOINS_SQL}
            JOIN target y ON y.user_id = a.user_id AND y.snapshot_date = a.snapshot_date""",
    ),
)
def training(spark, sf_dir):
    return training_snapshots(loaded(spark, sf_dir), trends_daily=fixture.trend_days(spark, sf_dir))


TODAY = "a.snapshot_date = (SELECT MAX(date) FROM ev)"


@query("daily_snapshot", with_views(STATE_VIEWS, f"SELECT {CORE_SQL} FROM state a {JOINS_SQL} WHERE {TODAY}"))
def daily(spark, sf_dir):
    events = loaded(spark, sf_dir)
    return daily_snapshot(events, trends_daily=fixture.trend_days(spark, sf_dir), vocabulary=ev.fit_vocabulary(events))


def from_facts(spark, sf_dir, build):
    """``build`` over the facts of the events instead of the events."""
    events = loaded(spark, sf_dir)
    return build(
        facts.user_day_facts(events),
        facts.user_item_days(events),
        trends_daily=fixture.trend_days(spark, sf_dir),
        vocabulary=ev.fit_vocabulary(events),
    )


@query("training_from_facts", ORACLES["training_snapshots"])
def training_of_facts(spark, sf_dir):
    return from_facts(spark, sf_dir, training_from_facts)


@query("daily_from_facts", ORACLES["daily_snapshot"])
def daily_of_facts(spark, sf_dir):
    return from_facts(spark, sf_dir, daily_from_facts)


@query("daily_run", ORACLES["daily_snapshot"])
def rolled_daily_run(spark, sf_dir):
    """Two runs of the daily job over the table as event files: the second takes in the last day, and a tenth of all
    earlier events, which come late; the state is rolled over both."""
    events = fixture.events(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    paths = [f"{base}/{name}" for name in ("events", "facts", "daily")]
    vocabulary = ev.fit_vocabulary(loaded(spark, sf_dir))
    last = events.agg(F.max(F.to_date("ts"))).first()[0]
    if last is None:
        return daily(spark, sf_dir)
    late = (F.to_date("ts") >= F.lit(last)) | (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
    made = None
    for part, run_date in ((~late, last - dt.timedelta(days=1)), (late, last)):
        events.filter(part).write.mode("append").parquet(paths[0])
        made = daily_run(spark, *paths, run_date, vocabulary=vocabulary)
    return join_trends(made, fixture.trend_days(spark, sf_dir))


def plain_daily(spark, sf_dir):
    return daily_snapshot(loaded(spark, sf_dir), vocabulary=[])


@query(
    "derived_ratios",
    with_views(
        ",".join([EVENTS_SQL, SPINE_SQL, STATE_SQL, WINDOWS_SQL]),
        f"""SELECT a.user_id, {RATIOS_SQL} FROM state a
            JOIN windowed w ON w.user_id = a.user_id AND w.snapshot_date = a.snapshot_date WHERE {TODAY}""",
    ),
)
def derived_ratios(spark, sf_dir):
    return plain_daily(spark, sf_dir).select("user_id", *fx.derived_ratios())


@query(
    "recency",
    with_views(
        ",".join([EVENTS_SQL, SPINE_SQL, STATE_SQL]),
        """SELECT user_id, snapshot_date, days_since_first, days_since_last,
                  ROUND(1.0 / (1.0 + days_since_last), 6) AS recency_score FROM state""",
    ),
)
def recency(spark, sf_dir):
    grid = hist.expand_to_dates(
        hist.running_user_totals(ev.user_day(loaded(spark, sf_dir))),
        loaded(spark, sf_dir),
    )
    return grid.select(
        "user_id",
        "snapshot_date",
        F.datediff("snapshot_date", "first_day").cast("bigint").alias("days_since_first"),
        F.datediff("snapshot_date", "date").cast("bigint").alias("days_since_last"),
    ).withColumn("recency_score", fx.recency_score())


def labelled(spark, sf_dir):
    """Training rows without the embedding, for the split and the diagnostics."""
    return training_snapshots(loaded(spark, sf_dir), vocabulary=[])


TRAIN_VIEWS = ",".join([EVENTS_SQL, SPINE_SQL, TRAIN_SPINE_SQL, TARGET_SQL])
SPLIT_SQL = """
split_dates AS (
  SELECT snapshot_date,
         CASE WHEN i <= FLOOR(n * 0.7) THEN 'train' WHEN i <= FLOOR(n * 0.7) + FLOOR(n * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT snapshot_date, ROW_NUMBER() OVER (ORDER BY snapshot_date) AS i, COUNT(*) OVER () AS n
        FROM (SELECT DISTINCT snapshot_date FROM train_spine) d) numbered)"""


@query(
    "time_split",
    with_views(
        TRAIN_VIEWS + "," + SPLIT_SQL,
        """SELECT y.user_id, y.snapshot_date, y.will_purchase_next_7d, s.split
           FROM target y JOIN split_dates s ON s.snapshot_date = y.snapshot_date""",
    ),
)
def time_split(spark, sf_dir):
    events = loaded(spark, sf_dir)
    targets = hist.next_purchase_target(events)
    return splits.time_split(targets, dates=hist.snapshot_dates(events, 7)).select("user_id", "snapshot_date", "will_purchase_next_7d", "split")


@query(
    "split_distribution",
    with_views(
        TRAIN_VIEWS + "," + SPLIT_SQL,
        """SELECT s.split, CAST(SUM(y.will_purchase_next_7d) AS BIGINT) AS positives, COUNT(*) AS total,
                  ROUND(SUM(y.will_purchase_next_7d) / CAST(COUNT(*) AS DOUBLE), 6) AS rate
           FROM target y JOIN split_dates s ON s.snapshot_date = y.snapshot_date GROUP BY s.split""",
    ),
)
def split_distribution(spark, sf_dir):
    events = loaded(spark, sf_dir)
    targets = hist.next_purchase_target(events)
    return splits.split_distribution(splits.time_split(targets, dates=hist.snapshot_dates(events, 7)))


def _diagnosed_sql(feature: str, value: str) -> str:
    return f"""
       SELECT '{feature}' AS feature,
              AVG(CASE WHEN will_purchase_next_7d = 1 THEN {value} END) AS pos_mean,
              AVG(CASE WHEN will_purchase_next_7d = 0 THEN {value} END) AS neg_mean,
              AVG(CAST(will_purchase_next_7d AS DOUBLE)) AS positive_rate FROM labelled"""


@query(
    "target_diagnostics",
    with_views(
        ",".join([TRAIN_VIEWS, STATE_SQL, WINDOWS_SQL])
        + """,
labelled AS (
  SELECT y.will_purchase_next_7d, CAST(w.events_7 AS DOUBLE) AS e7, CAST(w.events_30 AS DOUBLE) AS e30,
         w.purchases_30 / CAST(GREATEST(1, w.events_30) AS DOUBLE) AS rate,
         1.0 / (1.0 + a.days_since_last) AS recency
  FROM target y JOIN windowed w ON w.user_id = y.user_id AND w.snapshot_date = y.snapshot_date
  JOIN state a ON a.user_id = y.user_id AND a.snapshot_date = y.snapshot_date),
diagnosed AS ("""
        + " UNION ALL ".join(
            _diagnosed_sql(f, v)
            for f, v in (
                ("events_last_7d", "e7"),
                ("events_last_30d", "e30"),
                ("conversion_rate_30d", "rate"),
                ("recency_score", "recency"),
            )
        )
        + ")",
        """SELECT feature, ROUND(pos_mean, 6) AS pos_mean, ROUND(neg_mean, 6) AS neg_mean,
                  ROUND(pos_mean - neg_mean, 6) AS difference, ROUND(positive_rate, 6) AS positive_rate,
                  CASE WHEN positive_rate < 0.01 THEN 'too_few_positives'
                       WHEN positive_rate < 0.03 THEN 'unstable' ELSE 'ok' END AS quality
           FROM diagnosed""",
    ),
)
def target_diagnostics(spark, sf_dir):
    return splits.target_diagnostics(labelled(spark, sf_dir))

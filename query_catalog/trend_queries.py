"""Queries on trend series."""

from __future__ import annotations

from pyspark.sql import functions as F

from buywave.functions.dates import trend_date
from buywave.operators import trends as ops
from buywave.operators.sequences import sequence_windows
from query_catalog import fixtures as fixture
from query_catalog.fixtures import EVENT_TYPES, SEQUENCES_SQL, TREND_DAYS_SQL, TRENDS_SQL
from query_catalog.registry import query, with_views


def responses(spark, sf_dir):
    """One trend response per region with weekly entries of event counts.

    An entry of an incomplete week is one value short; a week that runs into the next month
    has the long form of the label.
    """
    raw = fixture.table(spark, sf_dir, "events").select(
        fixture._region().alias("region"),
        F.date_trunc("week", F.to_date("ts")).cast("date").alias("monday"),
        F.to_date("ts").alias("day"),
        "event_type",
    )
    weeks = raw.groupBy("region", "monday").agg(
        *[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES],
        F.countDistinct("day").alias("days"),
    )
    sunday = F.date_add("monday", 6)
    label = F.when(
        F.month("monday") == F.month(sunday),
        F.concat(F.date_format("monday", "MMM d"), F.lit("–"), F.date_format(sunday, "d, yyyy")),
    ).otherwise(F.concat(F.date_format("monday", "MMM d, yyyy"), F.lit(" – "), F.date_format(sunday, "MMM d, yyyy")))
    values = F.array(
        *[F.struct(F.col(t).cast("string").alias("value"), F.concat(F.col(t).cast("string"), F.lit("%")).alias("formattedValue")) for t in EVENT_TYPES]
    )
    complete = F.when(F.col("days") == 7, values).otherwise(F.slice(values, 1, len(EVENT_TYPES) - 1))
    # At most one entry per week and region.
    return weeks.groupBy("region").agg(
        F.struct(F.collect_list(F.struct(label.alias("date"), complete.alias("values"))).alias("timeline_data")).alias(
            "interest_over_time"
        )
    )


@query(
    "trend_flatten",
    """WITH weeks AS (
         SELECT CASE event_id % 3 WHEN 0 THEN 'UA-30' WHEN 1 THEN 'UA-40' ELSE 'UA-50' END AS region,
                CAST(date_trunc('week', ts) AS DATE) AS date, CAST(ts AS DATE) AS day, event_type FROM events),
       entries AS (SELECT region, date, COUNT(DISTINCT day) AS days FROM weeks GROUP BY 1, 2),
       counts AS (SELECT region, date, event_type, COUNT(*) AS n FROM weeks GROUP BY 1, 2, 3),
       points AS (
         SELECT q.query, e.region, e.date,
                CASE WHEN e.days < 7 AND q.query = 'view' THEN NULL ELSE COALESCE(c.n, 0) END AS n
         FROM entries e
         JOIN (SELECT UNNEST(['click', 'error', 'purchase', 'signup', 'view']) AS query) q ON TRUE
         LEFT JOIN counts c ON c.region = e.region AND c.date = e.date AND c.event_type = q.query)
       SELECT query, region, date, COALESCE(n, 0) AS popularity,
              CASE WHEN n IS NULL THEN '0' ELSE CONCAT(CAST(n AS VARCHAR), '%') END AS formatted_value
       FROM points""",
)
def trend_flatten(spark, sf_dir):
    return ops.flatten_response(responses(spark, sf_dir), EVENT_TYPES, F.col("region")).select(
        "query", "region", "date", "popularity", "formatted_value"
    )


@query(
    "trend_dates",
    """WITH labels AS (
         SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 6 AS later, o_orderkey % 5 AS form
         FROM orders)
       SELECT o_orderkey,
              CASE form WHEN 0 THEN strftime(day, '%b %-d, %Y')
                        WHEN 1 THEN CONCAT(strftime(day, '%b %-d'), '–', strftime(later, '%-d, '), strftime(day, '%Y'))
                        WHEN 2 THEN CONCAT(strftime(day, '%b %-d, %Y'), ' – ', strftime(later, '%b %-d, %Y'))
                        WHEN 3 THEN strftime(day, '%b %d, %Y')
                        ELSE CONCAT('week of ', strftime(day, '%b')) END AS label,
              CASE WHEN form < 4 THEN day END AS date
       FROM labels""",
)
def trend_dates(spark, sf_dir):
    orders = fixture.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    later = F.date_add("day", 6)
    form = F.col("o_orderkey") % 5
    label = (
        F.when(form == 0, F.date_format("day", "MMM d, yyyy"))
        .when(
            form == 1,
            F.concat(
                F.date_format("day", "MMM d"), F.lit("–"), F.date_format(later, "d, "), F.date_format("day", "yyyy")
            ),
        )
        .when(
            form == 2,
            F.concat(F.date_format("day", "MMM d, yyyy"), F.lit(" – "), F.date_format(later, "MMM d, yyyy")),
        )
        .when(form == 3, F.date_format("day", "MMM dd, yyyy"))
        .otherwise(F.concat(F.lit("week of "), F.date_format("day", "MMM")))
    )
    return orders.select("o_orderkey", label.alias("label")).withColumn("date", trend_date("label"))


@query(
    "trend_daily",
    with_views(
        TRENDS_SQL,
        """SELECT date, ROUND(AVG(CAST(popularity AS DOUBLE)), 6) AS trend_popularity_mean,
                  CAST(MAX(popularity) AS DOUBLE) AS trend_popularity_max
           FROM fx_trends WHERE popularity IS NOT NULL GROUP BY date""",
    ),
)
def trend_daily(spark, sf_dir):
    return ops.trend_daily(fixture.trends(spark, sf_dir))


@query(
    "trend_ffill",
    with_views(
        TREND_DAYS_SQL,
        """SELECT date, ROUND(trend_popularity_mean, 6) AS trend_popularity_mean, trend_popularity_max FROM trend_days""",
    ),
)
def trend_ffill(spark, sf_dir):
    return fixture.trend_days(spark, sf_dir)


@query(
    "trend_stats",
    with_views(
        TRENDS_SQL,
        """SELECT COUNT(*) AS total_records, MIN(date) AS first_date, MAX(date) AS last_date,
                  string_agg(DISTINCT query, ',' ORDER BY query) AS queries,
                  string_agg(DISTINCT region, ',' ORDER BY region) AS regions
           FROM fx_trends""",
    ),
)
def trend_stats(spark, sf_dir):
    stats = ops.trend_stats(fixture.trends(spark, sf_dir))
    return stats.withColumn("queries", F.array_join("queries", ",")).withColumn("regions", F.array_join("regions", ","))


SERIES_SQL = (
    TRENDS_SQL
    + """,
series AS (SELECT query, region, date, COALESCE(popularity, 0) AS popularity FROM fx_trends)"""
)
OVER = "OVER (PARTITION BY query, region ORDER BY date"
AVERAGES_SQL = f"""
       ROUND(AVG(CAST(popularity AS DOUBLE)) {OVER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS popularity_7d_avg,
       ROUND(AVG(CAST(popularity AS DOUBLE)) {OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS popularity_30d_avg"""


def _change_sql(n: int) -> str:
    before = f"LAG(popularity, {n}) {OVER})"
    return f"""
       CASE WHEN {before} IS NULL THEN 0.0
            WHEN {before} = 0 AND popularity = 0 THEN 0.0
            WHEN {before} = 0 THEN CAST('inf' AS DOUBLE)
            ELSE ROUND(popularity / CAST({before} AS DOUBLE) - 1, 6) END AS popularity_change_{n}d"""


CHANGES_SQL = _change_sql(1) + "," + _change_sql(7)
SLOPE_SQL = """
       ROUND((arg_max(popularity, date) OVER (PARTITION BY query, region)
              - arg_min(popularity, date) OVER (PARTITION BY query, region))
             / CAST(COUNT(*) OVER (PARTITION BY query, region) AS DOUBLE), 6) AS trend_slope"""
KEYS = "query, region, date, popularity"


def series(spark, sf_dir):
    return ops.normalize_types(fixture.trends(spark, sf_dir))


@query("trend_moving_avg", with_views(SERIES_SQL, f"SELECT {KEYS}, {AVERAGES_SQL} FROM series"))
def trend_moving_avg(spark, sf_dir):
    return ops.moving_averages(series(spark, sf_dir))


@query("trend_change", with_views(SERIES_SQL, f"SELECT {KEYS}, {CHANGES_SQL} FROM series"))
def trend_change(spark, sf_dir):
    return ops.changes(series(spark, sf_dir))


@query("trend_slope", with_views(SERIES_SQL, f"SELECT {KEYS}, {SLOPE_SQL} FROM series"))
def trend_slope(spark, sf_dir):
    return ops.slope(series(spark, sf_dir))


@query(
    "trend_features",
    with_views(SERIES_SQL, f"SELECT {KEYS}, {AVERAGES_SQL}, {CHANGES_SQL}, {SLOPE_SQL} FROM series"),
)
def trend_features(spark, sf_dir):
    return ops.trend_features(series(spark, sf_dir))


def _flat(column: str):
    """Vectors as text of whole numbers (the fixture holds counts)."""
    return F.array_join(F.transform(F.flatten(column), lambda x: x.cast("bigint").cast("string")), ",")


def _vectors_sql(first: int, last: int, columns: list[str]) -> str:
    text = " || ',' || ".join(f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in columns)
    frame = f"ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING" if first else f"ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING"
    return f"string_agg({text}, ',') OVER (PARTITION BY trend_id ORDER BY snapshot_date {frame})"


@query(
    "sequence_windows",
    with_views(
        SEQUENCES_SQL,
        f"""SELECT trend_id, window_start, history, future, target FROM (
              SELECT trend_id, snapshot_date AS window_start,
                     {_vectors_sql(0, 6, ["n_events", "n_users"])} AS history,
                     {_vectors_sql(7, 9, ["n_events", "n_users"])} AS future,
                     {_vectors_sql(7, 9, ["target_big"])} AS target,
                     COUNT(*) OVER (PARTITION BY trend_id ORDER BY snapshot_date ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING) AS n
              FROM fx_sequences) framed WHERE n = 3""",
    ),
)
def windows(spark, sf_dir):
    found = sequence_windows(fixture.sequences(spark, sf_dir), context=7, horizon=3)
    return found.select(
        "trend_id", "window_start", *[_flat(c).alias(c) for c in ("history", "future", "target")]
    )

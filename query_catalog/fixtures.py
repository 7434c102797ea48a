"""Input views derived from the given tables, over all of their rows.

Each view has a DataFrame form and the same definition as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.operators.trends import daily_series

# Event types in the tables; the trend views ask for them as search queries.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region() -> F.Column:
    turn = F.col("event_id") % 3
    return F.when(turn == 0, "UA-30").when(turn == 1, "UA-40").otherwise("UA-50")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events. Only clicks, views and purchases carry an item and a price."""
    raw = table(spark, sf_dir, "events")
    on_item = F.col("event_type").isin("click", "view", "purchase")
    item = F.concat(F.lit("item_"), F.get_json_object("props", "$.k"))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        "ts",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        _region().alias("region"),
        F.when(on_item, item).otherwise(F.lit("")).alias("item_id"),
        F.when(on_item, F.col("value")).alias("price"),
        F.col("props").alias("properties"),
    )


EVENTS_SQL = """
fx_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, ts,
         CONCAT(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CASE event_id % 3 WHEN 0 THEN 'UA-30' WHEN 1 THEN 'UA-40' ELSE 'UA-50' END AS region,
         CASE WHEN event_type IN ('click','view','purchase')
              THEN CONCAT('item_', json_extract_string(props, '$.k')) ELSE '' END AS item_id,
         CASE WHEN event_type IN ('click','view','purchase') THEN value END AS price,
         props AS properties
  FROM events),
ev AS (SELECT *, CAST(ts AS DATE) AS date, COALESCE(price, 0.0) AS amount FROM fx_events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("int").alias("id"),
        F.col("c_custkey").alias("user_uid"),
        F.col("n_name").alias("region"),
    )


USERS_SQL = """
fx_users AS (
  SELECT CAST(c_custkey AS INT) AS id, CAST(c_custkey AS VARCHAR) AS user_uid, n_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def trends(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """Popularity per event type, region and day (or week); some values are null."""
    day = F.to_date("ts")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"),
        _region().alias("region"),
        (F.date_trunc("week", day).cast("date") if weekly else day).alias("date"),
    )
    counts = raw.groupBy("query", "region", "date").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "query", "region", "date", F.when(F.col("n") % 7 != 0, F.col("n")).alias("popularity")
    )


def _trends_sql(name: str, date: str) -> str:
    return f"""
{name} AS (
  SELECT query, region, date, CASE WHEN n % 7 = 0 THEN NULL ELSE n END AS popularity
  FROM (SELECT event_type AS query,
               CASE event_id % 3 WHEN 0 THEN 'UA-30' WHEN 1 THEN 'UA-40' ELSE 'UA-50' END AS region,
               {date} AS date, COUNT(*) AS n
        FROM events GROUP BY 1, 2, 3) counted)"""


TRENDS_SQL = _trends_sql("fx_trends", "CAST(ts AS DATE)")
WEEKLY_SQL = _trends_sql("fx_weekly", "CAST(date_trunc('week', ts) AS DATE)")
TREND_DAYS_SQL = (
    WEEKLY_SQL
    + """,
trend_points AS (
  SELECT date, AVG(CAST(popularity AS DOUBLE)) AS trend_popularity_mean,
         CAST(MAX(popularity) AS DOUBLE) AS trend_popularity_max
  FROM fx_weekly WHERE popularity IS NOT NULL GROUP BY date),
trend_calendar AS (
  SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM trend_points),
trend_days AS (
  SELECT c.date, p.trend_popularity_mean, p.trend_popularity_max
  FROM trend_calendar c ASOF JOIN trend_points p ON c.date >= p.date)"""
)


def trend_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(trends(spark, sf_dir, weekly=True))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pseudo-scores: planted signal and many ties."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    bought = F.col("o_orderstatus") == "F"
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("row_id"),
        F.when(bought, 1).otherwise(0).alias("will_purchase_next_7d"),
        (((key * 7919) % 1000 + F.when(bought, 500).otherwise(0)) / F.lit(1500.0)).alias("purchase_proba"),
        F.when(bought, 1 + key % 7).otherwise(999).alias("days_to_next_purchase"),
        ((key * 31) % 40).cast("double").alias("days_to_next_pred"),
        F.when(bought, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("next_purchase_amount"),
        (F.col("o_totalprice") * 0.9).alias("next_purchase_amount_pred"),
    )


SCORES_SQL = """
fx_scores AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS will_purchase_next_7d,
         ((o_orderkey * 7919) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 500 ELSE 0 END) / CAST(1500 AS DOUBLE) AS purchase_proba,
         CASE WHEN o_orderstatus = 'F' THEN 1 + o_orderkey % 7 ELSE 999 END AS days_to_next_purchase,
         CAST((o_orderkey * 31) % 40 AS DOUBLE) AS days_to_next_pred,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS next_purchase_amount,
         o_totalprice * CAST(0.9 AS DOUBLE) AS next_purchase_amount_pred
  FROM orders)"""


def audience_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-scored users with activity, with gaps in every column."""
    key = F.col("row_id")
    return scores(spark, sf_dir).select(
        F.concat(key.cast("string"), F.lit("-x")).alias("user_id"),
        F.when(key % 23 != 0, F.col("purchase_proba")).alias("purchase_proba"),
        F.when(key % 19 != 0, (F.col("purchase_proba") >= 0.05).cast("int")).alias("will_purchase_pred"),
        F.when(key % 17 != 0, key % 6).alias("events_last_7d"),
        F.when(key % 13 != 0, key % 45).alias("days_since_last"),
        F.when(key % 11 != 0, key % 9).alias("events_last_30d"),
    )


AUDIENCE_SQL = (
    SCORES_SQL
    + """,
fx_audience AS (
  SELECT CONCAT(CAST(row_id AS VARCHAR), '-x') AS user_id,
         CASE WHEN row_id % 23 <> 0 THEN purchase_proba END AS purchase_proba,
         CASE WHEN row_id % 19 <> 0 THEN CASE WHEN purchase_proba >= 0.05 THEN 1 ELSE 0 END END AS will_purchase_pred,
         CASE WHEN row_id % 17 <> 0 THEN row_id % 6 END AS events_last_7d,
         CASE WHEN row_id % 13 <> 0 THEN row_id % 45 END AS days_since_last,
         CASE WHEN row_id % 11 <> 0 THEN row_id % 9 END AS events_last_30d
  FROM fx_scores)"""
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to fit the preparation on: gaps, outliers, a nullable category."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 97 == 0, balance * 100).otherwise(balance).alias("total_spent"),
        (key % 17).cast("double").alias("micro_event_growth"),
        ((key % 5) / F.lit(5.0)).alias("seq_emb_0"),
        F.lit(1.0).alias("seq_emb_1"),
        F.when(key % 13 != 0, F.col("c_mktsegment")).alias("last_event_type"),
    )


def features_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted rows plus the suppliers, whose categories were never seen."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("user_id"),
        F.when(key % 3 != 0, balance).alias("total_spent"),
        (key % 17).cast("double").alias("micro_event_growth"),
        ((key % 5) / F.lit(5.0)).alias("seq_emb_0"),
        F.lit(1.0).alias("seq_emb_1"),
        F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")).alias("last_event_type"),
    )
    return features(spark, sf_dir).unionByName(suppliers)


FEATURES_SQL = """
fx_features AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS total_spent,
         CAST(c_custkey % 17 AS DOUBLE) AS micro_event_growth,
         CAST(c_custkey % 5 AS DOUBLE) / CAST(5 AS DOUBLE) AS seq_emb_0,
         CAST(1 AS DOUBLE) AS seq_emb_1,
         CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS last_event_type
  FROM customer),
fx_score_rows AS (
  SELECT * FROM fx_features UNION ALL
  SELECT CONCAT('s', CAST(s_suppkey AS VARCHAR)),
         CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END,
         CAST(s_suppkey % 17 AS DOUBLE), CAST(s_suppkey % 5 AS DOUBLE) / CAST(5 AS DOUBLE),
         CAST(1 AS DOUBLE), CONCAT('NATION ', CAST(s_nationkey AS VARCHAR))
  FROM supplier)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON messages with broken ones, bad prices, bad times and empty properties."""
    raw = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "props")
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(key % 13 == 0, "junk").otherwise(
        F.concat(iso, F.when(key % 2 == 0, "Z").otherwise("+02:00"))
    )
    properties = F.when(key % 17 == 0, "{}").otherwise(
        F.concat(
            F.lit('{"item_id":"item_'), k, F.lit('","price":'), F.when(key % 11 == 0, '"bad"').otherwise(k), F.lit("}")
        )
    )
    text = F.concat(
        F.lit('{"event_id":"'), key.cast("string"), F.lit('","event_type":"'), F.col("event_type"),
        F.lit('","timestamp":"'), time, F.lit('","session_id":"s"'),
        F.when(key % 29 == 0, "").otherwise(F.concat(F.lit(',"user_id":"'), F.col("user_id").cast("string"), F.lit('"'))),
        F.lit(',"region":"UA-30","properties":'), properties, F.lit("}"),
    )
    return raw.select(
        key.alias("seq"),
        F.when(key % 50 == 0, "{broken").otherwise(text).alias("value"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ingest_ts"),
    )


MESSAGES_SQL = """
fx_source AS (
  SELECT event_id AS seq, event_type, ts, user_id, json_extract_string(props, '$.k') AS k FROM events),
fx_messages AS (
  SELECT seq, event_type, ts, user_id, k, seq % 50 <> 0 AS readable,
         CASE WHEN seq % 17 = 0 THEN '{}' ELSE CONCAT('{"item_id":"item_', k, '","price":',
              CASE WHEN seq % 11 = 0 THEN '"bad"' ELSE k END, '}') END AS properties
  FROM fx_source)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    return raw.groupBy(F.col("event_type").alias("trend_id"), F.col("day").alias("snapshot_date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.countDistinct("user_id").cast("double").alias("n_users"),
        F.count_if(F.col("value") > 20).cast("double").alias("target_big"),
    ).select(
        "trend_id", F.lit("event").alias("trend_type"), "snapshot_date", "n_events", "n_users", "target_big"
    )


SEQUENCES_SQL = """
fx_sequences AS (
  SELECT event_type AS trend_id, 'event' AS trend_type, CAST(ts AS DATE) AS snapshot_date,
         CAST(COUNT(*) AS DOUBLE) AS n_events, CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS n_users,
         CAST(SUM(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS DOUBLE) AS target_big
  FROM events GROUP BY 1, 2, 3)"""

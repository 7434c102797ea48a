import datetime as dt

import pytest
from pyspark.sql import functions as F

from buywave.functions import audience as rules
from buywave.functions import features as fx
from buywave.functions.dates import trend_date
from buywave.operators import audience as ops
from buywave.operators import prep
from buywave.operators import trends
from buywave.operators.sequences import sequence_windows
from buywave.schemas import TREND_RESPONSE


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Jun 4, 2025", dt.date(2025, 6, 4)),
        ("Dec 1–7, 2024", dt.date(2024, 12, 1)),
        ("Dec 1 – 7, 2024", dt.date(2024, 12, 1)),
        ("Dec 29, 2024–Jan 4, 2025", dt.date(2024, 12, 29)),
        ("Dec 29 – Jan 4, 2025", dt.date(2025, 12, 29)),
        ("Feb 30, 2024", None),
        ("junk", None),
        ("", None),
        (None, None),
    ],
)
def test_trend_date(spark, text, wanted):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(trend_date("t").alias("d")).first()["d"] == wanted


@pytest.mark.parametrize(
    "p, w, e7, idle, wanted",
    [
        (0.7, 1, 0, 30, "hot"),
        (0.7, 1, 0, 31, "cold"),
        (0.7, 1, 3, 31, "warm"),
        (0.69, 1, 0, 14, "warm"),
        (0.3, 0, 3, 99, "warm"),
        (0.3, 0, 2, 15, "cold"),
        (0.29, 0, 9, 0, "cold"),
        (0.1, 0, 0, 99, "cold"),
        (0.09, 0, 9, 0, "ignore"),
        (0.09, 1, 9, 0, "cold"),
        (None, None, None, None, "ignore"),
        (0.9, None, None, None, "cold"),
    ],
)
def test_segments(spark, p, w, e7, idle, wanted):
    row = spark.createDataFrame(
        [("u-1", p, w, e7, idle, 4)],
        "user_id string, purchase_proba double, will_purchase_pred int, events_last_7d int, days_since_last int, events_last_30d int",
    )
    found = ops.segment_users(row).first()
    assert found["segment"] == wanted and found["short_id"] == "u"
    assert "%" in found["segment_reason"]


def test_search_text(spark):
    users = spark.createDataFrame([("Ab-1",), ("cd-2",)], "user_id string")
    assert ops.search_users(users, " aB ").count() == 1
    assert ops.search_users(users, "  ").count() == 2
    assert ops.search_users(users, "a%").count() == 0


def test_entered_values(spark):
    frame = spark.createDataFrame([("12.5abc",), ("",), (None,), ("-3",)], "t string")
    numbers = [r[0] for r in frame.select(rules.entered_value("total_spent", "t")).collect()]
    assert numbers == [12.5, 0.0, 0.0, -3.0]
    assert frame.select(rules.entered_value("last_item", "t")).collect()[2][0] == ""


def test_clips_keep_null(spark):
    frame = spark.createDataFrame([(None,), (99.0,), (-1.0,)], "x double")
    assert [r[0] for r in frame.select(fx.clip_days("x")).collect()] == [None, 30.0, 0.1]


def test_relative_change_from_zero(spark):
    rows = [("q", "r", dt.date(2024, 1, i + 1), v) for i, v in enumerate([0, 5, 0, 0, 10])]
    frame = spark.createDataFrame(rows, "query string, region string, date date, popularity long")
    found = [r["popularity_change_1d"] for r in trends.changes(frame).orderBy("date").collect()]
    assert found == [0.0, float("inf"), -1.0, 0.0, float("inf")]


def test_slope_of_a_single_point(spark):
    frame = spark.createDataFrame([("q", "r", dt.date(2024, 1, 1), 7)], "query string, region string, date date, popularity long")
    assert trends.trend_features(frame).first()["trend_slope"] == 0.0


def test_response_with_missing_values(spark, tmp_path):
    text = (
        '{"interest_over_time":{"timeline_data":['
        '{"date":"Dec 1–7, 2024","values":[{"value":"5","formattedValue":"5"},{"value":3,"formattedValue":"3"}]},'
        '{"date":"Dec 8–14, 2024","values":[{"value":"x","formattedValue":"<1"}]},'
        '{"date":"never","values":[]}, {"values":[]}]}}'
    )
    path = tmp_path / "r.json"
    path.write_text(text, encoding="utf-8")
    response = spark.read.schema(TREND_RESPONSE).option("multiLine", "true").json(str(path))
    rows = trends.flatten_response(response, ["a", "b"], "UA-30").orderBy("date", "query").collect()
    assert [(r["query"], r["popularity"], r["formatted_value"]) for r in rows] == [
        ("a", 5, "5"), ("b", 3, "3"), ("a", 0, "<1"), ("b", 0, "0")
    ]


def test_absent_trend_columns(spark):
    frame = spark.createDataFrame([("2024-01-05", "9")], "date string, popularity string")
    row = trends.normalize_types(frame).first()
    assert (row["date"], row["popularity"], row["query"]) == (dt.date(2024, 1, 5), 9, None)
    assert trends.daily_series(spark.range(3).toDF("x")).count() == 0


def test_sequence_windows(spark):
    rows = [("t", dt.date(2024, 1, i + 1), float(i)) for i in range(6)]
    frame = spark.createDataFrame(rows, "trend_id string, snapshot_date date, x double")
    found = sequence_windows(frame, context=3, horizon=2).orderBy("window_start").collect()
    assert len(found) == 6 - 3 - 2 + 1
    assert found[0]["history"] == [[0.0], [1.0], [2.0]] and found[0]["target"] == [[3.0], [4.0]]
    assert sequence_windows(frame, context=5, horizon=2).count() == 0
    with pytest.raises(ValueError):
        sequence_windows(frame, context=0, horizon=2)


def test_prediction_series(spark):
    log = spark.sql(
        "SELECT 1 AS id, named_struct('purchase_proba', 0.5D, 'days', 3) AS output, "
        "named_struct('days', 9, 'last_item', 'x') AS input"
    )
    row = ops.prediction_series(log).first().asDict()
    assert row == {"id": 1, "purchase_proba": 0.5, "days": 9}
    assert ops.numeric_columns(log.select("output.*")) == ["purchase_proba", "days"]


def test_feature_groups():
    groups = prep.feature_groups(["total_events", "micro_event_growth", "seq_emb_0"])
    assert groups == {"sequence": ["seq_emb_0"], "micro_trend": ["micro_event_growth"], "tabular": ["total_events"]}


def test_time_texts_need_a_full_date(spark):
    from buywave.streaming.ingest import parse_time

    texts = ["12:00:00", "T12:00", "2024", "2024-01", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05+02:00", "junk", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = rows.select("k", parse_time(F.col("t"), F.lit(None).cast("timestamp")).cast("string").alias("ts")).orderBy("k").collect()
    assert [r.ts for r in found] == [None, None, None, None, "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 01:04:05", None, None]


def test_prices_are_plain_numbers(spark):
    from buywave.functions.features import number

    texts = ["12", "12d", "3f", "1.5F", "2.D", "-1e3", " 7 ", "bad", "", "inf", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = [r[0] for r in rows.orderBy("k").select(number(F.col("t"))).collect()]
    assert found == [12.0, None, None, None, None, -1000.0, 7.0, None, None, float("inf"), None]

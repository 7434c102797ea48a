import math

import pytest
from pyspark.sql import functions as F

from buywave.operators import calibration, metrics, splits


def scored(spark, rows):
    return spark.createDataFrame(rows, "will_purchase_next_7d int, purchase_proba double")


def test_one_class(spark):
    row = metrics.metric_auc(scored(spark, [(0, 0.1), (0, 0.2), (0, 0.3)])).first()
    assert row["auc"] == 0.0 and row["avg_proba"] == pytest.approx(0.2)


def test_auc_with_ties_and_average_precision(spark):
    frame = scored(spark, [(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)])
    assert metrics.metric_auc(frame).first()["auc"] == pytest.approx(3.5 / 4)
    assert metrics.metric_ap(frame).first()["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_no_buyers_have_no_amount_error(spark):
    frame = spark.createDataFrame(
        [(0, 999, 30.0, 0.0, 12.0)],
        "will_purchase_next_7d int, days_to_next_purchase int, days_to_next_pred double, "
        "next_purchase_amount double, next_purchase_amount_pred double",
    )
    row = metrics.metric_regression(frame).first()
    assert (row["mae_days"], row["mae_amount"], row["rmse_amount"]) == (969.0, 0.0, 0.0)


def test_f1_without_positives(spark):
    assert metrics.metric_f1(scored(spark, [(0, 0.1)]), 0.5).first()["f1"] == 0.0


def test_threshold_is_capped_and_ties_take_the_lowest(spark):
    high = metrics.best_threshold(scored(spark, [(1, 0.9), (0, 0.1)])).first()
    assert high["threshold"] == pytest.approx(0.6)
    # Dropping the threshold from 0.4 to 0.3 keeps F1 at 2/3.
    tie = metrics.best_threshold(scored(spark, [(1, 0.4), (0, 0.3), (0, 0.29), (1, 0.28), (0, 0.2)])).first()
    f1 = {0.4: 2 / 3, 0.28: 4 / 6}
    assert tie["best_f1"] == pytest.approx(max(f1.values())) and tie["threshold"] == pytest.approx(0.28)


def test_roc_drops_points_on_straight_lines(spark):
    frame = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.2)])
    kept = [r["threshold"] for r in metrics.roc_curve(frame).orderBy(F.desc("threshold")).collect()]
    assert kept == [math.inf, 0.9, 0.7, 0.2]
    assert metrics.roc_curve(frame, drop_intermediate=False).count() == 5


def test_pr_curve_closes(spark):
    rows = metrics.pr_curve(scored(spark, [(1, 0.9), (0, 0.2)])).collect()
    assert (None, 1.0, 0.0) in [tuple(r) for r in rows] and len(rows) == 3


def test_histogram_keeps_empty_bins_and_widens_a_point(spark):
    rows = metrics.score_histogram(scored(spark, [(1, 0.0), (0, 1.0)]), bins=4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 1]
    point = metrics.score_histogram(scored(spark, [(1, 0.4)]), bins=2).orderBy("bin").collect()
    assert point[0]["low"] == pytest.approx(-0.1) and point[1]["high"] == pytest.approx(0.9)
    assert sum(r["n"] for r in point) == 1


def test_pinball(spark):
    frame = spark.createDataFrame([(10.0, 8.0)], "y double, p double")
    assert metrics.pinball_loss(frame, "y", ["p"], [0.95]).first()["pinball_loss"] == pytest.approx(1.9)
    with pytest.raises(ValueError):
        metrics.pinball_loss(frame, "y", ["p"])


def test_beta_prior_for_few_rows_and_no_spread(spark):
    few = scored(spark, [(1, 0.5)] * 3)
    flat = scored(spark, [(1, 0.5)] * 20)
    for frame in (few, flat):
        row = calibration.beta_moments(frame, "will_purchase_next_7d", "purchase_proba").first()
        assert (row["alpha"], row["beta"]) == (1.0, 1.0)


def test_date_split_sizes(spark):
    for n, wanted in ((20, (14, 3, 3)), (3, (2, 0, 1)), (1, (0, 0, 1))):
        dates = spark.sql(f"SELECT explode(sequence(date'2024-01-01', date_add(date'2024-01-01', {n - 1}))) AS snapshot_date")
        rows = splits.date_splits(dates).orderBy("snapshot_date").collect()
        names = [r["split"] for r in rows]
        assert tuple(names.count(s) for s in ("train", "val", "test")) == wanted
        assert names == sorted(names, key=["train", "val", "test"].index)


def test_quality_flag(spark):
    for positives, flag in ((0, "too_few_positives"), (2, "unstable"), (10, "ok")):
        frame = spark.range(100).select(
            (F.col("id") < positives).cast("int").alias("will_purchase_next_7d"), F.col("id").alias("events_last_7d")
        )
        assert splits.target_diagnostics(frame).first()["quality"] == flag


def test_histogram_equals_numpy_on_edges(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    for values in (np.linspace(0, 1, 31), np.linspace(-3, 7, 61), rng.integers(0, 40, 500) / 7, np.array([2.0, 2.0])):
        frame = spark.createDataFrame([(float(x),) for x in values], "s double")
        for bins in (1, 3, 30):
            found = [r.n for r in metrics.score_histogram(frame, "s", bins).orderBy("bin").collect()]
            assert found == np.histogram(values, bins)[0].tolist()

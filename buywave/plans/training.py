"""Training run: read the splits, fit, evaluate, write metrics and model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from buywave.models import purchase
from buywave.operators.splits import target_diagnostics, time_split
from buywave.sources import snapshots as store


def save_training_set(snapshots: DataFrame, path: str, dates: DataFrame | None = None) -> DataFrame:
    """Split snapshots by date, write them partitioned by split, and return their diagnostics.

    ``dates`` are the snapshot dates (``snapshot_dates`` of the events or facts); with them the rows are
    computed once. They are written once, and the diagnostics read the stored table.
    """
    store.write_splits(time_split(snapshots, dates=dates), path)
    return target_diagnostics(snapshots.sparkSession.read.parquet(path))


def train(
    spark: SparkSession,
    snapshot_path: str,
    experiment_path: str,
    model_path: str,
    now: dt.datetime | None = None,
    **fit_options,
) -> dict[str, dict[str, float]]:
    """Fit on the training split and evaluate on validation and test; returns the metrics."""
    splits = {name: store.read_split(spark, snapshot_path, name) for name in store.SPLITS}
    sizes = {name: rows.count() for name, rows in splits.items()}
    config = {
        "model": "purchase",
        "snapshot_path": snapshot_path,
        **{f"{name}_size": n for name, n in sizes.items()},
        "timestamp": (now or dt.datetime.now(dt.timezone.utc)).isoformat(),
    }
    store.write_metadata(spark, config, f"{experiment_path}/config")
    model = purchase.fit(splits["train"], **fit_options)
    found = {}
    for split, title in (("val", "validation"), ("test", "test")):
        found[title] = {r["metric"]: r["value"] for r in model.evaluate(splits[split]).collect()}
    store.write_metadata(spark, found, f"{experiment_path}/metrics")
    model.feature_importance(spark).coalesce(1).write.mode("overwrite").json(f"{experiment_path}/feature_importance")
    model.save(spark, model_path)
    return found

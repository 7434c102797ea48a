"""Scored audience: daily snapshot, predictions, segments, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buywave.functions import audience as rules
from buywave.models.purchase import PurchaseModel
from buywave.operators import audience as ops
from buywave.schemas import PREDICTIONS


def audience(snapshot: DataFrame, model: PurchaseModel, search: str = "") -> DataFrame:
    """Users of a daily snapshot with predictions and segment, best prospects first."""
    scored = ops.segment_users(model.score(snapshot))
    return ops.rank_users(ops.search_users(scored, search))


def users_listing(users: DataFrame, snapshot: DataFrame, model: PurchaseModel | None = None, search: str = "") -> DataFrame:
    """Every user with its snapshot features.

    With a model, users are scored, segmented and ranked, those without a snapshot last; without one they
    come in id order.
    """
    if model is None:
        return ops.search_users(ops.users_features(users, snapshot), search).orderBy("user_id")
    listed = ops.users_features(users, model.score(snapshot))
    return ops.rank_users(ops.search_users(ops.segment_users(listed), search))


def score_records(records: DataFrame, model: PurchaseModel) -> DataFrame:
    """Loose records to predictions: inputs in the model's shape, ``invalid_fields``, prediction columns.

    A record with invalid fields stays, without predictions.
    """
    features = model.preparation.columns
    checked = records.withColumn("invalid_fields", rules.invalid_fields(records, features))
    others = [c for c in checked.columns if c not in features]
    scored = model.score(rules.shape_inputs(checked, features, keep=others))
    valid = F.size("invalid_fields") == 0
    return scored.withColumns({c: F.when(valid, F.col(c)) for c in PREDICTIONS})

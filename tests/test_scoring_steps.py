"""Steps around the models: a snapshot built once, codes without an exchange, quantiles known from counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from buywave.operators import ordering, prep
from query_catalog import score_queries
from tests.conftest import SMALL

FEW = {"maxIter": 1, "maxDepth": 2}


def test_snapshot_to_score_is_built_once(spark):
    _, snapshot = score_queries._fitted(spark, SMALL, classifier=FEW, regressor=FEW)
    plan = snapshot._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "parquet" not in plan.lower()


def test_few_codes_move_no_rows(spark):
    """Rows stay where they are when a short dictionary gives the codes; a long one may deal them out."""
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("last_item")).checkpoint()
    model, _ = prep.fit_preparation(rows)
    found = model.transform(rows)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.groupBy("x_last_item").count().orderBy("x_last_item").collect() == [(0.0, 34), (1.0, 33), (2.0, 33)]


def test_brackets_of_one_value_are_not_looked_into(spark, monkeypatch):
    """Columns of few values have their quantiles from the counts; only the others are unpivoted."""
    looked = []
    own = ordering._inside
    monkeypatch.setattr(ordering, "_inside", lambda n, s, found: looked.extend(b.column for b in found) or own(n, s, found))
    many = np.random.default_rng(2).normal(size=3000)
    values = [(float(x), float(i % 2), -0.0 if i % 3 else 0.0) for i, x in enumerate(many)]
    frame = spark.createDataFrame([*values, (None, None, float("nan"))], "many double, few double, zero double")
    found = ordering.quantile_values(frame, ["many", "few", "zero"], [0.25, 0.75])
    assert found["few"] == {0.25: 0.0, 0.75: 1.0} and found["zero"] == {0.25: 0.0, 0.75: 0.0}
    assert found["many"][0.25] == pytest.approx(np.quantile(many, 0.25), abs=1e-12)
    assert set(looked) == {"many"}

"""Registry of the checked queries: a Spark callable each, and its SQL twin where one exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Cents over a small power of two end in a 5 as the seventh digit, which engines round
# differently; two more digits are compared there.
FINER = {"avg_spend_per_event": 8, "avg_order_value_30d": 8}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles cut to the compared digits, so that the order of a sum does not show."""
    return df.select(
        *[
            F.round(c, FINER.get(c, DIGITS)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @functools.wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def with_views(views: str, body: str) -> str:
    return f"WITH {views}\n{body}"

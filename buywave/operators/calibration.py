"""Beta calibration of predicted probabilities by moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS = 10
PARAMETER_FLOOR = 0.1
CLIP = 1e-10


def beta_moments(
    df: DataFrame, label: str, score: str, alpha_prior: float = 1.0, beta_prior: float = 1.0
) -> DataFrame:
    """Row (alpha, beta) of the Beta distribution fitted to the scores of the positives.

    Scores outside (0, 1) and rows without label are left out; without positives all scores are
    used; fewer than 10 rows, no spread or an impossible spread give the prior.
    """
    x, y = F.col(score).cast("double"), F.col(label)
    positive = F.when(y == 1, x)
    moments = df.filter((x > 0) & (x < 1) & ~F.isnan(x) & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.avg(positive), F.avg(x)).alias("m"),
        F.coalesce(F.var_pop(positive), F.var_pop(x)).alias("v"),
    )
    room = F.col("m") * (1 - F.col("m"))
    spread = F.when(F.col("v") > room, room * 0.9).otherwise(F.col("v"))
    size = room / F.nullif(spread, F.lit(0.0)) - 1
    usable = F.coalesce((F.col("rows") >= MIN_ROWS) & (size > 0), F.lit(False))
    floor = F.lit(PARAMETER_FLOOR)
    return moments.select(
        F.when(usable, F.greatest(F.col("m") * size, floor)).otherwise(F.lit(float(alpha_prior))).alias("alpha"),
        F.when(usable, F.greatest((1 - F.col("m")) * size, floor)).otherwise(F.lit(float(beta_prior))).alias("beta"),
    )


def calibrate(
    score: Column | str,
    alpha: Column | float,
    beta: Column | float,
    alpha_prior: float = 1.0,
    beta_prior: float = 1.0,
) -> Column:
    """Calibrated probability: mixed alpha over mixed alpha plus mixed beta."""
    p = F.col(score) if isinstance(score, str) else score
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    for_purchase = p * a + (1 - p) * alpha_prior
    against = p * b + (1 - p) * beta_prior
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), for_purchase / (for_purchase + against)))


def calibrate_scores(df: DataFrame, label: str, score: str, output: str = "calibrated") -> DataFrame:
    """Fit on ``df`` and add the calibrated score; the parameters are one scalar subquery."""
    fitted = beta_moments(df, label, score).select(F.struct("alpha", "beta")).scalar()
    return df.withColumn(output, calibrate(score, fitted["alpha"], fitted["beta"]))

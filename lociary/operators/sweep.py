"""Threshold sweeps in one pass: each row is binned once, bins are then summed per threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociary.functions.bins import threshold_index
from lociary.functions.stats import binomial_interval


def calibration_sweep(
    df: DataFrame, group: list[str], prob: str, truth: str, low: float, step: float, count: int
) -> DataFrame:
    """Per group and threshold t: statistics of the rows with ``prob > t``.

    The rows shrink to at most ``count`` partial sums per group before anything is repeated per threshold.
    """
    passed = threshold_index(F.col(prob), low, step, count)
    cells = (
        df.filter(F.col(prob) > low)
        .groupBy(*group, passed.alias("__passed"))
        .agg(
            F.sum(prob).alias("__prob"),
            F.count(F.lit(1)).alias("__n"),
            F.count(truth).alias("__known"),
            F.count_if(F.col(truth)).alias("__true"),
        )
    )
    sums = (
        cells.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__passed") - 1)))
        .groupBy(*group, "__k")
        .agg(*[F.sum(c).alias(c) for c in ("__prob", "__n", "__known", "__true")])
    )
    lower, upper = binomial_interval(F.col("__true"), F.col("__n"))
    return sums.select(
        *group,
        F.round(low + F.col("__k") * step, 9).alias("threshold"),
        F.try_divide("__prob", "__n").alias("mean_prob"),
        F.try_divide(F.col("__true").cast("double"), F.col("__known")).alias("calibration"),
        lower.alias("calibration_lower"),
        upper.alias("calibration_upper"),
        F.col("__n").alias("count"),
    )


def add_fdr(sweep: DataFrame) -> DataFrame:
    return sweep.withColumns(
        {
            "fdr": 1 - F.col("calibration"),
            "fdr_lower": 1 - F.col("calibration_upper"),
            "fdr_upper": 1 - F.col("calibration_lower"),
        }
    )

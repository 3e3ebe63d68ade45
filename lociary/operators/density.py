"""Kernel density of a column per group, from binned weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lociary.operators.keyed import attach, settle
from lociary.operators.ordered import exact_quantiles


def bandwidths(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, n, low, high, bandwidth``: 0.9 min(sd, interquartile range / 1.34) n^-1/5, over the values that are not NULL.

    Where that is 0 the deviation counts alone, then the size of the value, then 1.
    """
    known = df.select(*group, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    stats = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )
    stats = attach(stats, exact_quantiles(known, group, value, {"q1": 0.25, "q3": 0.75}), group, "left", nulls_match=True)
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    usable = [F.when(c > 0, c) for c in (spread, F.col("sd"), F.abs("low"))]
    width = 0.9 * F.coalesce(*usable, F.lit(1.0)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return stats.select(*group, "n", "low", "high", width.alias("bandwidth"))


def density(df: DataFrame, group: list[str], value: str, points: int = 512, reach: float = 3.0) -> DataFrame:
    """``group, bandwidth, place, at, density``: a Gaussian density at ``points`` places per group.

    The grid runs ``reach`` bandwidths beyond the extremes. Each value's weight is dealt to its two neighbouring places in
    one scan with partial sums; what is convolved with the kernel is the grid's weights, ``points`` numbers per group.
    NULLs are left out; NULL groups are groups.
    """
    stats = settle(bandwidths(df, group, value))
    step = (F.col("high") - F.col("low") + 2 * reach * F.col("bandwidth")) / (points - 1)
    stats = stats.withColumn("step", step).withColumn("first", F.col("low") - reach * F.col("bandwidth"))
    rows = df.select(*group, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    placed = attach(rows, stats, group, "inner", nulls_match=True).withColumn("__x", (F.col(value) - F.col("first")) / F.col("step"))
    cell, part = F.floor("__x"), F.col("__x") - F.floor("__x")
    shares = F.array(F.struct(cell.alias("cell"), (1 - part).alias("w")), F.struct((cell + 1).alias("cell"), part.alias("w")))
    fixed = [*group, "n", "bandwidth", "step", "first"]
    weights = placed.select(*fixed, F.explode(shares).alias("s")).groupBy(*fixed, F.col("s.cell").alias("cell")).agg(F.sum("s.w").alias("w"))
    grids = weights.groupBy(*fixed).agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("cells"))
    out = grids.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    away = lambda c: (F.col("place") - c["cell"]) * F.col("step") / F.col("bandwidth")
    height = F.aggregate("cells", F.lit(0.0), lambda sum_, c: sum_ + c["w"] * F.exp(-0.5 * away(c) * away(c)))
    return out.select(
        *group, "bandwidth", "place", (F.col("first") + F.col("place") * F.col("step")).alias("at"),
        (height / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
    )

"""Mergeable quantile sketches: counted buckets per group, stored as one map and added up over batches.

The bounds of the buckets grow by the factor (1 + a) / (1 - a), so any value of a bucket lies within the share ``a`` of the
bucket's representative; zero has a bucket of its own, negative values mirror positive ones. Counts are whole numbers, so
a merged sketch is the sketch of all rows whatever the batches and their order, and the bucket that holds a rank is
exact: an answer is within ``a`` of the value at that rank. A sketch of doubles has at most 3000 / a entries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 0.01
_FIRST = 1 << 40  # more than any bucket's number, so that codes of positive values are positive


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Code of a value's bucket, in the order of the values; NULL for NULL, NaN and infinite values."""
    x = value.cast("double")
    number = F.ceil(F.ln(F.abs(x)) / math.log((1 + accuracy) / (1 - accuracy))).cast("bigint")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, number + _FIRST).otherwise(-(number + _FIRST)))


def bucket_value(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket."""
    factor = (1 + accuracy) / (1 - accuracy)
    size = F.exp((F.abs(bucket) - _FIRST) * math.log(factor)) * (1 - accuracy)
    return F.when(bucket == 0, 0.0).when(bucket > 0, size).otherwise(-size)


def _as_maps(counts: DataFrame, group: list[str]) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    return counts.groupBy(*group).agg(F.map_from_entries(entries).alias("sketch"), F.sum("n").alias("n"))


def quantile_sketches(df: DataFrame, group: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``group, sketch, n``: one sketch (bucket -> count) per group; values without a bucket do not count."""
    counts = df.select(*group, bucket_of(F.col(value), accuracy).alias("bucket")).filter(F.col("bucket").isNotNull())
    return _as_maps(counts.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n")), group)


def merge_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of coarser groups, or of more batches: counts of equal buckets added."""
    entries = sketches.select(*group, F.explode("sketch").alias("bucket", "n"))
    return _as_maps(entries.groupBy(*group, "bucket").agg(F.sum("n").alias("n")), group)


def sketch_quantiles(sketches: DataFrame, probabilities: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """``sketches`` with one column per name of ``probabilities``: the value at rank floor(p (n - 1)), counted from 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("found"))

    def answer(p: float) -> Column:
        rank = F.floor(F.lit(p) * (F.col("n") - 1))

        def step(state: Column, entry: Column) -> Column:
            seen = state["seen"] + entry["value"]
            return F.struct(seen.alias("seen"), F.when(state["found"].isNull() & (seen > rank), entry["key"]).otherwise(state["found"]).alias("found"))

        return bucket_value(F.aggregate(F.array_sort(F.map_entries("sketch")), start, step)["found"], accuracy)

    return sketches.withColumns({name: answer(p) for name, p in probabilities.items()})

"""Connected components of an edge table, as joins and aggregates over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from lociary.llm.common import store

FEW = 32


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The stored table with its row count and content sum, from the job that writes it."""
    seen = Observation()
    stored = store(
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0)).alias("s")),
        name,
    )
    return stored, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; the component is its smallest node.

    Alternates the two star operations until nothing changes: each node first hands its larger neighbours to
    its smallest neighbour, then its smaller ones. The number of rounds grows with the logarithm of the
    number of nodes, not with the length of a chain, and no node's neighbours are ever gathered in one row.
    """
    forward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    current, state = _observed(forward, "edges")
    for _ in range(FEW * 2):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(down.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        current, after = _observed(small, "small-star")
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("connected components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
